"""The corpus pipeline: toxicity, language ID, near-duplicates, benchmark decontamination, packing.

Each stage takes what its predecessor kept and, but for the last, returns
the columns of documents. run() writes each stage's rows to the shared
folder and reads them again; a stage's own scratch tables go when it ends.

Defined results of all stages: an empty table gives an empty one; columns
beyond doc_id and text are carried along untouched, whatever they are
called; repeated rows are judged alike, and each stays or goes as its
stage says; a null doc_id is nobody's twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.llm import decontaminate, jaccard, langid, packing, toxicity
from loamdex.session import discard, materialise, table, temporary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of score >= 0.7; learns from the labelled ones that are not held out.

    Null and empty texts have no hits and stay. Without labelled rows of both kinds nothing is rejected."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, "row")
    return judged.where("predicted = 0").select("doc_id.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language: null texts and those without letters (empty ones among them).

    Learns from rows with a language that are not held out; without any, all texts are in no known language and go. Ties go to the
    language first by name, and reject nothing."""
    training = docs.where(~langid.held_out(F.col("doc_id")))
    judged = langid.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), training, "row")
    return judged.where("lang_pred <> 'und'").select("doc_id.*")


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document of the smallest doc_id; without shingles (null and empty texts) or an id, all.

    Rows that share an id are one document only where their texts are near-duplicates too; of repeated rows, and of such rows of the
    smallest id, one stays (which is not defined where the texts differ)."""
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.limit(1).count():
        return _duplicates_by_name(docs)
    found = materialise(jaccard.similar(docs), "duplicates")
    gone = materialise(found.where("doc_id <> component_id").select("doc_id").distinct(), "duplicate-ids")
    # a list of ids is broadcast only up to a checked size; beyond it, rows are dealt by id
    gone = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _duplicates_by_name(docs: DataFrame) -> DataFrame:
    """The same where ids repeat: rows are told apart by a hash of id and text."""
    for salt in range(8):
        named = docs.withColumn("_name", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(salt), "doc_id", F.coalesce("text", F.lit("")))))
        names = named.where("_name is not null").select("_name", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).distinct()
        names = materialise(names, "duplicate-names")
        if not names.groupBy("_name").count().where("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError("no salt gave every document a name of its own")
    found = jaccard.similar(named, "_name").where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("_name"), "component_id").distinct()
    found = materialise(found.join(names.select("_name", "doc_id"), "_name"), "duplicates")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "_name")).alias("x")).select("x._name")
    one = named.join(first, "_name", "left_semi").dropDuplicates(["_name"])
    return named.join(found, "_name", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of the benchmark. Null and empty texts hold none and stay; an empty benchmark rejects nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: a row per piece. A null or empty text is one piece, its closing id; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Toxicity and language ID are fitted models and packing an online algorithm: SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary() as keep:
            after = keep(materialise(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if hasattr(docs, "_scratch"):
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
