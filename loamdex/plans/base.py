"""The driver's tables in the roles of the engine's own, and SQL fragments that say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.engine import Engine
from loamdex.operators import fts, graph, vocab
from loamdex.session import app_scratch, file_system, materialise, permanent, table
from loamdex.sources.config import Config, KnowledgeBase, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_MADE: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, tables: str, make: Callable[[], object]):
    """What make() gives, made once per application and state of the tables: what a sync keeps, searches find ready."""
    stamps = []
    for t in tables.split():
        path = f"{sf_dir}/{t}.parquet"
        fs, to = file_system(spark, path)
        status = fs.getFileStatus(to(path))
        stamps.append((status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, str(sf_dir), name, *stamps)
    if key not in _MADE:
        with permanent():
            _MADE[key] = make()
    return _MADE[key]


def text_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of documents."""

    def make():
        docs = documents(spark, sf_dir).select("doc_id", "content")
        index = fts.postings(docs).sortWithinPartitions("term")
        return materialise(index, "index-postings"), materialise(fts.lengths(docs), "index-lengths")

    return once(spark, sf_dir, "text", "documents", make)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, frequency) of documents."""
    return once(spark, sf_dir, "vocabulary", "documents", lambda: materialise(vocab.build_vocabulary(documents(spark, sf_dir)), "index-vocabulary"))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents; their parts as entities, each related to the part of the next line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    each = lines.join(part, "l_partkey")
    rows = each.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name", "p_type"))).alias("x"))
    path = F.concat(F.lit("order/"), F.col("l_orderkey").cast("string"))
    entities = F.transform("x", lambda x: F.struct(x["p_name"].alias("name"), x["p_type"].alias("type"), F.lit(None).cast("string").alias("description")))
    nexts = F.zip_with("x", F.slice("x", F.lit(2), F.size("x")), lambda a, b: F.struct(a["p_name"].alias("source"), b["p_name"].alias("target"), F.lit("next to").alias("relation"), F.lit(None).cast("string").alias("description")))
    return rows.select(path.alias("path"), entities.alias("entities"), F.filter(nexts, lambda r: r["target"].isNotNull()).alias("relationships"))


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extractions(), as a sync would have stored them."""

    def make():
        nodes, edges = graph.ingest(materialise(extractions(spark, sf_dir), "graph-extractions"))
        return materialise(nodes, "graph-nodes"), materialise(edges, "graph-edges")

    return once(spark, sf_dir, "graph", "lineitem part", make)


ROLES = ("assistant", "system", "user")


def config(folder: str) -> Config:
    return Config({r: KnowledgeBase([], True, f"turns of the {r}") for r in ROLES}, Model(dimensions=32), None, folder)


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as files: kb (the role), path, content."""
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "conversations").select(F.col("role").alias("kb"), path.alias("path"), F.col("text").alias("content"), "conv_id", "turn")


TURN_FILES = "cv as (select role as kb, 'conv/' || conv_id || '/' || turn || '.txt' as path, role || ':conv/' || conv_id || '/' || turn || '.txt' as file, text as content, conv_id, turn from conversations)"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the turns of conversations, synced."""

    def make():
        out = Engine(spark, config(f"{app_scratch(spark)}/store-{uuid.uuid4().hex}"), source=lambda names: turn_files(spark, sf_dir).where(F.col("kb").isin(names)))
        out.sync()
        return out

    return once(spark, sf_dir, "engine", "conversations", make)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content, kb (the source)."""
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), F.col("source").alias("kb"))


DOCS = "docs as (select doc_id, source || '/' || doc_id || '.txt' as path, text as content, source as kb from documents)"
TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunks: chunk_id, doc_id, file, content, line_start, line_end, chunk_type."""
    df = table(spark, sf_dir, "conversations")
    return df.select((F.col("conv_id") * 100000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("file"), F.col("text").alias("content"), (F.col("turn") + 1).cast("int").alias("line_start"), (F.col("turn") + 1).cast("int").alias("line_end"), F.col("role").alias("chunk_type"))


TURNS = "turns as (select conv_id * 100000 + turn as chunk_id, conv_id as doc_id, 'conv/' || conv_id || '.md' as file, text as content, cast(turn + 1 as int) as line_start, cast(turn + 1 as int) as line_end, role as chunk_type from conversations)"


def bm25_sql(source: str, phrases: list[list[str]], condition: str, text: str = "content", key: str = "doc_id", limit: int | None = 10, more: str = "") -> str:
    """BM25 of distinct phrases; condition over tf0, tf1, ..."""
    tf = []
    for i, p in enumerate(phrases):
        if len(p) == 1:
            tf.append(f"len(list_filter(w, lambda x: x = '{p[0]}')) as tf{i}")
        else:
            same = " and ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(p))
            tf.append(f"len(list_filter(range(1, cast(len(w) as bigint) + 1), lambda i: {same})) as tf{i}")
    part = " + ".join(f"idf{i} * tf{i} * 2.2::double / (tf{i} + 1.2::double * (0.25::double + 0.75::double * l / a))" for i in range(len(phrases)))
    idf = ", ".join(f"greatest(case when ln((n - d{i} + 0.5::double) / (d{i} + 0.5::double)) > 0 then ln((n - d{i} + 0.5::double) / (d{i} + 0.5::double)) else 1e-6::double end, 1e-300::double) as idf{i}" for i in range(len(phrases)))
    df = ", ".join(f"cast(count(*) filter (tf{i} > 0) as double) as d{i}" for i in range(len(phrases)))
    end = f" order by score desc, {key} limit {limit}" if limit else ""
    return (
        f"tok as (select *, {TOKENS.format(text)} as w from {source}), cnt as (select * exclude (w), len(w) as l, {', '.join(tf)} from tok), "
        f"st as (select cast(count(*) as double) as n, avg(l) as a, {df} from cnt), idfs as (select n, a, {idf} from st), "
        f"hits as (select {key}{more}, round({part}, 6) as score from cnt, idfs where {condition}{end})"
    )
