"""Fusing ranked lists: reciprocal rank fusion, path-to-chunk collapse, document scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamdex.operators.ranks import places

K = 60.0
# Fixed order of the engines' labels.
LABELS = ["fts", "vector", "fuzzy", "graph"]


#: Lists of more rows in all are ranked by a range sort, smaller ones by a window.
LARGE = 2_000_000


def rank_lists(hits: DataFrame, by: tuple[str, ...] = ("engine",), ties: tuple[str, ...] = ("key",), large: int | None = LARGE) -> DataFrame:
    """Each list's rows by score, numbered from 1. Lists of any length: beyond `large` rows no list is sorted in one task (None: lists are known to be short)."""
    if large is None or hits.limit(large + 1).count() <= large:
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *ties)))
    out = places(hits, list(by), [F.desc("score"), *ties], "_place", "ranked-lists")
    return out.withColumn("rank", (F.col("_place") + 1).cast("int")).drop("_place")


def rrf(ranked: DataFrame, keys: tuple[str, ...] = ("key",), k: float = K) -> DataFrame:
    """Sum of 1 / (k + rank) per key; a key that one list holds twice counts twice."""
    return ranked.groupBy(*keys).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))


def dedup_best(hits: DataFrame, keys: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """The best row of each key, as an aggregate that combines before the shuffle."""
    rest = [c for c in hits.columns if c not in keys]
    best = F.min(F.struct((-F.col("score")).alias("_s"), *[F.col(t).alias(f"_{t}") for t in ties], *rest)).alias("_best")
    return hits.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def ordered_sources(sources):
    """Each label once, in the fixed order."""
    return F.filter(F.array(*map(F.lit, LABELS)), lambda s: F.array_contains(sources, s))


def document_scores(rows: DataFrame, file: str = "file", score: str = "score", best: int = 3) -> DataFrame:
    """(file, score): the sum of a file's best few. Each task sends no more than so many of a file."""
    place = F.row_number().over(Window.partitionBy(file).orderBy(F.desc(score)))
    return rows.select(file, score).withColumn("_place", place).where(F.col("_place") <= best).groupBy(file).agg(F.sum(score).alias(score))


def document_max(rows: DataFrame, file: str = "file", score: str = "score", position: str = "pos") -> DataFrame:
    """(file, score, pos): the best score and the first appearance."""
    return rows.groupBy(file).agg(F.max(score).alias(score), F.min(position).alias(position))


def fuse(hits: DataFrame, by: tuple[str, ...] = (), k: float = K, limit: int | None = 5, doc_score: bool = False) -> DataFrame:
    """hits (engine, file, chunk_id, score, content, line_start, line_end, chunk_type [, by...]) of all engines to ranked results.

    fts and vector hits are keyed by chunk (by file if they have none), fuzzy (line) and graph hits by file. Ranks are taken per
    engine, ties by file, chunk and line; the content is the text engine's, then the vector engine's, then the matched line."""
    keyed = hits.withColumn("_chunk", F.when(F.col("engine").isin("fts", "vector"), F.col("chunk_id")))
    ranked = rank_lists(keyed, (*by, "engine"), ("file", "_chunk", "line_start"), None)  # the engines cut their lists
    priority = F.array_position(F.array(*map(F.lit, LABELS)), F.col("engine"))
    payload = F.struct(priority.alias("p"), F.col("rank").alias("r"), "content", "line_start", "line_end", "chunk_type")
    grouped = ranked.groupBy(*by, "file", "_chunk").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.collect_set("engine").alias("sources"), F.min(F.when(F.col("content").isNotNull(), payload)).alias("x"))
    grouped = grouped.select(*by, "file", F.col("_chunk").alias("chunk_id"), "rrf", "sources", "x.content", "x.line_start", "x.line_end", "x.chunk_type")
    # path rows: their sums go to the chunk rows of the file, or stay
    files = Window.partitionBy(*by, "file")
    path = F.col("chunk_id").isNull()
    more = F.sum(F.when(path, F.col("rrf"))).over(files)
    sources = F.flatten(F.collect_list(F.when(path, F.col("sources"))).over(files))
    has_chunks = F.max(~path).over(files)
    out = grouped.withColumn("_more", F.coalesce(more, F.lit(0.0))).withColumn("_from", sources).withColumn("_chunks", has_chunks)
    out = out.where(~path | ~F.col("_chunks"))
    out = out.withColumn("score", F.when(path, F.col("rrf")).otherwise(F.col("rrf") + F.col("_more"))).withColumn("sources", ordered_sources(F.concat("sources", "_from")))
    out = out.select(*by, "file", F.round("score", 9).alias("score"), "sources", "content", "chunk_id", "line_start", "line_end", "chunk_type")
    if doc_score:
        place = Window.partitionBy(*by, "file").orderBy(F.desc("score"), F.col("line_start").asc_nulls_last(), "chunk_id")
        out = out.withColumn("_place", F.row_number().over(place)).withColumn("_total", F.sum(F.when(F.col("_place") <= 3, F.col("score"))).over(Window.partitionBy(*by, "file")))
        none = {c: F.lit(None).cast(t) for c, t in (("chunk_id", out.schema["chunk_id"].dataType), ("line_start", "int"), ("line_end", "int"), ("chunk_type", "string"))}
        out = out.where("_place = 1").withColumn("score", F.round("_total", 9)).drop("_place", "_total").withColumns(none)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "file", F.col("line_start").asc_nulls_last(), "chunk_id")) if by else None
    if by:
        out = out.withColumn("rank", rank)
        return out.where(F.col("rank") <= limit) if limit else out
    out = out.orderBy(F.desc("score"), "file", F.col("line_start").asc_nulls_last(), "chunk_id")
    return out.limit(limit) if limit else out


def first_chunks(chunks: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Each file's first chunk, as an aggregate."""
    rest = [c for c in chunks.columns if c not in by]
    return chunks.groupBy(*by).agg(F.min(F.struct("line_start", *[c for c in rest if c != "line_start"])).alias("x")).select(*by, *[F.col(f"x.{c}").alias(c) for c in rest])


def enrich_graph_only(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results that only the graph found, without content, take the file's first chunk."""
    first = first_chunks(chunks.select("file", "chunk_id", "content", "line_start", "line_end", "chunk_type"))
    first = first.select("file", *[F.col(c).alias(f"_{c}") for c in ("chunk_id", "content", "line_start", "line_end", "chunk_type")])
    bare = F.col("content").isNull() & F.col("chunk_id").isNull() & F.array_contains("sources", "graph")
    out = results.join(first, "file", "left")
    for c in ("chunk_id", "content", "line_start", "line_end", "chunk_type"):
        if c != "chunk_id" and c != "content":
            out = out.withColumn(c, F.when(bare, F.col(f"_{c}")).otherwise(F.col(c)))
    out = out.withColumn("_id", F.when(bare, F.col("_chunk_id")).otherwise(F.col("chunk_id"))).withColumn("_text", F.when(bare, F.col("_content")).otherwise(F.col("content")))
    return out.withColumn("chunk_id", F.col("_id")).withColumn("content", F.col("_text")).select(*results.columns)
