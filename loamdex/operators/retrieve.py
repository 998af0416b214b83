"""A chunk with what stands around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamdex.functions.text import lines


def neighbours(chunks: DataFrame, wanted: DataFrame, before: int = 1, after: int = 1, doc: str = "doc_id") -> DataFrame:
    """(wanted_id, chunk columns, offset): the chunks up to `before` and `after` places from each wanted one (chunk_id), in order.

    Only chunks of wanted documents are ranked."""
    from pyspark.sql import Window

    ids = wanted.select("chunk_id").distinct()
    own = chunks.join(chunks.join(ids, "chunk_id", "left_semi").select(doc).distinct(), doc, "left_semi")
    placed = own.withColumn("_pos", F.row_number().over(Window.partitionBy(doc).orderBy("line_start", "chunk_id")))
    centre = placed.join(ids, "chunk_id", "left_semi").select(F.col("chunk_id").alias("wanted_id"), F.col(doc).alias("_doc"), F.col("_pos").alias("_at"))
    near = placed.join(centre, (placed[doc] == centre["_doc"]) & F.col("_pos").between(F.col("_at") - before, F.col("_at") + after))
    return near.select("wanted_id", *chunks.columns, (F.col("_pos") - F.col("_at")).cast("int").alias("offset"))


def line_context(chunks: DataFrame, docs: DataFrame, before: int = 3, after: int = 3, doc: str = "doc_id", content: str = "content", parity: bool = False) -> DataFrame:
    """chunks with context_before_lines and context_after_lines from their documents.

    parity: count lines from 0, as if line_start were an index, so that the chunk's first line comes before it and one after it is missed."""
    rows = docs.select(doc, lines(F.col(content)).alias("_lines"))
    shift = 1 if parity else 0
    first = F.col("line_start") + shift
    begin = F.greatest(F.lit(1), first - before)
    joined = chunks.join(rows, doc)
    head = F.slice("_lines", begin, F.greatest(first - begin, F.lit(0)))
    tail = F.when(F.col("line_end") + shift < F.size("_lines"), F.slice("_lines", F.col("line_end") + 1 + shift, F.lit(after))).otherwise(F.array().cast("array<string>"))
    return joined.select(*[chunks[c] for c in chunks.columns], head.alias("context_before_lines"), tail.alias("context_after_lines"))
