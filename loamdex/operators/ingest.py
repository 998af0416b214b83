"""Change detection and the tables' upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamdex.functions.text import content_hash


def diff(files: DataFrame, stored: DataFrame, force: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """files (by, path, content or content_hash) against stored (by, path, content_hash): (by, path, change_type) of new, updated, unchanged, deleted.

    Only paths and hashes are shuffled, never contents."""
    keys = [*by, "path"]
    now = files.select(*keys, F.col("content_hash") if "content_hash" in files.columns else content_hash(F.col("content")).alias("content_hash")).withColumn("_now", F.lit(True))
    old = stored.select(*keys, F.col("content_hash").alias("_old_hash")).withColumn("_old", F.lit(True))
    both = now.join(old, keys, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_now").isNull(), "deleted")
        .when(F.lit(force) | F.col("content_hash").isNull() | (F.col("content_hash") != F.col("_old_hash")), "updated")
        .otherwise("unchanged")
    )
    return both.select(*keys, change.alias("change_type"))


def resume(stored: DataFrame, files: DataFrame, changes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Paths still to be extracted: not marked, still on disk, not about to be upserted anyway."""
    keys = [*by, "path"]
    todo = stored.where(~F.col("extracted")).select(*keys).join(files.select(*keys), keys, "left_semi")
    return todo.join(changes.where(F.col("change_type").isin("new", "updated")).select(*keys), keys, "left_anti")


def upsert_documents(stored: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """stored (kb, doc_id, path, content, content_hash, extracted, updated_at) with incoming (kb, path, content): hashes renewed, extracted reset."""
    fresh = incoming.select("kb", F.xxhash64("kb", "path").alias("doc_id"), "path", "content", content_hash(F.col("content")).alias("content_hash"), F.lit(False).alias("extracted"), now.alias("updated_at"))
    return stored.join(fresh.select("kb", "path"), ["kb", "path"], "left_anti").select(*stored.columns).unionByName(fresh)


def delete(table: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """table without the rows whose keys are in gone."""
    return table.join(gone.select(*on).distinct(), on, "left_anti").select(*table.columns)


def mark_extracted(docs: DataFrame, done: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """docs, marked where done (by, path) names them."""
    marks = done.select(*by, "path").distinct().withColumn("_done", F.lit(True))
    return docs.join(marks, [*by, "path"], "left").withColumn("extracted", F.col("extracted") | F.coalesce("_done", F.lit(False))).select(*docs.columns)


def latest(meta: DataFrame) -> DataFrame:
    """meta (key, value, at): the last value of each key."""
    return meta.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def to_embed(chunks: DataFrame, vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """Chunks without a vector of the right dimension."""
    good = vectors if dimension is None else vectors.where(F.size("embedding") == dimension)
    return chunks.join(good.select("chunk_id"), "chunk_id", "left_anti")


#: Versioned, idempotent changes of the documents table.
def migrate(docs: DataFrame, version: int) -> tuple[DataFrame, int]:
    if version < 1:
        docs = docs if "extracted" in docs.columns else docs.withColumn("extracted", F.lit(True))
        version = 1
    if version < 2:
        docs = docs.withColumn("extracted", F.lit(False))
        version = 2
    return docs, version
