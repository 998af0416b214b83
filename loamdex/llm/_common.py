"""Shared by the operators: Arrow helpers and tables of the driver."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamdex.session import discard, materialise, scratch_dir, shuffle_partitions, table, temporary  # noqa: F401

#: Bytes of text that a worker holds as Python objects at a time.
SLICE_BYTES = 2_000_000


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each slice has about `limit` bytes of `column`; one long row is a slice of its own."""
    sizes = _lengths(batch.column(column))
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 64
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def held_out(doc_id):
    """The rows that no operator may learn from: crc32 of the id as text, mod 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About `rows` rows of each value of `key` by a hash of doc_id: two narrow scans, no shuffle of texts.

    The counts come from all rows; the hash threshold of each key value follows from them. Every value of
    `key` is sampled, and the driver holds a count of each."""
    counts = {tuple(r[k] for k in key): r["count"] for r in df.groupBy(*key).count().collect()}
    spread = 1 << 30
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    keep = []
    for values, n in counts.items():
        same = F.lit(True)
        for k, v in zip(key, values, strict=True):
            same = same & F.col(k).eqNullSafe(F.lit(v))
        keep.append(same & (hashed < F.lit(int(spread * min(1.0, rows / n)))))
    while len(keep) > 1:  # as a balanced tree, for many values
        keep = [reduce(or_, keep[i : i + 2]) for i in range(0, len(keep), 2)]
    return df.where(keep[0] if keep else F.lit(False))


def with_id(df: DataFrame, ddl: str, id_col: str = "doc_id"):
    """A schema: df's id column, then those of the DDL."""
    from pyspark.sql.types import StructType

    return StructType([df.schema[id_col], *StructType.fromDDL(ddl).fields])
