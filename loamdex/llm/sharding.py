"""Sharding (operator 6): longest-processing-time scheduling.

Groups of equal texts stay together. Their sizes, largest first, go to
the least-loaded shard through a heap. Every size is exact, however many
there are.

The schedule depends on the histogram of group sizes alone. That has at
most sqrt(2 * total bytes) entries, since as many distinct sizes add up to
at least their number squared over two (14 million at 100 TB); one task
streams it, largest first, with nothing in memory but a heap of the
shards. A size that many groups have is dealt in closed form, which gives
what the heap would. The schedule is a table of runs of places in the
order (size descending, digest): run, shard. Groups are numbered in that
order by a range sort, and meet the runs in an equi join on blocks of
places, so no part of it is broadcast. Rows find their group by a shuffle
on its digest, but for groups that hold a large share of all rows: these
are few (at most four per partition) and are broadcast. Slots are places
within a shard, from a second range sort.

Defined results: a null text is an empty one (0 bytes, crc32 0) and both
form one group; equal sizes go by digest, equal loads to the lower shard;
repeated rows each get a slot; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamdex.operators.ranks import places

from ._common import materialise, shuffle_partitions, temporary

SHARDS, OVERHEAD = 40, 16
#: Places of one block of the join of groups and runs.
BLOCK = 256


class Schedule:
    """LPT over classes of equal groups, heaviest first; holds a load per shard."""

    def __init__(self, shards: int = SHARDS):
        self.heap = [(0, s) for s in range(shards)]

    def deal(self, weight: int, n: int) -> list[tuple[int, int]]:
        """(shard, groups) for n groups of one weight, by shard."""
        heap, got = self.heap, {}
        if weight > 0 and n > 4 * len(heap):
            got = self._level(weight, n)
            self.heap = heap = [(load + got.get(s, 0) * weight, s) for load, s in heap]
            heapq.heapify(heap)
        else:
            for _ in range(n):
                load, s = heap[0]
                got[s] = got.get(s, 0) + 1
                heapq.heapreplace(heap, (load + weight, s))
        return sorted(got.items())

    def _level(self, weight: int, n: int) -> dict[int, int]:
        """What n turns of the heap give: the n smallest (load before, shard) over all shards, by bisection of that load."""
        low, high = min(self.heap)[0], max(self.heap)[0] + weight * n

        def below(level: int) -> int:
            return sum(max(0, -(-(level - load) // weight)) for load, _ in self.heap)

        while high - low > 1:  # the highest level below which at most n turns start
            middle = (low + high) // 2
            low, high = (middle, high) if below(middle) <= n else (low, middle)
        got = {s: k for load, s in self.heap if (k := max(0, -(-(low - load) // weight)))}
        left = n - sum(got.values())
        for load, s in sorted(self.heap, key=lambda x: x[1]):
            if left and load + got.get(s, 0) * weight == low:
                got[s] = got.get(s, 0) + 1
                left -= 1
        return got


def _runs(shards: int):
    """The histogram (bytes, groups), largest first, to runs of places (first, end, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, at = Schedule(shards), 0
        for batch in batches:
            first, end, shard = [], [], []
            for size, n in zip(batch.column("bytes").to_pylist(), batch.column("groups").to_pylist(), strict=True):
                for s, k in schedule.deal(size, n):
                    first.append(at)
                    at += k
                    end.append(at)
                    shard.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(shard, pa.int32())], ["first", "end", "shard"])

    return run


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """A row per input row: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null)."""
    with temporary() as keep:
        out = places(_dealt(df, id_col, text_col, shards, overhead), ["shard"], ["doc_id", "text_crc32"], "slot", "shard-slots")
        keep(out)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _dealt(df: DataFrame, id_col: str, text_col: str, shards: int, overhead: int) -> DataFrame:
    """doc_id, size, text_crc32, shard."""
    n = shuffle_partitions(df.sparkSession)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("digest"))
    rows = materialise(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")).withColumn("light", -F.col("bytes"))
    groups = places(groups, [], ["light", "digest"], "place", "shard-groups")
    histogram = groups.groupBy("bytes").agg(F.count("*").alias("groups")).repartition(1).sortWithinPartitions(F.desc("bytes"))
    runs = materialise(histogram.mapInArrow(_runs(shards), "first long, end long, shard int"), "shard-runs")
    blocks = runs.withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(end - 1) div {BLOCK}"))))
    placed = groups.select("digest", "copies", "place", F.expr(f"place div {BLOCK}").alias("block")).join(blocks.hint("shuffle_merge"), "block").where("place >= first and place < end")
    assigned = materialise(placed.select("digest", "copies", "shard"), "shard-assigned")
    # groups that hold over a share of all rows are at most 4 * n
    hot = assigned.where(F.col("copies") > max(1000, rows.count() // (4 * n))).select("digest", "shard")
    light = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(assigned.select("digest", "shard").hint("shuffle_merge"), "digest")
    return rows.join(F.broadcast(hot), "digest").unionByName(light).select("doc_id", "size", "text_crc32", "shard")
