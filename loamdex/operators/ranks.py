"""Places of rows in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamdex.session import materialise, shuffle_partitions

#: Counts of (partition, group) that are broadcast; more are joined by shuffle.
BROADCAST_COUNTS = 500_000


def places(df: DataFrame, group: list[str], order: list, into: str, name: str) -> DataFrame:
    """df, materialised, with column `into`: its rows numbered from 0 without gaps within `group`, in `order` (names or columns).

    The rows are range-sorted by (group, order) and written with a running number; a row's
    place is its number less its partition's first of that group, plus what earlier
    partitions hold. Only a count per (partition, group) is gathered: at most a row for
    each group and partition boundary, so with many groups it is joined by shuffle."""
    n = shuffle_partitions(df.sparkSession)
    df = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    df = materialise(df.withColumn("_n", F.monotonically_increasing_id()).withColumn("_p", F.spark_partition_id()), name)
    counts = df.groupBy("_p", *group).agg(F.min("_n").alias("_first"), F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_p", *group, "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    counts = F.broadcast(counts) if not group or counts.limit(BROADCAST_COUNTS + 1).count() <= BROADCAST_COUNTS else counts
    counts = counts.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first", "_before")
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = df.join(counts, same).withColumn(into, F.col("_n") - F.col("_first") + F.col("_before")).select(*df.drop("_n", "_p").columns, into)
    out._scratch = df._scratch
    return out
