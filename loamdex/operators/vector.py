"""Nearest neighbours over embedding columns."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: What a task of knn_batch() holds or does at most: bytes of queries, vectors that it reads, pairs of both.
BLOCK_BYTES, PART_ROWS, PART_PAIRS = 64_000_000, 1_000_000, 10_000_000_000
#: Vectors that it compares at a time, at first and later, and products of them with queries.
FIRST_ROWS, MOST_ROWS, PRODUCTS = 256, 4096, 2_000_000
#: Squares from which products may overflow; such pairs get their distance at once.
HUGE = 1e300
_NONE = 1 << 62


class DimensionError(ValueError):
    pass


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal size."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def knn(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, distance, score) of the k nearest. The query is a literal, so this is one scan and a top k.

    A null vector, or one of another dimension, is no neighbour."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    fits = vectors.where(F.size(embedding) == len(query))
    hits = fits.select(key, F.round(l2(F.col(embedding), wanted), 6).alias("distance"))
    return hits.orderBy("distance", key).limit(k).withColumn("score", F.round(1.0 / (1.0 + F.col("distance")), 6))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", embedding: str = "embedding", qid: str = "qid", qvec: str = "qvec", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(qid, key, distance, rank): the k nearest of every query, exactly.

    Blocks of queries meet parts of the vectors, a pair to a task: the task holds its queries and their k best so far, at most
    broadcast_rows of these and BLOCK_BYTES of queries, and reads its vectors once, in the order of their keys. Matrix products
    say which pairs can be among the best; only these get a distance, the same that l2() gives.
    A vector or query that is null or holds a null has no neighbours; those of another dimension than the query's are none."""
    import pyarrow as pa

    spark = vectors.sparkSession
    asked = queries.agg(F.count("*"), F.max(F.size(qvec))).first()
    wide = max(asked[1] or 0, 1)
    step = max(1, min(broadcast_rows // max(k, 1), BLOCK_BYTES // (8 * wide)))
    blocks = max(1, -(-asked[0] // step))
    n = vectors.count()
    parts = max(-(-2 * spark.sparkContext.defaultParallelism // blocks), -(-n // PART_ROWS), -(-n * min(asked[0], step) // PART_PAIRS))
    held = {vectors.schema[embedding].dataType.simpleString(), queries.schema[qvec].dataType.simpleString()}
    numbers = "array<float>" if held == {"array<float>"} else "array<double>"
    key_type, qid_type = vectors.schema[key].dataType, queries.schema[qid].dataType

    def spread(of: int, *columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(of)).cast("int")

    def every(of: int):
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    left = queries.where(F.col(qvec).isNotNull()).withColumn("_part", every(parts))
    left = left.select((spread(blocks, qid, qvec) * parts + F.col("_part")).alias("cell"), F.lit(False).alias("is_vector"), F.lit(None).cast(key_type).alias("key"), F.col(qid).alias("qid"), F.col(qvec).cast(numbers).alias("v"))
    right = vectors.where(F.col(embedding).isNotNull()).withColumn("_block", every(blocks))
    right = right.select((F.col("_block") * parts + spread(parts, key, embedding)).alias("cell"), F.lit(True).alias("is_vector"), F.col(key).alias("key"), F.lit(None).cast(qid_type).alias("qid"), F.col(embedding).cast(numbers).alias("v"))
    cells = left.unionByName(right).repartitionById(blocks * parts, "cell").sortWithinPartitions("is_vector", "key").drop("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, searches = [], None
        for batch in batches:
            at = batch.column("is_vector").true_count
            if at < batch.num_rows:  # queries come first
                held.append(batch.slice(0, batch.num_rows - at))
            if not at:
                continue
            if searches is None:
                searches = _searches(held, k)
                held = []
            batch = batch.slice(batch.num_rows - at)
            for width, rows, matrix in _matrices(batch.column("v")):
                if width in searches:
                    searches[width][1].add(batch.column("key").take(rows), matrix)
        for ids, search in (searches or {}).values():
            if not search.seen:
                continue
            row, distance, keys = search.found()
            yield pa.RecordBatch.from_arrays([ids.take(row), keys, distance], ["qid", "key", "distance"])

    schema = StructType([StructField("qid", qid_type), StructField("key", key_type), StructField("distance", DoubleType())])
    pairs = cells.mapInArrow(run, schema).select(F.col("qid").alias(qid), F.round("distance", 6).alias("distance"), F.col("key").alias(key))
    # Catalyst turns this into a group limit below the shuffle: each task sends k rows per query at most
    rank = F.row_number().over(Window.partitionBy(qid).orderBy("distance", key))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _matrices(column):
    """(dimension, rows, matrix of doubles) for each dimension of an Arrow array of lists, without lists that hold a null."""
    import pyarrow as pa

    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    ends = np.cumsum(widths, dtype=np.int64)
    whole = np.ones(len(widths), bool)
    if flat.null_count:
        holes = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
        whole = holes[ends] == holes[ends - widths]
        flat = flat.fill_null(0.0)
    values = flat.to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(whole & (widths == width))
        places = (ends[rows] - width)[:, None] + np.arange(width)
        if len(rows):
            yield width, pa.array(rows), values[places].astype(np.float64)


def _searches(batches: list, k: int) -> dict:
    """By dimension, the queries' ids and what searches for them."""
    import pyarrow as pa

    ids, matrices = defaultdict(list), defaultdict(list)
    for batch in batches:
        for width, rows, matrix in _matrices(batch.column("v")):
            ids[width].append(batch.column("qid").take(rows))
            matrices[width].append(matrix)
    return {width: (pa.concat_arrays(ids[width]), _Nearest(np.concatenate(matrices[width]), k)) for width in ids}


def _six(x: np.ndarray) -> np.ndarray:
    """x rounded as Spark rounds it: half up, of the shortest decimal."""
    out, scaled = x.copy(), x * 1e6
    with np.errstate(invalid="ignore"):
        near = np.floor(scaled + 0.5) / 1e6
        sure = (scaled < 2.0**50) & (np.abs(scaled - np.floor(scaled) - 0.5) > scaled * 2.0**-50)
    out[sure] = near[sure]
    for i in np.flatnonzero(~sure & np.isfinite(x)).tolist():
        out[i] = x[i] if x[i] >= 2.0**53 else float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


class _Nearest:
    """The k nearest of each query among the vectors added so far; of equal distances the one that came first."""

    def __init__(self, queries: np.ndarray, k: int):
        n, width = queries.shape
        self.k, self.seen, self.keys = k, 0, []
        self.columns = np.ascontiguousarray(queries.T)
        with np.errstate(all="ignore"):
            self.squares = np.einsum("ij,ij->i", queries, queries)
        self.left = np.concatenate((-2.0 * queries, np.ones((n, 1))), axis=1)
        self.odd = ~(self.squares < HUGE)
        # by query: distances as they are and rounded, places of the vectors; _NONE where there is none yet
        self.raw, self.rounded, self.place = np.full((n, k), np.nan), np.full((n, k), np.nan), np.full((n, k), _NONE)
        # of sums of `width` products, in parts of (|query| + |vector|) squared
        self.slip = 8 * (width + 8) * np.finfo(np.float64).eps

    def add(self, keys, vectors: np.ndarray) -> None:
        self.keys.append(keys)
        i = 0
        while i < len(vectors):  # few first: the more are seen, the fewer come near
            size = min(max(FIRST_ROWS, self.seen), MOST_ROWS)
            self._slice(vectors[i : i + size])
            i += size

    def _slice(self, x: np.ndarray) -> None:
        if not self.k:
            return
        with np.errstate(all="ignore"):
            squares = np.einsum("ij,ij->i", x, x)
            right = np.concatenate((x, squares[:, None]), axis=1).T
            odd = np.flatnonzero(~(squares < HUGE))
            most = np.sqrt(squares.max())
            columns = np.ascontiguousarray(x.T)
            step = max(1, PRODUCTS // len(x))
            for a in range(0, len(self.squares), step):
                b = min(a + step, len(self.squares))
                near = self.left[a:b] @ right  # the squared distance, less the query's square
                slip = self.slip * (np.sqrt(self.squares[a:b]) + most) ** 2
                # a distance must round to less than the k-th so far
                worst = self.rounded[a:b, -1]
                bound = worst * (1 + 1e-12) - 4e-7
                limit = np.where(bound < 0, -np.inf, bound * bound + slip - self.squares[a:b])
                new = np.flatnonzero(np.isnan(worst))
                if len(new) and len(x) > self.k:
                    # no k-th yet: as near as the slice's own k-th
                    kth = np.partition(near[new], self.k - 1, axis=1)[:, self.k - 1] + self.squares[a:b][new] + slip[new]
                    limit[new] = kth + 2e-6 * np.sqrt(np.maximum(kth, 0)) + 1e-12 + slip[new] - self.squares[a:b][new]
                limit[np.isnan(limit) | self.odd[a:b]] = np.inf
                hit = near <= limit[:, None]
                hit[self.odd[a:b]] = True
                hit[:, odd] = True
                hit = np.flatnonzero(hit)
                if len(hit):
                    self._keep(a + hit // len(x), hit % len(x), columns)
        self.seen += len(x)

    def _keep(self, query: np.ndarray, row: np.ndarray, columns: np.ndarray) -> None:
        """The distances of pairs, summed in the order of the dimensions; the k best of each query stay."""
        total = np.zeros(len(query))
        for x, q in zip(columns, self.columns, strict=True):
            part = x.take(row)
            part -= q.take(query)
            part *= part
            total += part
        raw = np.sqrt(total)
        known = np.unique(query)
        old = self.place[known] != _NONE
        query = np.concatenate((np.repeat(known, old.sum(1)), query))
        place = np.concatenate((self.place[known][old], row + self.seen))
        rounded = np.concatenate((self.rounded[known][old], _six(raw)))
        raw = np.concatenate((self.raw[known][old], raw))
        order = np.lexsort((place, rounded, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, rank, query = order[rank < self.k], rank[rank < self.k], query[rank < self.k]
        self.place[query, rank], self.rounded[query, rank], self.raw[query, rank] = place[order], rounded[order], raw[order]

    def found(self):
        """(rows of queries, distances not rounded, keys), as Arrow arrays."""
        import pyarrow as pa

        held = self.place != _NONE
        return pa.array(np.nonzero(held)[0]), pa.array(self.raw[held]), pa.concat_arrays(self.keys).take(pa.array(self.place[held]))


def check_dimension(vectors: DataFrame, dimension: int, embedding: str = "embedding") -> DataFrame:
    """The vectors that have the dimension; the others must be embedded again."""
    return vectors.where(F.size(embedding) == dimension)
