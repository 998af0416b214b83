"""Session helpers: table reads and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MARKED: set[str] = set()
_OPEN = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's tables; sf_dir may be any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, local mode has one of its own; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="loamdex-")
    return _LOCAL[app]


def file_system(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, and its Path class."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def app_scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's JVM exits."""
    folder = f"{scratch_dir(spark)}/loamdex/{spark.sparkContext.applicationId}"
    if folder not in _MARKED:
        fs, path = file_system(spark, folder)
        fs.mkdirs(path(folder))
        fs.deleteOnExit(path(folder))
        _MARKED.add(folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back.

    Unlike localCheckpoint the copy outlives any executor, and unlike
    checkpoint() it is columnar, so later reads prune columns."""
    spark = df.sparkSession
    path = f"{app_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for scope in getattr(_OPEN, "scopes", [])[-1:]:
        scope.append(out)
    return out


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialised within are deleted at the end, but for those given to the function it yields."""
    _OPEN.scopes = [*getattr(_OPEN, "scopes", []), []]
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        *_OPEN.scopes, scope = _OPEN.scopes
        paths = {df._scratch for df in kept}
        discard(*(df for df in scope if df._scratch not in paths))
        for outer in _OPEN.scopes[-1:]:  # what is kept belongs to the scope around this one
            outer.extend(df for df in scope if df._scratch in paths)


@contextmanager
def permanent() -> Iterator[None]:
    """Tables materialised within belong to no scope around them."""
    _OPEN.scopes = [*getattr(_OPEN, "scopes", []), []]
    try:
        yield
    finally:
        _OPEN.scopes = _OPEN.scopes[:-1]


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no plan still to be run reads."""
    for df in tables:
        folder = getattr(df, "_scratch", None)
        if folder:
            fs, path = file_system(df.sparkSession, folder)
            fs.delete(path(folder), True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
