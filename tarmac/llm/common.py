"""Helpers shared by the corpus operators: shared storage, tables, text keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side is measured first and must not exceed this many rows.
BROADCAST_ROWS = 200_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on this machine (tests) a folder of
    our own is used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tarmac_root", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarmac-shared-")
        spark._tarmac_root = root
    return root


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the application's JVM ends."""
    path = f"{shared_root(spark)}/tarmac/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_shared(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def in_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Actions inside hand Python workers at most ``size`` bytes at a time (or one row)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` (a written table) has at most ``limit`` rows.

    Beyond the bound the plan stays a shuffle join, which AQE splits where skewed.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_counted(rows: DataFrame, counted: DataFrame, keys: dict[str, str], times: str, hot: int = 10_000) -> DataFrame:
    """``rows`` joined with ``counted`` (a written table) on ``keys`` {column of rows: column of counted}.

    ``times`` says how often a key occurs in ``rows``.  A small ``counted`` is broadcast.
    Else the keys that occur ``hot`` times or more, at most a ``hot``-th of all rows,
    are broadcast where their measured number allows, so that no task gets all rows of
    one, and the rest meet in a shuffle.
    """
    on = lambda c: reduce(lambda a, b: a & b, [rows[x] == c[y] for x, y in keys.items()])
    if counted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counted), on(counted))
    often, seldom = counted.where(F.col(times) >= hot), counted.where(F.col(times) < hot)
    if often.isEmpty():
        return rows.join(counted, on(counted))
    often = small(often)
    cold = rows.join(often, on(often), "left_anti")
    cold = cold.join(seldom, reduce(lambda a, b: a & b, [cold[x] == seldom[y] for x, y in keys.items()]))
    return cold.unionByName(rows.join(often, on(often)))


def digest(c: Column) -> Column:
    """A 128-bit key of a string, as 16 bytes."""
    return F.unhex(F.md5(c))


def text_of(c: Column | str) -> Column:
    """The text itself; null counts as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    parts = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")
