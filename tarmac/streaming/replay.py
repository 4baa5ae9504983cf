"""Streams replayed to their end: a table as a file source in several micro-batches, folded, and what they put out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.sources.graphs import parse_pings
from tarmac.sources.shared import kept, shared_folder
from tarmac.streaming.edges import ROCKSDB, Changes, Cursor, Density, Fold, Multiplier, Strikes, folded

#: A replay comes in this many micro-batches, in order of event ids.
BATCHES = 4


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def in_batches(rows: DataFrame, folder: str, batches: int = BATCHES) -> Iterator[int]:
    """Put ``rows`` into ``folder`` micro-batch by micro-batch, oldest first: equal ranges of ``event_id``, as many
    files as their tasks write.  Between two of them the stream takes up what is there."""
    rows = kept(rows, "replay")  # made once for all batches
    top = rows.agg(F.max("event_id")).first()[0]
    number = F.floor(F.col("event_id") * batches / F.lit((top or 0) + 1)).cast("int")
    for k in range(batches):
        rows.where(number == k).write.mode("append").parquet(folder)
        yield k


def in_files(rows: DataFrame, folder: str, batches: int = BATCHES) -> None:
    """Write ``rows`` as one file per micro-batch, oldest first: equal ranges of ``event_id``."""
    top = rows.agg(F.max("event_id")).first()[0]
    named = rows.withColumn("_b", F.floor(F.col("event_id") * batches / F.lit((top or 0) + 1)).cast("int"))
    for k in range(batches):
        named.where(F.col("_b") == k).drop("_b").coalesce(1).write.mode("append").parquet(folder)


def streamed(spark: SparkSession, folder: str, schema, transform: Callable[[DataFrame], DataFrame], files: int | None = 1) -> DataFrame:
    """What the stream over ``folder/in`` has put out once it has caught up, with its ``batch``.

    A micro-batch is ``files`` files, or all that are new (None).  Each batch is written under its number, so one that is
    done again after a failure replaces itself; a new call goes on from the checkpoint.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with rocksdb(spark):
        source = spark.readStream.schema(schema)
        run = transform((source if files is None else source.option("maxFilesPerTrigger", files)).parquet(f"{folder}/in")).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def caught_up(spark: SparkSession, rows: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream has put out once all of ``rows`` has come in, in BATCHES micro-batches."""
    folder, out = shared_folder(spark, "stream"), None
    for _ in in_batches(rows, f"{folder}/in"):
        out = streamed(spark, folder, rows.schema, transform, files=None)
    return out


def replayed(spark: SparkSession, rows: DataFrame, key: str, processor: Fold) -> DataFrame:
    """All of ``rows`` through the stream, then each key's newest output row."""
    return newest(caught_up(spark, rows, lambda s: folded(s, key, processor)), key)


def newest(out: DataFrame, key: str) -> DataFrame:
    names = [c for c in out.columns if c not in (key, "batch")]
    return out.groupBy(key).agg(F.max(F.struct("batch", *names)).alias("n")).select(key, *[F.col(f"n.{c}").alias(c) for c in names])


def multipliers(spark: SparkSession, events: DataFrame) -> DataFrame:
    return replayed(spark, events.where("ratio > 0").select("edge_id", "us", "event_id", "ratio", "alpha"), "edge_id", Multiplier())


def densities(spark: SparkSession, events: DataFrame) -> DataFrame:
    return replayed(spark, events.where("delta IS NOT NULL").select("edge_id", "us", "event_id", "delta"), "edge_id", Density())


def last_steps(spark: SparkSession, pings: DataFrame) -> DataFrame:
    return replayed(spark, pings.select("session_id", "us", "event_id", "reported", "last_step"), "session_id", Cursor())


def strikes(spark: SparkSession, pings: DataFrame) -> DataFrame:
    return replayed(spark, pings.select("session_id", "us", "event_id", "off_m"), "session_id", Strikes())


def changes(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Reported changes: ``batch, edge_id, old_multiplier, new_multiplier``."""
    rows = events.select("edge_id", "us", "event_id", "ratio", "alpha", "delta")
    return caught_up(spark, rows, lambda s: folded(s, "edge_id", Changes())).withColumn("batch", F.col("batch").cast("long"))


def pending(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Edges with a new observation, each once per micro-batch: ``batch, edge_id``.  A batch that is repeated replaces its hand-over."""
    return caught_up(spark, events.where("ratio > 0").select("edge_id", "event_id"), lambda s: s.select("edge_id")).distinct()


def pings(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Ping messages of a stream of text (``event_id, value``)."""
    return caught_up(spark, lines, lambda s: parse_pings(s.select("value"))).drop("batch")
