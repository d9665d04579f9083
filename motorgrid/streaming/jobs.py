"""Streaming forms of smoothing, queue folding and ingest dedupe.

Each job keeps a keyed state (``streaming.state``) and appends its rows to Parquet files under
``folder/out`` by Spark's file sink, which a replayed batch does not double. What a batch costs depends
on the keys in it, not on the history. Rows must arrive in event order between batches; inside a batch
any order will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from motorgrid import constants as K
from motorgrid.functions import text
from motorgrid.operators.live import mode_vote
from motorgrid.streaming.state import (
    PackedPredictions, QueueRow, RecentPredictions, first_of_batch, keyed, use_rocksdb,
)

_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
# Slots that say nothing for so long start anew.
SLOT_TTL_MS = 24 * 3600 * 1000


def read_stream(spark: SparkSession, directory: str, like: DataFrame, name: str = "*.parquet",
                files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of ``like``."""
    return (
        spark.readStream.schema(like.schema).option("pathGlobFilter", name)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
        .parquet(directory)
    )


def _run(rows: DataFrame, folder: str, continuous: str | None, *by: str) -> StreamingQuery:
    # A clock calls for batches without rows, for timers that no job here sets: they would never end.
    conf = rows.sparkSession.conf
    usual = conf.get(_NO_DATA)
    conf.set(_NO_DATA, "false")
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/offsets")
    if by:
        writer = writer.partitionBy(*by)
    writer = writer.trigger(processingTime=continuous) if continuous \
        else writer.trigger(availableNow=True)
    try:
        return writer.start()
    finally:
        conf.set(_NO_DATA, usual)


def smooth_stream(stream: DataFrame, folder: str, window: int = K.SMOOTHING_WINDOW,
                  continuous: str | None = None, ttl_ms: int | None = SLOT_TTL_MS) -> StreamingQuery:
    """Votes per input row under ``folder/out/late=false``.

    Rows that come after later ones of their slot, in a later batch, are the side output: they stand
    without a vote under ``folder/out/late=true``. The state is the last rows of every slot.
    """
    names = stream.columns
    schema = T.StructType([*stream.schema.fields]).add("late", "boolean").add("_n", "integer")
    for k in range(window):
        for name, kind in RecentPredictions.HISTORY.items():
            schema = schema.add(f"_{name}{k}", kind)
    held = keyed(stream.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "slot",
                 PackedPredictions(window, ttl_ms, stream.schema["slot"].dataType), schema,
                 expires=ttl_ms is not None)
    oldest_first = F.array(*[F.struct(*[
        F.col(f"_{name}{k}").alias(name) for name in RecentPredictions.HISTORY]) for k in reversed(range(window))])
    history = F.slice(oldest_first, F.lit(window + 1) - F.col("_n"), F.col("_n"))
    vote = F.when(~F.col("late"), text.let(history, mode_vote))
    voted = held.withColumn("_vote", vote).select(
        *names, F.col("_vote.label").alias("smoothed_label"),
        F.col("_vote.class_id").alias("smoothed_class_id"),
        F.col("_vote.confidence").alias("smoothed_confidence"), "late")
    return _run(voted, folder, continuous, "late")


def smoothed_rows(spark: SparkSession, folder: str, late: bool = False) -> DataFrame:
    """The rows that ``smooth_stream`` wrote: those with votes, or the late ones."""
    return spark.read.parquet(f"{folder}/out").where(F.col("late") == late).drop("late")


def _micros(name: str) -> Column:
    return F.timestamp_micros(F.col(name))


def queue_stream(stream: DataFrame, folder: str, start: DataFrame,
                 continuous: str | None = None) -> StreamingQuery:
    """The queue rows that a batch of events changed, under ``folder/out``.

    ``start`` is the queue before the first event; it is written to ``folder/start`` once and ignored
    when the job is started again. ``latest_state`` makes the queue out of both.
    """
    spark = stream.sparkSession
    try:
        start = spark.read.parquet(f"{folder}/start")
    except AnalysisException:
        start.write.parquet(f"{folder}/start")
        start = spark.read.parquet(f"{folder}/start")
    first = start.select(
        "url", "source", "kind", "status", "attempts", "last_error",
        F.unix_micros("next_try_at").alias("next_us"), F.unix_micros("enqueued_at").alias("enqueued_us"),
        F.unix_micros("claimed_at").alias("claimed_us"), F.lit(0).cast("bigint").alias("changes"))
    events = stream.select("url", "source", "kind", "action", "error", F.unix_micros(
        F.col("ts").cast("timestamp")).alias("us"), "seq")
    changed = keyed(events, "url", QueueRow(), f"url string, {QueueRow.SCHEMA}", first)
    return _run(changed, folder, continuous)


def latest_state(spark: SparkSession, folder: str, query: StreamingQuery | None = None) -> DataFrame:
    """The queue after the batches so far: the start, and the last change of every changed URL."""
    if query is not None and query.isActive:
        raise RuntimeError("the query is still running")
    start = spark.read.parquet(f"{folder}/start")
    changes = spark.read.schema(f"url string, {QueueRow.SCHEMA}").parquet(f"{folder}/out")
    last = changes.groupBy("url").agg(F.max_by(
        F.struct(*[c for c in changes.columns if c != "url"]), "changes").alias("_c"))
    moved = {
        **{c: F.col(f"_c.{c}") for c in ("source", "kind", "status", "attempts", "last_error")},
        "next_try_at": _micros("_c.next_us"), "enqueued_at": _micros("_c.enqueued_us"),
        "claimed_at": _micros("_c.claimed_us")}
    joined = start.join(last, "url", "full_outer")
    return joined.select(*[
        F.when(F.col("_c").isNotNull(), moved[c]).otherwise(F.col(c)).alias(c) if c in moved
        else F.col(c) for c in start.columns])


def dedupe_within(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Drop repeats of a key that come within ``delay``; state is bounded by the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def ingest_stream(stream: DataFrame, folder: str, key: str, order: list[str],
                  continuous: str | None = None) -> StreamingQuery:
    """Exact dedupe over all batches, under ``folder/out``: of each key the first row by ``order`` of
    the first batch that has it. A batch is reduced to one row per key, then Spark's own set of keys seen is
    asked for these keys only."""
    use_rocksdb(stream.sparkSession)
    return _run(first_of_batch(stream, key, order).dropDuplicates([key]), folder, continuous)
