"""Table access and shared-folder helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorgrid.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# Rows of one Arrow batch: texts may be long, so batches are counted in few rows.
BATCH_ROWS = 512
BATCH_BYTES = 32 * 2**20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, and Spark knows the size.

    The files are complete before anything reads them, so a lost executor costs only its own tasks.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def drop_rows(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` without the rows whose keys (null safe) are in ``dropped``; columns stay as they are.

    Sort-merge at every size: AQE may split it, and the plan does not change as the lists grow.
    """
    gone = dropped.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct()
    match = F.lit(True)
    for k in keys:
        match = match & docs[k].eqNullSafe(gone[f"_gone_{k}"])
    return docs.join(gone.hint("merge"), match, "left_anti")


def regroup(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, for operators on slim columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
