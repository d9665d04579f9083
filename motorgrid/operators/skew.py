"""Running totals over groups of any size.

A plain window sorts a whole group in one task, so a group with a third of the rows would bound
the job. Here each group is cut into buckets that follow the order, every (group, bucket) is
summed and windowed on its own, and only the small bucket totals are windowed per group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorgrid.session import store

# Hex digits of a hash used as bucket: 16**3 buckets per group.
HASH_BUCKET_DIGITS = 3


def hash_bucket(digest: Column) -> Column:
    return F.substring(digest, 1, HASH_BUCKET_DIGITS)


def cut_by_ranges(df: DataFrame, group: Iterable[str], order: Iterable, out: str = "_piece"
                  ) -> DataFrame:
    """Add the number of the range of (group, order) that a row lies in.

    Spark samples the ranges, so they hold like numbers of rows however the groups are sized and
    whatever values the order takes: only rows that are equal in all of it stay together. Ranges
    follow the order, which makes ``out`` a bucket for ``running_total``. The rows are written once:
    ranges that a lost task drew anew would not fit the others.
    """
    ranged = df.withColumn("_cell", F.struct(*group)).repartitionByRange("_cell", *order)
    return store(ranged.drop("_cell").withColumn(out, F.spark_partition_id()), "ranges")


def running_total(df: DataFrame, group: Iterable[str], order: Iterable, bucket: Column,
                  value: Column, before: str, total: str | None = None) -> DataFrame:
    """Add ``before``, the sum of ``value`` over earlier rows of the group, and the group total.

    ``order`` must be total within the group and ``bucket`` must not decrease along it. Adds the
    key columns ``_cell`` and ``_bucket``; rows stay partitioned by them.
    """
    # Structs are never null: null keys stay in (and sort first), and no branch gets a null filter
    # of its own, so the shuffle of ``df`` is done once and reused.
    staged = (
        df.withColumn("_cell", F.struct(*group))
        .withColumn("_bucket", F.struct(bucket.alias("b"))).withColumn("_value", value)
    )
    per_bucket = staged.groupBy("_cell", "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("_cell").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "_cell", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy("_cell")).alias("_total"),
    )
    local = Window.partitionBy("_cell", "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    joined = staged.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0))).join(
        offsets, ["_cell", "_bucket"])
    out = joined.withColumn(before, F.col("_offset") + F.col("_local"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_value", "_local", "_offset", "_total")


def group_minimum(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Minimum of ``value`` per ``_cell`` of a frame made by ``running_total``."""
    low = df.groupBy("_cell", "_bucket").agg(F.min(value).alias("_low"))
    spread = low.select(
        "_cell", "_bucket", F.min("_low").over(Window.partitionBy("_cell")).alias(out))
    return df.join(spread, ["_cell", "_bucket"])


def class_positions(keys: DataFrame, column: str, out: str, prefix: int = 8) -> DataFrame:
    """0-based rank of distinct strings in sort order, bucketed by their leading characters."""
    staged = keys.withColumn("_all", F.lit(1))
    ranked = running_total(
        staged, ["_all"], [column], F.substring(column, 1, prefix), F.lit(1), out)
    return ranked.drop("_all", "_cell", "_bucket")
