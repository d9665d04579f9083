"""Grouped counts and distributions over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions.labels import class_id


def class_train_counts(images: DataFrame, listings: DataFrame) -> DataFrame:
    """Training images per class, summed over sources; counts per listing join first."""
    per_listing = images.where("split = 'train'").groupBy("listing_id").agg(
        F.count("*").alias("_n"))
    classes = listings.select("listing_id", class_id(
        F.col("generation_year"), F.col("canonical_make"), F.col("canonical_model"))
        .alias("class_id")).where("class_id is not null")
    return per_listing.join(classes, "listing_id").groupBy("class_id").agg(
        F.sum("_n").alias("n_train"))


def split_count(images: DataFrame, listings: DataFrame, source: str, split: str) -> DataFrame:
    chosen = listings.where(F.col("source") == source).select("listing_id")
    return images.where(F.col("split") == split).join(chosen, "listing_id", "left_semi").agg(
        F.count("*").alias("n"))


def make_distribution(listings: DataFrame) -> DataFrame:
    return listings.groupBy("canonical_make").agg(F.count("*").alias("n"))


def make_coverage(listings: DataFrame) -> DataFrame:
    return listings.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("canonical_make").alias("n_makes"),
        F.count_if(F.col("canonical_make").isNull()).alias("n_null"),
    )


def view_distribution(images: DataFrame) -> DataFrame:
    """Rows and percent per view. The share is taken over the few per-view rows."""
    counts = images.groupBy("view").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(every))


def confusion_matrix(rows: DataFrame, true_col: str, pred_col: str, classes: list) -> DataFrame:
    """Square matrix: one row per true class, one column per predicted class, zeros included."""
    grid = rows.groupBy(true_col).pivot(pred_col, classes).count()
    index = rows.sparkSession.createDataFrame([(c,) for c in classes], f"{true_col} int")
    return index.join(grid, true_col, "left").select(
        true_col, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}") for c in classes])


def accuracy(rows: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Rows, hits and accuracy; 0 when there are no rows."""
    hit = F.count_if(F.col(true_col) == F.col(pred_col))
    return rows.agg(
        F.count("*").alias("n"), hit.alias("n_correct"),
        F.coalesce(F.try_divide(hit, F.count("*")), F.lit(0.0)).alias("accuracy"))


def reason_audit(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows per outcome; a null reason is ``inserted``."""
    return rows.groupBy(F.coalesce(reason, F.lit("inserted")).alias("outcome")).agg(
        F.count("*").alias("n"))


def count_by_class(rows: DataFrame, column: str, n_classes: int) -> DataFrame:
    """Rows per class index 0..n-1, zeros included."""
    index = rows.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class_idx"))
    counts = rows.groupBy(F.col(column).cast("int").alias("class_idx")).agg(
        F.count("*").alias("_n"))
    return index.join(counts, "class_idx", "left").select(
        "class_idx", F.coalesce("_n", F.lit(0)).alias("n"))


def inverse_sqrt_weights(counts: DataFrame) -> DataFrame:
    """1/sqrt(n) weights scaled to mean 1; an unseen class gets 0, all-unseen classes get 1.

    Works on the table of classes, one row per index of a fixed range.
    """
    every = Window.partitionBy(F.lit(0))
    raw = F.when(F.col("n") > 0, 1.0 / F.sqrt("n")).otherwise(0.0)
    staged = counts.withColumn("_raw", raw).withColumn("_sum", F.sum("_raw").over(every))
    weight = F.when(F.col("_sum") <= 0, 1.0).otherwise(
        F.col("_raw") * F.count("*").over(every) / F.col("_sum"))
    return staged.withColumn("weight", weight).drop("_raw", "_sum")


def status_counts(queue: DataFrame, source: str | None = None,
                  by: tuple[str, ...] = ()) -> DataFrame:
    """One column per queue status, zeros included."""
    if source is not None:
        queue = queue.where(F.col("source") == source)
    return queue.groupBy(*by).agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in K.QUEUE_STATUSES])
