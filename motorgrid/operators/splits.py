"""Stratified train / val / test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions.calc import hash_split, round_half_even
from motorgrid.operators.skew import group_minimum, hash_bucket, running_total
from motorgrid.session import store

CELL = ("canonical_make", "canonical_model", "generation_year", "view")


def shuffle_key(seed: int, column: str) -> Column:
    """Order inside a cell: depends on the seed and the row's own id only."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), F.col(column)))


def assign_by_listing(rows: DataFrame, seed: int = 42, train_frac: float = 0.8,
                      val_frac: float = 0.1, min_group: int = 10) -> DataFrame:
    """image_id, split, small_cell: whole listings go to one split inside each cell.

    In hash order a listing is train while the images before it are fewer than the train target;
    then val while the images since that point are fewer than the val target; else test.
    """
    counts = rows.groupBy(*CELL, "listing_id").agg(F.count("*").alias("_n"))
    decided = listing_splits(counts, seed, train_frac, val_frac, min_group)
    return (
        rows.withColumn("_cell", F.struct(*CELL)).join(decided, ["_cell", "listing_id"])
        .select("image_id", *CELL, F.col("new_split").alias("split"), "small_cell")
    )


def listing_splits(counts: DataFrame, seed: int = 42, train_frac: float = 0.8,
                   val_frac: float = 0.1, min_group: int = 10) -> DataFrame:
    """_cell, listing_id, new_split and small_cell from the images ``_n`` per cell and listing."""
    ranked = running_total(
        counts.withColumn("_order", shuffle_key(seed, "listing_id")), CELL, ["_order", "listing_id"], hash_bucket(F.col("_order")), F.col("_n"),
        "_before", "_cell_n")
    train_goal = round_half_even(F.col("_cell_n") * train_frac)
    val_goal = round_half_even(F.col("_cell_n") * val_frac)
    ranked = group_minimum(
        ranked, F.when(F.col("_before") >= train_goal, F.col("_before")), "_val_start")
    split = (
        F.when((F.col("_cell_n") < min_group) | (F.col("_before") < train_goal), "train")
        .when(F.col("_before") - F.col("_val_start") < val_goal, "val").otherwise("test")
    )
    return ranked.select(
        "_cell", "listing_id", split.alias("new_split"),
        (F.col("_cell_n") < min_group).alias("small_cell"))


def assign_by_image(rows: DataFrame, seed: int = 42, train_frac: float = 0.8,
                    val_frac: float = 0.1, min_group: int = 10) -> DataFrame:
    """image_id, split, small_cell: every image on its own, by its rank in hash order."""
    staged = rows.withColumn("_order", shuffle_key(seed, "image_id"))
    ranked = running_total(
        staged, CELL, ["_order", "image_id"], hash_bucket(F.col("_order")), F.lit(1), "_before",
        "_cell_n")
    train_goal = round_half_even(F.col("_cell_n") * train_frac)
    val_goal = round_half_even(F.col("_cell_n") * val_frac)
    split = (
        F.when((F.col("_cell_n") < min_group) | (F.col("_before") < train_goal), "train")
        .when(F.col("_before") < train_goal + val_goal, "val").otherwise("test")
    )
    return ranked.select(
        "image_id", *CELL, split.alias("split"),
        (F.col("_cell_n") < min_group).alias("small_cell"))


def split_by_hash(df: DataFrame, key: str, out: str = "split") -> DataFrame:
    return df.withColumn(out, hash_split(F.col(key).cast("string")))


def cell_sizes(rows: DataFrame, min_group: int = 10) -> DataFrame:
    """Images per cell and whether the cell is too small to be split."""
    return rows.groupBy(*CELL).agg(F.count("*").alias("n")).withColumn(
        "small_cell", F.col("n") < min_group)


def split_summary(assigned: DataFrame) -> DataFrame:
    """Long report (metric, view, split, n): totals, view × split with zeros, small cells, p10."""
    # Every line of the report comes from these counts: one pass over the images writes them.
    counts = store(
        assigned.groupBy(*CELL, "split", "small_cell").agg(F.count("*").alias("n")), "cells")

    def n(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    grid = counts.groupBy("view").agg(*[n(F.col("split") == s).alias(s) for s in K.SPLITS])
    views = assigned.sparkSession.createDataFrame([(v,) for v in K.EXTERIOR_VIEWS], "view string")
    cells = views.join(grid, "view", "left").select(
        F.lit("view_split").alias("metric"), "view",
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("split"), F.coalesce(s, F.lit(0)).alias("n"))
            for s in K.SPLITS])).alias("_c"),
    ).select("metric", "view", "_c.split", "_c.n")
    totals = counts.agg(
        n(F.lit(True)).alias("eligible"),
        *[n(F.col("split") == s).alias(s) for s in K.SPLITS],
        n(F.col("small_cell")).alias("small_group"),
    )
    scalars = totals.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("n"))
        for name in ("eligible", *K.SPLITS, "small_group")])).alias("_c"))
    p10 = class_coverage(counts, F.sum("n")).select(
        F.lit("class_p10").alias("metric"), F.col("p10").alias("n"))
    flat = scalars.select("_c.metric", "_c.n").unionByName(p10).select(
        "metric", F.lit(None).cast("string").alias("view"),
        F.lit(None).cast("string").alias("split"), F.col("n").cast("bigint").alias("n"))
    return flat.unionByName(cells)


def class_coverage(rows: DataFrame, size: Column | None = None, pct: float = 0.1) -> DataFrame:
    """Nearest-rank percentile of the per-class image counts; 0 without classes."""
    counts = rows.groupBy(*CELL[:3]).agg(
        (F.count("*") if size is None else size).alias("n"))
    return counts.agg(F.coalesce(
        F.expr(f"percentile_disc({pct}) within group (order by n)").cast("bigint"),
        F.lit(0)).alias("p10"))
