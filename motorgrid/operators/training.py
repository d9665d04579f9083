"""Gate datasets, class spaces and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions.calc import binary_view_index, hash_split, view_index
from motorgrid.operators.lookups import flag_hard
from motorgrid.operators.skew import class_positions


def six_way_rows(images: DataFrame, split: str, min_score: float) -> DataFrame:
    """Confidently labelled images of a split with their view index; null index = unknown label."""
    kept = images.where(
        F.col("view").isNotNull() & (F.col("split") == split)
        & (F.col("view_score") >= min_score) & (F.col("local_path") != ""))
    return kept.select("image_id", "local_path", "view", view_index(F.col("view"))
                       .alias("class_idx"))


def six_way_dataset(images: DataFrame, split: str, min_score: float) -> DataFrame:
    return six_way_rows(images, split, min_score).where("class_idx is not null")


def unknown_label_count(images: DataFrame, split: str, min_score: float) -> DataFrame:
    return six_way_rows(images, split, min_score).agg(
        F.count("*").alias("n"), F.count_if(F.col("class_idx").isNull()).alias("n_unknown"))


def binary_dataset(images: DataFrame, split: str, min_score: float) -> DataFrame:
    """Exterior rows of the split and the non-exterior rows whose hash split equals it."""
    usable = images.where((F.col("view_score") >= min_score) & (F.col("local_path") != ""))
    exterior = usable.where(F.col("view").isin(*K.EXTERIOR_VIEWS) & (F.col("split") == split))
    other = usable.where(
        F.col("view").isin(*K.NON_EXTERIOR_VIEWS) & (hash_split(F.col("image_id")) == split))
    return exterior.unionByName(other).select(
        "image_id", "local_path", "view", binary_view_index(F.col("view")).alias("class_idx"))


def class_space(train: DataFrame, val: DataFrame) -> DataFrame:
    """Classes of train and val with a 0-based index in sort order."""
    classes = train.select("class_id").union(val.select("class_id")).distinct()
    return class_positions(classes, "class_id", "class_idx")


def val_only(train: DataFrame, val: DataFrame) -> DataFrame:
    return val.select("class_id").subtract(train.select("class_id"))


def hard_class_weights(classes: DataFrame, confusions: DataFrame, weight: float) -> DataFrame:
    """``weight`` for classes in any confusion pair, else 1."""
    if weight <= 0:
        raise ValueError("weight must be positive")
    return flag_hard(classes, confusions).withColumn(
        "weight", F.when(F.col("hard"), F.lit(float(weight))).otherwise(1.0)).drop("hard")
