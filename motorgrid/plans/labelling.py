"""Canonical labels, view labels and dataset splits written back to their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid.functions import labels
from motorgrid.functions.calc import generation_year
from motorgrid.operators import filters, splits
from motorgrid.operators.lookups import keep_existing
from motorgrid.operators.similarity import score_top_k
from motorgrid.session import cut_lineage


def canonicalize(listings: DataFrame, source: str | None = None,
                 rebuild: bool = False) -> DataFrame:
    """Fill canonical make, model and generation year of the selected rows; no shuffle."""
    chosen = F.lit(True)
    if source is not None:
        chosen = F.col("source") == source
    if not rebuild:
        chosen = chosen & (F.col("canonical_make").isNull() | F.col("generation_year").isNull())
    chosen = F.coalesce(chosen, F.lit(False))
    fresh = {
        "canonical_make": labels.normalize_make(F.col("make")),
        "canonical_model": labels.normalize_model(F.col("model")),
        "generation_year": generation_year(F.col("year")),
    }
    return listings.select(*[
        F.when(chosen, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c)
        for c in listings.columns])


def label_views(images: DataFrame, vectors: DataFrame, label_vectors: DataFrame,
                logit_scale: float, now: Column, rebuild: bool = False) -> DataFrame:
    """Best label and its softmax share over all labels, for images without one."""
    targets = images if rebuild else images.where("view is null")
    queries = vectors.join(targets.select("image_id"), "image_id", "left_semi").select(
        F.col("image_id").alias("query_id"), "embedding")
    protos = label_vectors.select(F.col("label").alias("class_id"), "prototype")
    best = score_top_k(queries, protos, 1, scale=logit_scale)
    picked = best.where(F.size("top_classes") > 0).select(
        F.col("query_id").alias("image_id"), F.get("top_classes", F.lit(0)).alias("_view"),
        F.exp(F.get("top_scores", F.lit(0)) * logit_scale - F.col("lse")).alias("_score"))
    joined = images.join(picked, "image_id", "left")
    new = {
        "view": F.coalesce("_view", "view"), "view_score": F.coalesce("_score", "view_score"),
        "view_labeled_at": F.when(F.col("_view").isNotNull(), now).otherwise(
            F.col("view_labeled_at")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in images.columns])


def check_fractions(train_frac: float, val_frac: float, min_group: int) -> None:
    """Shares of train and val, what is left for test, and the cell size must make sense."""
    shares = {"train": train_frac, "val": val_frac, "train and val": train_frac + val_frac}
    wrong = [name for name, share in shares.items() if not 0.0 <= share <= 1.0]
    if wrong or not shares["train and val"]:
        raise ValueError(f"shares out of range: {wrong or 'all zero'}")
    if min_group < 1:
        raise ValueError(f"cells need one image at least, not {min_group}")


def make_splits(images: DataFrame, listings: DataFrame, source: str, seed: int = 42,
                train_frac: float = 0.8, val_frac: float = 0.1, min_group: int = 10,
                coherent: bool = True, rebuild: bool = False,
                share: bool = False) -> dict[str, DataFrame]:
    """Assignment, report and the images table with its new splits.

    Use only the frames you need: without ``images`` it is a dry run. ``share`` writes the
    assignment to the checkpoint folder first, for when report and table are both wanted. With train + val = 1 the
    last listings of a cell may still become test, as the walk checks counts before adding.
    """
    check_fractions(train_frac, val_frac, min_group)
    options = (seed, train_frac, val_frac, min_group)
    if coherent:
        return _listing_splits(images, listings, source, options, rebuild, share)
    every = filters.eligible_for_split(images, listings, source)
    eligible = every.where("eligible").select("image_id", "listing_id", *splits.CELL)
    assigned = splits.assign_by_image(eligible, *options)
    if share:
        assigned = cut_lineage(assigned)
    excluded = _excluded(every.agg(F.count_if(~F.col("eligible")).alias("n")))
    return {
        "assigned": assigned,
        "report": splits.split_summary(assigned).unionByName(excluded),
        "images": keep_existing(
            images, assigned.select("image_id", "split"), "image_id", "split", rebuild),
    }


def _excluded(count: DataFrame) -> DataFrame:
    return count.select(
        F.lit("excluded").alias("metric"), F.lit(None).cast("string").alias("view"),
        F.lit(None).cast("string").alias("split"), "n")


def _listing_splits(images: DataFrame, listings: DataFrame, source: str, options: tuple,
                    rebuild: bool, share: bool) -> dict[str, DataFrame]:
    """Coherent splits: images are counted per listing and view, listings are decided at that grain,
    and images meet the decisions of their listing in one join."""
    counted = images.groupBy("listing_id", "view").agg(F.count("*").alias("_n"))
    every = filters.eligible_for_split(counted, listings, source)
    decided = splits.listing_splits(
        every.where("eligible").select("listing_id", *splits.CELL, "_n"), *options)
    # At most one decision per view of a listing.
    by_listing = decided.groupBy("listing_id").agg(
        F.first("_cell").alias("_cell"),
        F.map_from_entries(F.collect_list(F.struct(
            "_cell.view", F.struct("new_split", "small_cell")))).alias("_by_view"))
    if share:
        by_listing = cut_lineage(by_listing)
    met = images.join(by_listing, "listing_id", "left").withColumn(
        "_found", F.when(F.col("view").isNotNull(), F.try_element_at("_by_view", F.col("view"))))
    assigned = met.where("_found is not null").select(
        "image_id", *[F.col(f"_cell.{c}").alias(c) for c in splits.CELL if c != "view"], "view",
        F.col("_found.new_split").alias("split"), F.col("_found.small_cell").alias("small_cell"))
    new = F.col("_found.new_split")
    order = (new, F.col("split")) if rebuild else (F.col("split"), new)
    excluded = _excluded(every.agg(
        F.coalesce(F.sum(F.when(~F.col("eligible"), F.col("_n"))), F.lit(0)).alias("n")))
    return {
        "assigned": assigned,
        "report": splits.split_summary(assigned).unionByName(excluded),
        "images": met.select(*[
            F.coalesce(*order).alias(c) if c == "split" else F.col(c) for c in images.columns]),
    }
