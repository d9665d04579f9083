"""Accuracy, breakdowns, confusions and parity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions.labels import display_name
from motorgrid.functions.vectors import cosine


def mark_hits(scored: DataFrame, true_col: str = "true_class",
              ks: Iterable[int] = K.TOP_KS) -> DataFrame:
    """Add ``pred_class``, ``true_rank`` (null = not retrieved) and ``hit_<k>``."""
    rank = F.array_position("top_classes", F.col(true_col))
    marked = scored.withColumn("pred_class", F.get("top_classes", F.lit(0))).withColumn(
        "true_rank", F.when(rank > 0, rank))
    for k in ks:
        marked = marked.withColumn(f"hit_{k}", F.coalesce(F.col("true_rank") <= k, F.lit(False)))
    return marked


def _hit_sums(ks: Iterable[int]) -> list[Column]:
    return [F.count_if(f"hit_{k}").alias(f"top_{k}") for k in ks]


def overall(marked: DataFrame, ks: Iterable[int] = K.TOP_KS) -> DataFrame:
    """n, hits and accuracy per k in one row."""
    ks = tuple(ks)
    sums = marked.agg(F.count("*").alias("n"), *_hit_sums(ks))
    return sums.select("*", *[
        F.coalesce(F.try_divide(F.col(f"top_{k}"), F.col("n")), F.lit(0.0)).alias(f"acc_{k}")
        for k in ks])


def breakdown(marked: DataFrame, ks: Iterable[int] = K.TOP_KS) -> DataFrame:
    """Overall and per make, view and era in one pass: columns facet, key, n, top_k."""
    ks = tuple(ks)
    facets = ("make", "view", "era")
    filled = marked.select(
        *[F.coalesce(f, F.lit(K.UNKNOWN)).alias(f) for f in facets], *[f"hit_{k}" for k in ks])
    grouped = filled.groupingSets([[], ["make"], ["view"], ["era"]], *facets).agg(
        F.grouping_id().alias("_gid"), F.count("*").alias("n"), *_hit_sums(ks))
    facet = (
        F.when(F.col("_gid") == 7, "overall").when(F.col("_gid") == 3, "make")
        .when(F.col("_gid") == 5, "view").otherwise("era")
    )
    key = F.when(F.col("_gid") == 7, "").otherwise(F.coalesce("make", "view", "era"))
    # Without rows only the grand total remains.
    return grouped.select(facet.alias("facet"), key.alias("key"), "n", *[f"top_{k}" for k in ks])


def worst_cells(cells: DataFrame, facet: str, k: int = 1, limit: int | None = None) -> DataFrame:
    """Cells of a facet by accuracy at k, worst first; larger cells first among equals."""
    ranked = cells.where(F.col("facet") == facet).withColumn(
        "accuracy", F.col(f"top_{k}") / F.col("n")).orderBy(
        "accuracy", F.col("n").desc(), "key")
    return ranked if limit is None else ranked.limit(limit)


def pair_counts(marked: DataFrame) -> DataFrame:
    """Rows per (true, predicted) with a wrong prediction."""
    wrong = marked.where("pred_class is not null and pred_class <> true_class")
    return wrong.groupBy("true_class", "pred_class").agg(F.count("*").alias("n"))


def top_pairs(pairs: DataFrame, limit: int) -> DataFrame:
    return pairs.orderBy(F.col("n").desc(), "true_class", "pred_class").limit(limit)


def _class_pairs(marked: DataFrame, *keys: str) -> DataFrame:
    """Rows per true and predicted class. Pairs and totals are both taken from it: as long as
    they use the same column, Spark runs the scoring below once and reuses its shuffle."""
    return marked.groupBy(*keys, "true_class", "pred_class").agg(F.count("*").alias("_rows"))


def _wrong_rows() -> Column:
    # Built on the count, as a filter on the keys alone would be pushed below the aggregation.
    return F.when(F.col("pred_class") != F.col("true_class"), F.col("_rows"))


def confusions(marked: DataFrame, limit: int) -> DataFrame:
    """Most frequent wrong pairs and their share of all top-1 misses."""
    counts = _class_pairs(marked)
    # The first prediction misses unless it is the true class.
    missed = F.coalesce(F.col("pred_class") != F.col("true_class"), F.lit(True))
    misses = counts.agg(F.sum(F.when(missed, F.col("_rows"))).alias("m"))
    top = top_pairs(counts.withColumn("n", _wrong_rows()).where("n > 0").drop("_rows"), limit)
    return top.withColumn("rate", F.col("n") / misses.scalar()).withColumn(
        "true_name", display_name(F.col("true_class"))).withColumn(
        "pred_name", display_name(F.col("pred_class")))


def make_confusions(marked: DataFrame, min_rows: int, limit: int) -> DataFrame:
    """Top wrong pairs of every make with enough test rows; share of the make's wrong pairs."""
    counts = _class_pairs(marked, "make")
    totals = counts.groupBy("make").agg(
        F.sum("_rows").alias("_n"), F.sum(_wrong_rows()).alias("_wrong")
    ).where(F.col("_n") >= min_rows)
    order = Window.partitionBy("make").orderBy(F.col("n").desc(), "true_class", "pred_class")
    top = counts.withColumn("n", _wrong_rows()).where("n > 0").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return top.join(totals, "make").select(
        "make", "true_class", "pred_class", "n", "rank", (F.col("n") / F.col("_wrong")).alias("rate"))


def per_class(marked: DataFrame, train_counts: DataFrame) -> DataFrame:
    """Train and test rows, top-1 and top-5 per class; classes without prototype just miss."""
    tested = marked.groupBy(F.col("true_class").alias("class_id")).agg(
        F.count("*").alias("n_test"),
        F.avg(F.col("hit_1").cast("int")).alias("top_1"),
        F.avg(F.col("hit_5").cast("int")).alias("top_5"))
    return tested.join(train_counts, "class_id", "left").select(
        "class_id", F.coalesce("n_train", F.lit(0)).alias("n_train"), "n_test", "top_1", "top_5")


def worst_and_best(metrics: DataFrame, m: int) -> DataFrame:
    """The m worst and m best classes by (top_1, class_id), with ``end`` and ``rank`` from that end.

    Of at most 2 m classes every one is there once, in the worst half if both ends reach it. Each
    end is a bounded top-m of Spark; no global ranking of the class table.
    """
    if m < 0:
        raise ValueError("m must not be negative")

    def end(name: str, *order: Column) -> DataFrame:
        # Only m rows are numbered.
        return metrics.orderBy(*order).limit(m).withColumns({
            "end": F.lit(name), "rank": F.row_number().over(Window.orderBy(*order))})

    worst = end("worst", F.col("top_1"), F.col("class_id"))
    best = end("best", F.col("top_1").desc(), F.col("class_id").desc())
    return worst.unionByName(best.join(worst.select("class_id"), "class_id", "left_anti"))


def parity(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Cosine and top-k agreement of two embedding runs in one row, with failed thresholds.

    Needs columns vec_a, vec_b, top_a and top_b (class arrays of both runs, best first).
    """
    cos = cosine(F.col("vec_a"), F.col("vec_b"))
    same_set = F.array_sort(F.slice("top_a", 1, k)) == F.array_sort(F.slice("top_b", 1, k))
    stats = pairs.agg(
        F.count("*").alias("n"), F.avg(cos).alias("cosine_mean"), F.min(cos).alias("cosine_min"),
        F.avg((F.get("top_a", F.lit(0)) == F.get("top_b", F.lit(0))).cast("int"))
        .alias("top1_identity"),
        F.avg(same_set.cast("int")).alias("top5_identity"),
    )
    floors = {
        "cosine_mean": K.COSINE_MEAN_MIN, "cosine_min": K.COSINE_MIN_MIN,
        "top1_identity": K.TOP1_IDENTITY_MIN, "top5_identity": K.TOP5_IDENTITY_MIN,
    }
    failed = F.array_compact(F.array(*[
        F.when(F.col(name) < floor, F.lit(name)) for name, floor in floors.items()]))
    return stats.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)
