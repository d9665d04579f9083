"""Prototype building, evaluation, recognition, re-ranking and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions.calc import era_bucket
from motorgrid.functions.labels import display_name
from motorgrid.operators import evaluation, filters, prototypes, summaries
from motorgrid.operators.similarity import StoredPrototypes, score_top_k, store_prototypes, top_k_rows
from motorgrid.session import cut_lineage


def train_prototypes(images: DataFrame, listings: DataFrame, vectors: DataFrame, sources,
                     split: str = "train", by_view: bool = False) -> DataFrame:
    """Prototypes of the split's labelled images; ``vectors`` is (image_id, embedding)."""
    rows = filters.select_labelled_rows(images, listings, sources, split).join(vectors, "image_id")
    return prototypes.build_prototypes_by_view(rows) if by_view \
        else prototypes.build_prototypes(rows)


def test_queries(images: DataFrame, listings: DataFrame, vectors: DataFrame, sources,
                 split: str = "test", era_years: int = 10) -> DataFrame:
    """query_id, embedding, true_class, view, era, make of the split's labelled images."""
    rows = filters.select_labelled_rows(images, listings, sources, split, context={
        "make": F.trim("canonical_make"), "era": era_bucket(F.col("generation_year"), era_years)})
    return rows.join(vectors, "image_id").select(
        F.col("image_id").alias("query_id"), "embedding", F.col("class_id").alias("true_class"),
        "view", "era", "make")


def score_queries(queries: DataFrame, protos: DataFrame | StoredPrototypes, ks=K.TOP_KS, **options) -> DataFrame:
    """Predictions and hits per query; refuses per-view prototypes."""
    per_view = protos.by if isinstance(protos, StoredPrototypes) else "view" in protos.columns
    if per_view:
        raise ValueError("evaluation needs prototypes without views")
    return evaluation.mark_hits(score_top_k(queries, protos, max(ks), **options), ks=ks)


def evaluate(queries: DataFrame, protos: DataFrame, ks=K.TOP_KS, **options) -> dict[str, DataFrame]:
    """Overall, per make / view / era, and the top lists of confusions, overall and per make."""
    # All reports read the predictions: score once, without the vectors.
    marked = cut_lineage(score_queries(queries, protos, ks, **options))
    return {
        "predictions": marked, "overall": evaluation.overall(marked, ks),
        "breakdown": evaluation.breakdown(marked, ks),
        "confusions": evaluation.confusions(marked, K.CONFUSION_LIMIT),
        "make_confusions": evaluation.make_confusions(
            marked, K.PER_MAKE_MIN_ROWS, K.PER_MAKE_LIMIT),
    }


def evaluate_baseline(queries: DataFrame, protos: DataFrame, train_counts: DataFrame,
                      per_class_top: int, ks=K.TOP_KS, **options) -> dict[str, DataFrame]:
    """Overall accuracy, worst and best classes, most frequent wrong pairs."""
    if per_class_top < 0:
        raise ValueError("per_class_top must not be negative")
    marked = cut_lineage(score_queries(queries, protos, ks, **options))
    metrics = evaluation.per_class(marked, train_counts)
    return {
        "overall": evaluation.overall(marked, ks),
        "per_class": evaluation.worst_and_best(metrics, per_class_top),
        "pairs": evaluation.top_pairs(evaluation.pair_counts(marked), per_class_top),
    }


def gate_status(view: Column, score: Column, mode: str, threshold: float) -> Column:
    """``rejected`` or ``ok``. Binary: sure of non-exterior. Six-way: non-exterior or unsure."""
    outside = view == K.NON_EXTERIOR
    if mode == "binary":
        rejected = outside & (score >= threshold)
    elif mode == "six-way":
        rejected = outside | (score < threshold)
    else:
        raise ValueError(f"unknown gate: {mode!r}")
    return F.when(rejected, "rejected").otherwise("ok")


def recognize_batch(queries: DataFrame, protos: DataFrame, logit_scale: float, k: int = 5,
                    gate: str | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """Top-k with softmax over all classes, one row per prediction.

    Queries without predictions keep one row: ``rejected`` ones, and those whose view has no
    prototypes, with the status ``no prototypes``.

    With a gate the queries carry ``gate_view`` and ``gate_score``; six-way retrieves only within
    the predicted view.
    """
    protos = cut_lineage(protos)
    prototypes.require_prototypes(protos, gate)
    status = F.lit("ok") if gate is None else gate_status(
        F.col("gate_view"), F.col("gate_score"), gate, threshold)
    marked = queries.withColumn("status", status)
    accepted = marked.where("status = 'ok'")
    by = None
    if gate == "six-way":
        by = "view"
        accepted = accepted.drop("view").withColumn("view", F.col("gate_view"))
    scored = score_top_k(accepted, protos, k, by=by, scale=logit_scale, **options)
    rows = top_k_rows(scored, scale=logit_scale, keep_empty=True).withColumns({
        "display_name": display_name(F.col("class_id")),
        "status": F.when(F.col("class_id").isNull(), "no prototypes").otherwise(F.col("status"))})
    rejected = marked.where("status = 'rejected'").drop("embedding", "view")
    return rows.drop("view").unionByName(rejected, allowMissingColumns=True)


def apply_rerank(predictions: DataFrame, choices: DataFrame, threshold: float) -> DataFrame:
    """Move the chosen candidate (0-based) of unsure queries to rank 1, the others keep order.

    ``predictions``: query_id, class_id, confidence, rank. ``choices``: query_id, choice. Ranks
    are recomputed by arithmetic, so nothing is sorted again. ``rerank_applied`` tells what took
    effect; the new first row gets at least the threshold as confidence.
    """
    stats = predictions.groupBy("query_id").agg(
        F.max("rank").alias("_n"),
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("_top"))
    wanted = choices.select("query_id", F.col("choice").alias("_c"))
    joined = predictions.join(
        stats.join(wanted, "query_id", "left"), "query_id", "left")
    applied = F.coalesce(
        (F.col("_top") < threshold) & (F.col("_c") >= 0) & (F.col("_c") < F.col("_n")),
        F.lit(False))
    rank = (
        F.when(~applied, F.col("rank")).when(F.col("rank") == F.col("_c") + 1, 1)
        .when(F.col("rank") <= F.col("_c"), F.col("rank") + 1).otherwise(F.col("rank"))
    ).cast("int")
    raised = F.when(
        applied & (rank == 1), F.greatest("confidence", F.lit(float(threshold)))
    ).otherwise(F.col("confidence"))
    changed = {"rank": rank, "confidence": raised}
    return joined.select(*[
        changed.get(c, F.col(c)).alias(c) for c in predictions.columns],
        applied.alias("rerank_applied"))


def compare_embeddings(a: DataFrame, b: DataFrame, protos: DataFrame, k: int = 5,
                       **options) -> DataFrame:
    """Parity of two embedding runs of the same ids: (query_id, embedding) each."""
    protos = store_prototypes(protos)
    pairs = a.select("query_id", F.col("embedding").alias("vec_a")).join(
        b.select("query_id", F.col("embedding").alias("vec_b")), "query_id")
    top_a = score_top_k(
        pairs.select("query_id", F.col("vec_a").alias("embedding"), F.col("vec_a").alias("v1"),
                     F.col("vec_b").alias("v2")), protos, k, **options
    ).select("query_id", "v1", F.col("v2").alias("embedding"),
             F.col("v2").alias("v2"), F.col("top_classes").alias("top_a"))
    both = score_top_k(top_a, protos, k, **options)
    return evaluation.parity(both.select(
        F.col("v1").alias("vec_a"), F.col("v2").alias("vec_b"), "top_a",
        F.col("top_classes").alias("top_b")), k)


def training_manifest(train: DataFrame, val: DataFrame, confusions: DataFrame,
                      hard_weight: float) -> dict[str, DataFrame]:
    """Rows of both splits with class index and weight, the class space and val-only classes."""
    from motorgrid.operators import training

    classes = training.hard_class_weights(
        training.class_space(train, val), confusions, hard_weight)
    rows = train.withColumn("split", F.lit("train")).unionByName(
        val.withColumn("split", F.lit("val")))
    return {
        "rows": rows.join(classes, "class_id"), "classes": classes,
        "val_only": training.val_only(train, val),
    }


def gate_manifest(images: DataFrame, split: str, min_score: float,
                  binary: bool = False) -> dict[str, DataFrame]:
    """Gate dataset of a split and the class weights of its counts."""
    from motorgrid.operators import training

    dataset = training.binary_dataset(images, split, min_score) if binary \
        else training.six_way_dataset(images, split, min_score)
    n_classes = 2 if binary else len(K.EXTERIOR_VIEWS) + 1
    counts = summaries.count_by_class(dataset, "class_idx", n_classes)
    return {"rows": dataset, "weights": summaries.inverse_sqrt_weights(counts)}

