"""Class prototypes: normalized mean vectors, with table checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions.labels import display_name
from motorgrid.functions.vectors import l2_normalize, norm


def mean_vectors(df: DataFrame, keys: Iterable[str], vector: str = "embedding",
                 out: str = "prototype") -> DataFrame:
    """Normalized mean per key and its row count; a zero mean stays zero.

    ``Summarizer`` combines inside every task, so a hot key ships one vector per task.
    """
    means = df.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(vector))).alias("_mean"),
        F.count("*").alias("n"))
    return means.select(
        *keys, l2_normalize(vector_to_array("_mean")).alias(out), "n")


def build_prototypes(rows: DataFrame) -> DataFrame:
    """(class_id, embedding) → class_id, display_name, prototype, n."""
    return mean_vectors(rows, ["class_id"]).withColumn(
        "display_name", display_name(F.col("class_id")))


def build_prototypes_by_view(rows: DataFrame) -> DataFrame:
    """The same per exterior view; an empty cell has no row."""
    exterior = rows.where(F.col("view").isin(*K.EXTERIOR_VIEWS))
    return mean_vectors(exterior, ["class_id", "view"]).withColumn(
        "display_name", display_name(F.col("class_id")))


def label_vectors(prompts: DataFrame) -> DataFrame:
    """(label, embedding) prompts → label, prototype: mean of unit vectors, again unit."""
    unit = prompts.withColumn("embedding", l2_normalize(F.col("embedding")))
    return mean_vectors(unit, ["label"])


def view_coverage(prototypes: DataFrame) -> DataFrame:
    """Non-zero prototypes per exterior view, zeros included."""
    populated = prototypes.where(norm(F.col("prototype")) > 0).groupBy("view").agg(
        F.count("*").alias("_n"))
    views = prototypes.sparkSession.createDataFrame(
        [(v,) for v in K.EXTERIOR_VIEWS], "view string")
    return views.join(populated, "view", "left").select(
        "view", F.coalesce("_n", F.lit(0)).alias("populated"))


def prototype_checks(prototypes: DataFrame) -> DataFrame:
    """One row: rows, distinct keys, dimension range, nulls, schema version and verdict."""
    per_view = "view" in prototypes.columns
    key = F.struct("class_id", "view") if per_view else F.col("class_id")
    sized = prototypes.agg(
        F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"),
        F.min(F.size("prototype")).alias("min_dim"), F.max(F.size("prototype")).alias("max_dim"),
        F.count_if(F.col("class_id").isNull() | F.col("prototype").isNull()).alias("n_null"),
    )
    good = (
        (F.col("n_rows") == F.col("n_keys")) & (F.col("n_null") == 0)
        & (F.coalesce("min_dim", F.lit(0)) == F.coalesce("max_dim", F.lit(0)))
    )
    return sized.withColumn("version", F.lit(2 if per_view else 1)).withColumn("valid", good)


def require_prototypes(prototypes: DataFrame, gate: str | None = None) -> None:
    """Fail before scoring: shape of the table, and the version a gate mode needs."""
    per_view = "view" in prototypes.columns
    if gate == "binary" and per_view:
        raise ValueError("the binary gate needs prototypes without views")
    if gate == "six-way" and not per_view:
        raise ValueError("the six-way gate needs prototypes per view")
    if gate not in (None, "binary", "six-way"):
        raise ValueError(f"unknown gate: {gate!r}")
    checked = prototype_checks(prototypes).first()
    if not checked["valid"]:
        raise ValueError(f"unusable prototypes: {checked.asDict()}")
