"""Look-up joins, idempotent inserts and value-preserving updates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorgrid import constants as K


def resolve_names(df: DataFrame, names: DataFrame, id_col: str, out: str) -> DataFrame:
    """1-based id → name. ``names`` is (id, name); ``<out>_reason`` tells why there is none.

    Plain equi join: Spark broadcasts the name table when it is small, else shuffles.
    """
    table = names.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    joined = df.join(table, F.col(id_col) == F.col("_id"), "left")
    reason = (
        F.when(F.col("_id").isNull() | (F.col(id_col) <= 0), "id out of range")
        .when(F.coalesce(F.trim("_name"), F.lit("")) == "", "empty name")
    )
    return joined.withColumn(f"{out}_reason", reason).withColumn(
        out, F.when(F.col(f"{out}_reason").isNull(), F.col("_name"))).drop("_id", "_name")


def resolve_two_hop(df: DataFrame, hop: DataFrame, names: DataFrame, id_col: str,
                    out: str) -> DataFrame:
    """id → type id → name through ``hop`` (id, type_id) and ``names`` (id, name); never fails."""
    first = hop.select(F.col("id").alias("_id"), F.col("type_id").alias("_type"))
    second = names.select(F.col("id").alias("_tid"), F.col("name").alias(out))
    return (
        df.join(first, F.col(id_col) == F.col("_id"), "left")
        .join(second, (F.col("_type") == F.col("_tid")) & (F.col("_type") > 0), "left")
        .drop("_id", "_type", "_tid")
    )


def merge_join(df: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join of tables that grow with the crawl, never by broadcast.

    Spark takes 20 bytes for any computed text, a page of HTML as well, so its estimate calls such
    a table small and the driver would have to hold it.
    """
    return df.join(other.hint("merge"), on, how)


def decode_class_index(df: DataFrame, names: DataFrame, text_col: str, index_col: str,
                       out: str) -> DataFrame:
    """A usable text label wins, else the name of the integer label."""
    table = names.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    text = F.nullif(F.trim(text_col), F.lit(""))
    return df.join(table, F.col(index_col) == F.col("_id"), "left").withColumn(
        out, F.coalesce(text, F.col("_name"))).drop("_id", "_name")


def first_per_key(df: DataFrame, keys: Iterable[str], order: Iterable) -> DataFrame:
    """First row per key. Spark limits every task to one row per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def insert_new(target: DataFrame, incoming: DataFrame, key: str, order: Iterable) -> DataFrame:
    """Incoming rows whose key is new, the first of each key."""
    return merge_join(first_per_key(incoming, [key], order), target.select(key), key, "left_anti")


def upsert_new(target: DataFrame, incoming: DataFrame, key: str, order: Iterable) -> DataFrame:
    """Target plus the new rows."""
    fresh = insert_new(target, incoming, key, order)
    return target.unionByName(fresh.select(*target.columns))


def keep_existing(df: DataFrame, values: DataFrame, key: str, column: str,
                  rebuild: bool = False) -> DataFrame:
    """Write ``values`` (key, column) where the current value is null, everywhere on rebuild."""
    incoming = values.select(key, F.col(column).alias("_new"))
    order = ("_new", column) if rebuild else (column, "_new")
    return df.join(incoming, key, "left").select(*[
        F.coalesce(*order).alias(column) if name == column else F.col(name) for name in df.columns
    ])


def attach_context(predictions: DataFrame, context: DataFrame, key: str,
                   columns: Iterable[str] = ("view", "era", "make")) -> DataFrame:
    """Left join of context columns; what is missing becomes ``unknown``."""
    columns = list(columns)
    joined = predictions.join(context.select(key, *columns), key, "left")
    for name in columns:
        joined = joined.withColumn(name, F.coalesce(name, F.lit(K.UNKNOWN)))
    return joined


def hard_classes(confusions: DataFrame) -> DataFrame:
    """Distinct classes on either side of a confusion pair."""
    sides = F.explode(F.array("true_class", "pred_class")).alias("class_id")
    return confusions.select(sides).where("class_id is not null").distinct()


def flag_hard(classes: DataFrame, confusions: DataFrame) -> DataFrame:
    marked = hard_classes(confusions).withColumn("_hard", F.lit(True))
    return classes.join(marked, "class_id", "left").withColumn(
        "hard", F.coalesce("_hard", F.lit(False))).drop("_hard")
