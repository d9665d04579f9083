"""Catalog roll-up, popularity ranking and seed rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions import urls
from motorgrid.functions.calc import recency_weight
from motorgrid.functions.labels import literal_map


def model_years(rows: DataFrame) -> DataFrame:
    """(make_id, make_name, model_id, model_name, year) → sorted distinct years per model."""
    return rows.groupBy("make_id", "model_id").agg(
        F.min("make_name").alias("make_name"), F.min("model_name").alias("model_name"),
        F.array_sort(F.collect_set("year")).alias("years"),
    ).select("make_id", "make_name", "model_id", "model_name", "years")


def nest_models(models: DataFrame) -> DataFrame:
    """One row per make with its models sorted by name."""
    return models.groupBy("make_id").agg(
        F.min("make_name").alias("make_name"),
        F.array_sort(F.collect_list(F.struct("model_name", "model_id", "years"))).alias("_m"),
    ).select("make_id", "make_name", F.transform("_m", lambda m: F.struct(
        m["model_id"].alias("model_id"), m["model_name"].alias("model_name"),
        m["years"].alias("years"))).alias("models"))


def catalog_totals(models: DataFrame) -> DataFrame:
    return models.agg(
        F.countDistinct("make_id").alias("total_makes"), F.count("*").alias("total_models"),
        F.coalesce(F.sum(F.size("years")), F.lit(0)).alias("total_class_entries"))


def build_catalog(rows: DataFrame, source: str, generated_at: str,
                  year_range: tuple[int, int]) -> DataFrame:
    """The nested catalog, one row per make by name: ``meta`` with the totals of all, ``makes`` with
    the one make. Makes stay on their own rows at every step."""
    models = model_years(rows.where(F.col("year").between(*year_range)))
    totals = catalog_totals(models)

    def total(name: str) -> Column:
        return totals.select(F.col(name).cast("int")).scalar().alias(name)

    meta = F.struct(
        F.lit(generated_at).alias("generated_at"), F.lit(source).alias("source"),
        F.array(*[F.lit(y) for y in year_range]).alias("year_range"),
        total("total_makes"), total("total_models"), total("total_class_entries"))
    return nest_models(models).orderBy("make_name", "make_id").select(
        meta.alias("meta"),
        F.array(F.struct("make_id", "make_name", "models")).alias("makes"))


def rank_models(models: DataFrame, current_year: int, top_n: int | None = None,
                ignore_case: bool = False) -> DataFrame:
    """Score = make weight × recency of the last year; best first, then make and model.

    The weight table has its own spellings and the look-up is exact unless ``ignore_case``.
    """
    if top_n is not None and top_n < 0:
        raise ValueError("top_n must not be negative")
    if ignore_case:
        weights = literal_map({k.lower(): v for k, v in K.MAKE_POPULARITY.items()})
        key = F.lower("make_name")
    else:
        weights, key = literal_map(K.MAKE_POPULARITY), F.col("make_name")
    weight = F.coalesce(F.try_element_at(weights, key), F.lit(K.DEFAULT_MAKE_WEIGHT))
    last = F.array_max("years")
    ranked = (
        models.where(F.size("years") > 0)
        .select(
            F.col("make_name").alias("make"), F.col("model_name").alias("model"), "make_id",
            "model_id", F.array_min("years").alias("year_min"), last.alias("year_max"),
            (weight * recency_weight(last, current_year)).alias("score"))
        .orderBy(F.col("score").desc(), "make", "model", "model_id")
    )
    return ranked if top_n is None else ranked.limit(top_n)


def seed_rows(ranked: DataFrame, sites: Iterable[str],
              cities: tuple[str, ...] = K.CRAIGSLIST_CITIES) -> DataFrame:
    """Search URLs of every ranked class on every site (and city)."""
    args = (F.col("make"), F.col("model"), F.col("year_min"), F.col("year_max"))

    def rows(site: str) -> Column:
        found = urls.search_urls(site, *args, cities=cities)
        return F.transform(found, lambda u: F.struct(u.alias("url"), F.lit(site).alias("source")))

    seeds = ranked.select("*", F.explode(F.concat(*[rows(site) for site in sites])).alias("_s"))
    return seeds.select(
        "_s.url", "_s.source", F.lit("search").alias("kind"),
        F.col("year_min").alias("target_year"), F.col("make").alias("target_make"),
        F.col("model").alias("target_model"))
