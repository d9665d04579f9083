"""Ingest jobs: labelled image sets, categorised files, content dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions import labels, media, text
from motorgrid.functions.calc import generation_year
from motorgrid.operators.lookups import first_per_key, resolve_names, resolve_two_hop
from motorgrid.operators.summaries import reason_audit
from motorgrid.session import store


def label_underscore(files: DataFrame) -> DataFrame:
    """Class folder ``make_model[_yyyy]`` → year, make, model, body_style, reason, class_slug."""
    parsed = files.withColumn("_l", labels.parse_underscore_class(F.col("class_dir"))).select(
        *files.columns, "_l.year", "_l.make", "_l.model",
        F.lit(None).cast("string").alias("body_style"), F.col("_l.reason").alias("reason"))
    return parsed.withColumn("class_slug", labels.class_slug(
        F.col("make"), F.col("model"), F.col("year")))


def label_spaced(files: DataFrame, makes: DataFrame) -> DataFrame:
    """Class string ``Make Model [Body] yyyy``."""
    return labels.parse_spaced_class(files, "class_dir", makes).withColumn(
        "class_slug", labels.class_slug(
            F.col("make"), F.col("model"), F.col("year"), F.col("body_style")))


def label_id_path(files: DataFrame, make_names: DataFrame, model_names: DataFrame,
                  model_types: DataFrame, type_names: DataFrame) -> DataFrame:
    """Path ``image/<make>/<model>/<year>/…`` resolved through the id tables."""
    parsed = files.withColumn("_l", labels.parse_id_path(F.col("entry"))).select(
        *files.columns, "_l.make_id", "_l.model_id", "_l.year",
        F.col("_l.reason").alias("_path_reason"))
    named = resolve_names(parsed, make_names, "make_id", "make")
    named = resolve_names(named, model_names, "model_id", "model")
    typed = resolve_two_hop(named, model_types, type_names, "model_id", "body_style")
    reason = F.coalesce("_path_reason", "make_reason", "model_reason")
    return typed.withColumn("reason", reason).withColumn("class_slug", labels.class_slug(
        F.col("make"), F.col("model"), F.col("year"))).drop(
        "_path_reason", "make_reason", "model_reason")


def synthetic_url(source: str) -> Column:
    if source == "compcars":
        return media.synthetic_url(
            source, F.col("make_id"), F.col("model_id"), F.col("year"),
            F.substring("image_id", 1, 8))
    return media.synthetic_url(source, F.col("class_slug"), F.col("image_id"))


def _new_ids(rows: DataFrame, order: list[str], known_images: DataFrame) -> DataFrame:
    """First row of every unknown image, marked ``_new``.

    Copies are reduced before the look-up, and the result joins back on id and row number, so many
    copies of one image never meet in one task and a file that is listed twice is new once.
    """
    first = first_per_key(
        rows.select("image_id", "_row", *order), ["image_id"], [*order, "_row"])
    return first.join(known_images.select("image_id"), "image_id", "left_anti").select(
        "image_id", "_row", F.lit(True).alias("_new"))


def ingest_labelled_images(files: DataFrame, source: str, known_images: DataFrame, split: str,
                           now: Column, root: str = "images") -> dict[str, DataFrame]:
    """Labelled files → new listings and images, and the audit of all files.

    ``files`` comes from one of the ``label_*`` steps and has content, ext and length. The id is
    the hash of the bytes: known ids and repeats inside the batch are skipped. The bytes are read
    and hashed once; everything else works on the short rows written then.
    """
    hashed = store(files.withColumn("image_id", F.sha2("content", 256)).drop("content").withColumn(
        "_row", F.monotonically_increasing_id()), "hashed")
    parsed = hashed.where("reason is null")
    fresh_ids = _new_ids(parsed, ["path"], known_images)
    marked = hashed.join(fresh_ids, ["image_id", "_row"], "left").withColumn("outcome", F.when(
        F.col("reason").isNotNull(), F.col("reason")).when(F.col("_new").isNull(), "existing"))
    fresh = marked.where("outcome is null").withColumn(
        "listing_id", labels.listing_key(F.lit(source), F.col("image_id"))).withColumn(
        "url", synthetic_url(source))
    listings = fresh.select(
        "listing_id", F.lit(source).alias("source"), "url", "year", "make", "model", "body_style",
        now.alias("scraped_at"), F.lit(split).alias("split"))
    images = fresh.select(
        "image_id", "listing_id", F.col("url").alias("source_url"),
        F.concat_ws("/", F.lit(root), F.col("class_slug"),
                    F.concat("image_id", "ext")).alias("local_path"),
        F.col("length").alias("bytes"), F.lit(1).alias("position"), now.alias("downloaded_at"))
    return {"listings": listings, "images": images, "audit": reason_audit(marked, "outcome")}


def ingest_category_files(files: DataFrame, known_images: DataFrame, now: Column,
                          year_min: int, year_max: int, split: str = "train",
                          max_per_category: int | None = None,
                          root: str = "images") -> dict[str, DataFrame]:
    """File metadata (title, categories, url, mime, content) → canonical listings and images.

    Files of a seed category beyond ``max_per_category`` (needs a column ``category``) are left
    out first, as the crawl would never have listed them.
    """
    if max_per_category is not None:
        from motorgrid.plans.batches import cap_per_group

        files = cap_per_group(files, "category", ["title"], max_per_category)
    extension = F.when(
        media.media_type(F.col("mime")).isin(*K.CATEGORY_MEDIA_TYPES),
        media.media_extension(F.col("mime")))
    staged = (
        files.withColumn("_label", labels.category_label(F.col("categories"), year_min, year_max))
        .withColumn("_ext", extension).withColumn("image_id", F.sha2("content", 256))
        .withColumn("_bytes", F.octet_length("content")).drop("content")
    )
    reason = (
        F.when(F.col("_label").isNull(), "no label")
        .when(F.coalesce("url", F.lit("")) == "", "download failure")
        .when(F.col("image_id").isNull(), "download failure")
        .when(F.col("_ext").isNull(), "unsupported type")
    )
    # The bytes are read and hashed once; everything else works on these short rows.
    staged = store(staged.withColumn("_reason", reason).withColumn(
        "_row", F.monotonically_increasing_id()), "hashed")
    fresh_ids = _new_ids(staged.where("_reason is null"), ["title"], known_images)
    marked = staged.join(fresh_ids, ["image_id", "_row"], "left").withColumn("outcome", F.when(
        F.col("_reason").isNotNull(), F.col("_reason")).when(F.col("_new").isNull(), "existing"))
    source = F.lit("wikimedia_commons")
    fresh = marked.where("outcome is null").withColumn(
        "listing_id", labels.listing_key(source, F.col("image_id")))
    listings = fresh.select(
        "listing_id", source.alias("source"), "url", "_label.year", "_label.make", "_label.model",
        now.alias("scraped_at"), F.lit(split).alias("split"),
        labels.normalize_make(F.col("_label.make")).alias("canonical_make"),
        labels.normalize_model(F.col("_label.model")).alias("canonical_model"),
        generation_year(F.col("_label.year")).alias("generation_year"))
    images = fresh.select(
        "image_id", "listing_id", F.col("url").alias("source_url"),
        F.concat_ws("/", F.lit(root), F.concat("image_id", "_ext")).alias("local_path"),
        F.col("_bytes").cast("bigint").alias("bytes"), F.lit(1).alias("position"),
        now.alias("downloaded_at"))
    return {"listings": listings, "images": images, "audit": reason_audit(marked, "outcome")}


def content_clusters(rows: DataFrame, key: str, content: str) -> DataFrame:
    """One row per content hash: representative (smallest key) and cluster size."""
    return rows.where(F.col(content).isNotNull()).groupBy(
        text.text_hash(F.col(content)).alias("digest")).agg(
        F.min(key).alias("representative"), F.count("*").alias("cluster_size"))
