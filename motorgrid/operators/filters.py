"""Row selection, updates and validation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid import schemas
from motorgrid.functions.labels import class_id


def source_list(value: str | Iterable[str]) -> list[str]:
    """Names of sources, stripped. A comma-separated string may have gaps, a list may not."""
    given = value.split(",") if isinstance(value, str) else [str(v) for v in value]
    names = [n for n in map(str.strip, given) if n]
    if not isinstance(value, str) and len(names) < len(given):
        raise ValueError(f"blank source in {given}")
    if not names:
        raise ValueError("no source given")
    return names


def from_sources(df: DataFrame, sources: str | Iterable[str]) -> DataFrame:
    return df.where(F.col("source").isin(*source_list(sources)))


def list_by_class(listings: DataFrame, year: int | None = None, make: str | None = None,
                  model: str | None = None, source: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """Listings matching every given argument, newest first; None is a wildcard."""
    for name, value in (("year", year), ("make", make), ("model", model), ("source", source)):
        if value is not None:
            listings = listings.where(F.col(name) == value)
    ordered = listings.orderBy(F.col("scraped_at").desc(), "listing_id")
    return ordered if limit is None else ordered.limit(limit)


def get_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value)


def images_for_listing(images: DataFrame, listing_id: str) -> DataFrame:
    """Images of one listing by position (missing ones last), then download time."""
    return images.where(F.col("listing_id") == listing_id).orderBy(
        F.coalesce("position", F.lit(K.POSITION_LAST)), "downloaded_at", "image_id")


def join_listings(images: DataFrame, listings: DataFrame) -> DataFrame:
    """Inner join on the listing; the image's own split and source columns win."""
    shared = set(images.columns) - {"listing_id"}
    return images.join(listings.drop(*shared), "listing_id")


def select_labelled_rows(images: DataFrame, listings: DataFrame, sources: str | Iterable[str],
                         split: str, keep: Iterable[str] = (),
                         context: Mapping[str, Column] | None = None) -> DataFrame:
    """image_id, class_id, view, local_path of the split's images that have a class and a file.

    ``keep`` adds image columns, ``context`` columns of the listing, by name.
    """
    context = context or {}
    chosen = from_sources(listings, sources).select(
        "listing_id",
        class_id(F.col("generation_year"), F.col("canonical_make"), F.col("canonical_model"))
        .alias("class_id"), *[c.alias(n) for n, c in context.items()],
    ).where("class_id is not null")
    return (
        images.where((F.col("split") == split) & (F.col("local_path") != ""))
        .join(chosen, "listing_id")
        .select("image_id", "class_id", "view", "local_path", *keep, *context)
    )


def select_unlabelled(images: DataFrame, listings: DataFrame, rebuild: bool = False,
                      source: str | None = None, limit: int | None = None) -> DataFrame:
    """Images that still need a view label (all of them on rebuild), oldest download first."""
    targets = images if rebuild else images.where("view is null")
    if source is not None:
        targets = targets.join(
            listings.where(F.col("source") == source).select("listing_id"), "listing_id",
            "left_semi")
    ordered = targets.orderBy("downloaded_at", "image_id")
    return ordered if limit is None else ordered.limit(limit)


def select_uncanonical(listings: DataFrame, source: str | None = None, rebuild: bool = False,
                       limit: int | None = None) -> DataFrame:
    """Listings lacking a canonical make or a generation year."""
    if source is not None:
        listings = listings.where(F.col("source") == source)
    if not rebuild:
        listings = listings.where("canonical_make is null or generation_year is null")
    return listings if limit is None else listings.orderBy("listing_id").limit(limit)


def sample_paths(images: DataFrame, listings: DataFrame, source: str, split: str,
                 n: int) -> DataFrame:
    """First ``n`` file paths of a split by image id."""
    chosen = listings.where(F.col("source") == source).select("listing_id")
    return (
        images.where((F.col("split") == split) & F.col("local_path").isNotNull())
        .join(chosen, "listing_id", "left_semi")
        .orderBy("image_id").limit(n).select("image_id", "local_path")
        .where("local_path <> ''")
    )


def update_listings(listings: DataFrame, patch: DataFrame) -> DataFrame:
    """Apply non-null patch values by listing_id; other columns than the allowed ones fail."""
    fields = [name for name in patch.columns if name != "listing_id"]
    unknown = sorted(set(fields) - set(schemas.LISTING_UPDATABLE))
    if unknown:
        raise ValueError(f"not updatable: {unknown}")
    renamed = patch.select("listing_id", *[F.col(f).alias(f"_new_{f}") for f in fields])
    return listings.join(renamed, "listing_id", "left").select(*[
        F.coalesce(f"_new_{name}", name).alias(name) if name in fields else F.col(name)
        for name in listings.columns
    ])


def is_split_eligible() -> Column:
    return (
        F.col("view").isin(*K.EXTERIOR_VIEWS)
        & F.col("canonical_make").isNotNull() & F.col("canonical_model").isNotNull()
    )


def eligible_for_split(images: DataFrame, listings: DataFrame, source: str) -> DataFrame:
    """All images of the source with a boolean ``eligible`` (false is the excluded rest)."""
    chosen = listings.where(F.col("source") == source).select(
        "listing_id", "canonical_make", "canonical_model", "generation_year")
    return images.join(chosen, "listing_id").withColumn(
        "eligible", F.coalesce(is_split_eligible(), F.lit(False)))


def resolution_filter(images: DataFrame, min_side: int, max_aspect: float) -> DataFrame:
    """Images whose shorter side and aspect ratio are acceptable."""
    longer = F.greatest("width", "height")
    shorter = F.least("width", "height")
    return images.where((shorter >= min_side) & (longer <= shorter * max_aspect))


def domain_violations(df: DataFrame, domains: dict[str, Iterable[str]]) -> DataFrame:
    """Rows outside a closed vocabulary, with the names of the offending columns."""
    bad = F.filter(
        F.array(*[F.when(~F.col(name).isin(*values) | F.col(name).isNull(), F.lit(name))
                  for name, values in domains.items()]),
        lambda v: v.isNotNull(),
    )
    return df.withColumn("violations", bad).where(F.size("violations") > 0)


QUEUE_DOMAINS = {
    "source": K.QUEUE_SOURCES, "kind": K.QUEUE_KINDS, "status": K.QUEUE_STATUSES,
}
LISTING_DOMAINS = {"source": K.LISTING_SOURCES}


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key has no parent; a null key counts as an orphan."""
    keys = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return df.join(keys, key, "left_anti")
