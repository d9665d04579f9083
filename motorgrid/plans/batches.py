"""Page batches applied to the queue, and per-group caps that are features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid import schemas
from motorgrid.operators import crawlqueue, pages
from motorgrid.operators.lookups import first_per_key, merge_join, upsert_new
from motorgrid.session import cut_lineage


def cap_per_group(df: DataFrame, group: str, order: Iterable, n: int) -> DataFrame:
    """First n rows per group; tasks drop the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def apply_page_results(queue: DataFrame, listings: DataFrame, fetched: DataFrame, now: Column,
                       current_year: int) -> dict[str, DataFrame]:
    """One batch of fetched pages → new queue and listings.

    ``fetched`` has the claimed URL (queue_url), the final url, html (null when the fetch failed)
    and error. Listings are inserted once, images and discovered URLs are queued even when the
    listing was known, then outcomes are written.
    """
    claimed = queue.select(
        F.col("url").alias("queue_url"), "source", "kind", *pages.HINTS)
    batch = merge_join(fetched, claimed, "queue_url")
    readable = batch.where("html is not null")
    # Both results need the parsed pages; parse them once.
    parsed = cut_lineage(pages.parse_listings(readable, current_year))
    rows = parsed.where("listing_id is not null")
    # A URL already held by another listing is no new row either.
    fresh = merge_join(
        upsert_columns(rows, listings.columns, now), listings.select("url"), "url", "left_anti")
    # Of several listings with one final URL the first by its own columns counts, in every retry.
    new_rows = first_per_key(fresh, ["url"], ["listing_id", *[
        c for c in listings.columns if c not in ("url", "listing_id")]])
    listings_out = upsert_new(listings, new_rows, "listing_id", ["url"])
    found = pages.discovered_urls(readable).select("url", "source", "kind", *pages.HINTS)
    images = pages.image_items(parsed)
    incoming = found.unionByName(images, allowMissingColumns=True)
    queue_out = crawlqueue.enqueue(
        queue, incoming, now, ["source", "kind", F.col("parent_listing_id").asc_nulls_last(),
                               F.col("target_make").asc_nulls_last(),
                               F.col("target_model").asc_nulls_last(),
                               F.col("target_year").asc_nulls_last()])
    no_parser = ~F.col("source").isin(*K.QUEUE_SOURCES)
    failure = (
        F.when(F.col("html").isNull(), F.coalesce("error", F.lit("fetch failed")))
        .when(no_parser, "no parser for the source"))
    outcomes = batch.groupBy("queue_url").agg(
        F.max(F.struct(failure.isNull().alias("ok"), failure.alias("e"))).alias("_o"))
    outcomes = outcomes.select(
        F.col("queue_url").alias("url"),
        F.when(F.col("_o.ok"), "done").otherwise("failed").alias("action"),
        F.col("_o.e").alias("error"))
    return {"queue": crawlqueue.apply_outcomes(queue_out, outcomes, now), "listings": listings_out}


def upsert_columns(rows: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """Parsed listings in the shape of the listings table."""
    types = {f.name: f.dataType for f in schemas.LISTINGS.fields}
    given = set(rows.columns)
    return rows.select(*[
        (now if name == "scraped_at" else F.col(name) if name in given else F.lit(None))
        .cast(types[name]).alias(name) for name in columns])
