"""Expansion of stored sitemap trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorgrid.session import cut_lineage

MAX_DEPTH = 3


def _step(position: str) -> Column:
    return F.lpad(F.col(position).cast("string"), 9, "0")


def _named(visits: DataFrame, index: DataFrame, max_depth: int) -> DataFrame:
    """root, document, entry (path, depth): what the indexes of ``visits`` name at their depth."""
    return visits.where(F.col("entry.depth") < max_depth).join(
        index, F.col("document") == F.col("_doc")).select(
        "root", F.col("loc").alias("document"), F.struct(
            F.concat("entry.path", F.lit("/"), _step("position")).alias("path"),
            (F.col("entry.depth") + 1).alias("depth")).alias("entry"))


def _first_visits(links: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """root, document, entry: where a depth-first walk enters each document.

    The walk enters a document once, at the least path that leads to it from an entered index above
    the depth limit. A path is greater than its beginnings, so just one set of entries fits this rule.
    Starting from the roots, entries are drawn anew from those of the round before until nothing
    changes: one path per root and document is held, not every way. A wrong entry lasts until the
    first wrong one on its own path is mended, so the rounds end; without detours that the walk has
    entered before there are at most ``max_depth`` + 2. Rounds run over indexes only; other documents
    name nothing and are added in the end.
    """
    index = cut_lineage(links.where("root = 'sitemapindex' and loc is not null").select(
        F.col("document").alias("_doc"), "position", "loc"))
    inner = index.join(
        index.select(F.col("_doc").alias("loc")).distinct(), "loc", "left_semi")
    start = cut_lineage(roots.distinct().select(
        F.col("document").alias("root"), "document",
        F.struct(F.lit("").alias("path"), F.lit(0).alias("depth")).alias("entry")))

    def entered(visits: DataFrame, edges: DataFrame) -> DataFrame:
        return start.unionByName(_named(visits, edges, max_depth)).groupBy("root", "document").agg(
            F.min("entry").alias("entry"))

    visits, held = start, start.count()
    while True:
        updated = cut_lineage(entered(visits, inner))
        found = updated.join(
            visits.withColumn("_old", F.lit(True)), ["root", "document", "entry"], "left").agg(
            F.count("*").alias("n"), F.count("_old").alias("same")).first()
        visits = updated
        if found["n"] == found["same"] == held:
            return cut_lineage(entered(visits, index))
        held = found["n"]


def expand_sitemaps(links: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH,
                    max_urls: int | None = None) -> DataFrame:
    """Page URLs below each root, depth first in document order.

    ``links`` is the output of ``sitemap_links``; ``roots`` has one column ``document``. Indexes
    are followed to ``max_depth``; a document counts once per root. Returns root, path (sort key
    of the walk) and url. ``max_urls`` limits the walk of each root, if given. Indexes below
    ``max_depth`` are not opened; ``not_followed`` lists them.

    The rounds run over sitemap indexes only; each starts from a checkpoint.
    """
    visits = _first_visits(links, roots, max_depth)
    pages = links.where("root = 'urlset'").select(
        F.col("document").alias("_doc"), "position", "loc")
    found = visits.join(pages, F.col("document") == F.col("_doc")).select(
        "root", F.concat("entry.path", F.lit("/"), _step("position")).alias("path"),
        F.col("loc").alias("url"))
    if max_urls is None:
        return found
    order = Window.partitionBy("root").orderBy("path")
    return found.withColumn("_rn", F.row_number().over(order)).where(
        F.col("_rn") <= max_urls).drop("_rn")


def not_followed(links: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, document) that an index at ``max_depth`` names and the walk never enters."""
    visits = _first_visits(links, roots, max_depth)
    named = links.where("root = 'sitemapindex'").select(
        F.col("document").alias("_doc"), F.col("loc").alias("_loc"))
    return visits.join(named, F.col("document") == F.col("_doc")).select(
        "root", F.col("_loc").alias("document")).where("document is not null").distinct().join(
        visits, ["root", "document"], "left_anti")
