"""Stored sitemap documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorgrid.functions import text


def scan_sitemap_xml(spark: SparkSession, path: str) -> DataFrame:
    """Sitemap files → (document, root, position, loc); the file path names the document."""
    documents = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("document"), F.col("value").alias("body"))
    return sitemap_links(documents)


def sitemap_links(documents: DataFrame) -> DataFrame:
    """(document, body) → (document, root, position, loc).

    ``root`` is ``urlset`` or ``sitemapindex``. A document whose root element does not open and
    close counts as malformed and gives no rows.
    """
    root = F.lower(F.regexp_extract(
        "body", r"(?is)^\s*(?:<\?xml.*?\?>)?\s*(?:<!--.*?-->\s*)*<(?:[\w.-]+:)?(\w+)", 1))
    closed = F.lower(F.regexp_extract(
        "body", r"(?is)</(?:[\w.-]+:)?(\w+)\s*>\s*\z", 1))
    entry = (
        F.when(root == "urlset", r"(?is)<(?:[\w.-]+:)?url\b[^>]*>(.*?)</(?:[\w.-]+:)?url\s*>")
        .otherwise(r"(?is)<(?:[\w.-]+:)?sitemap\b[^>]*>(.*?)</(?:[\w.-]+:)?sitemap\s*>")
    )
    entries = F.regexp_extract_all("body", entry, F.lit(1))
    parsed = (
        documents.withColumn("root", root).where(
            (root == closed) & root.isin("urlset", "sitemapindex"))
        .select("document", "root", F.posexplode(entries).alias("position", "_entry"))
    )
    loc = text.non_blank(_unescape(F.regexp_replace(
        F.regexp_extract("_entry", r"(?is)<(?:[\w.-]+:)?loc\b[^>]*>(.*?)</", 1),
        r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))
    return parsed.select("document", "root", "position", loc.alias("loc")).where(
        "loc is not null")


def _unescape(col):
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
                       ("&amp;", "&")):
        col = F.replace(col, F.lit(name), F.lit(char))
    return col
