"""Table scans with fixed schemas and plain sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorgrid import schemas


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``listings``, ``images`` or ``crawl_queue`` from Parquet."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{directory}/{name}")


def read_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, directory, name) for name in schemas.TABLES}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages: url, html and, where present, source, kind, status and the target hints."""
    pages = spark.read.parquet(path)
    optional = {
        "source": "string", "kind": "string", "status": "int", "target_year": "int",
        "target_make": "string", "target_model": "string",
    }
    for name, kind in optional.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return pages


def union_sources(*frames: DataFrame) -> DataFrame:
    """One table out of several sources; columns a source lacks become null."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """New snapshot as Parquet, partitioned by a low-cardinality column when given."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_prototypes(prototypes: DataFrame, path: str) -> None:
    """Prototype table with its display names in the same rows; per-view tables by view."""
    write_table(prototypes, path, "view" if "view" in prototypes.columns else None)
