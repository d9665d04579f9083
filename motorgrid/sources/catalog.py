"""Catalog scans and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorgrid import schemas
from motorgrid.functions.text import catalog_title


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Catalog → one row per (make_id, make_name, model_id, model_name, year).

    One document per file, or with ``lines`` one per line as ``write_catalog`` writes them.
    """
    catalog = spark.read.schema(schemas.CATALOG).json(path, multiLine=not lines)
    return flatten_catalog(catalog)


def flatten_catalog(catalog: DataFrame) -> DataFrame:
    models = (
        catalog.select(F.explode("makes").alias("make"))
        .select("make.make_id", "make.make_name", F.explode("make.models").alias("model"))
    )
    return models.select(
        "make_id", "make_name", "model.model_id", "model.model_name",
        F.explode("model.years").alias("year"),
    )


def _payload_rows(payloads: DataFrame) -> DataFrame:
    return payloads.select("*", F.posexplode("Results").alias("_pos", "_row"))


def read_make_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored make payloads → make_id, make_name; the first row of an id wins."""
    schema = "Results array<struct<MakeId:bigint, MakeName:string>>"
    return first_makes(spark.read.schema(schema).json(path, multiLine=True))


def first_makes(payloads: DataFrame) -> DataFrame:
    rows = (
        _payload_rows(payloads)
        .select(F.col("_row.MakeId").alias("make_id"), F.col("_row.MakeName").alias("name"), "_pos")
        .where("make_id is not null and name <> ''")
    )
    first = Window.partitionBy("make_id").orderBy("_pos", "name")
    return (
        rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
        .select("make_id", catalog_title(F.col("name")).alias("make_name"))
    )


def read_model_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored model payloads, one file per make and year (``…/<make_id>/<year>.json``)."""
    schema = (
        "Results array<struct<Make_ID:bigint, Make_Name:string, Model_ID:bigint, "
        "Model_Name:string>>"
    )
    payloads = (
        spark.read.schema(schema).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path, multiLine=True)
        .withColumn("_file", F.input_file_name())
        .withColumn("request_make_id", F.regexp_extract("_file", r"/(\d+)/\d+\.json$", 1)
                    .try_cast("bigint"))
        .withColumn("year", F.regexp_extract("_file", r"/(\d+)\.json$", 1).try_cast("int"))
    )
    return first_models(payloads)


def first_models(payloads: DataFrame) -> DataFrame:
    """Rows with an id and a name; within one request the first row of a model id wins."""
    rows = _payload_rows(payloads).select(
        "request_make_id", "year", "_pos",
        F.col("_row.Model_ID").alias("model_id"), F.col("_row.Model_Name").alias("_model"),
        F.coalesce("_row.Make_ID", "request_make_id").alias("make_id"),
        F.coalesce(catalog_title(F.col("_row.Make_Name")), F.lit("")).alias("make_name"),
    ).where("model_id is not null and _model <> ''")
    first = Window.partitionBy("request_make_id", "year", "model_id").orderBy("_pos")
    return (
        rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
        .select("make_id", "make_name", "model_id",
                catalog_title(F.col("_model")).alias("model_name"), "year")
    )


def write_catalog(catalog: DataFrame, path: str) -> None:
    """JSON lines, a make each."""
    catalog.write.mode("overwrite").json(path)
