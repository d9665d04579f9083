"""Fixed table schemas."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "timestamp": T.TimestampType(),
}


def _struct(**fields: str | T.DataType) -> T.StructType:
    """Built field by field: parsing DDL would need a running session on import."""
    return T.StructType([
        T.StructField(name, _TYPES[kind] if isinstance(kind, str) else kind)
        for name, kind in fields.items()])


LISTINGS = _struct(
    listing_id="string", source="string", url="string", year="int", make="string", model="string",
    trim="string", body_style="string", mileage="int", vin="string", raw_html_sha256="string",
    scraped_at="timestamp", split="string", canonical_make="string", canonical_model="string",
    generation_year="int",
)
IMAGES = _struct(
    image_id="string", listing_id="string", source_url="string", local_path="string",
    phash="string", width="int", height="int", bytes="bigint", position="int",
    downloaded_at="timestamp", view="string", view_score="double", view_labeled_at="timestamp",
    split="string",
)
CRAWL_QUEUE = _struct(
    url="string", source="string", kind="string", target_year="int", target_make="string",
    target_model="string", parent_listing_id="string", status="string", attempts="int",
    last_error="string", next_try_at="timestamp", enqueued_at="timestamp", claimed_at="timestamp",
)
CATALOG = _struct(
    meta=_struct(
        generated_at="string", source="string", year_range=T.ArrayType(T.IntegerType()),
        total_makes="int", total_models="int", total_class_entries="bigint"),
    makes=T.ArrayType(_struct(
        make_id="bigint", make_name="string", models=T.ArrayType(_struct(
            model_id="bigint", model_name="string", years=T.ArrayType(T.IntegerType()))))),
)
TABLES = {"listings": LISTINGS, "images": IMAGES, "crawl_queue": CRAWL_QUEUE}

# Columns an update may touch.
LISTING_UPDATABLE = (
    "year", "make", "model", "trim", "body_style", "mileage", "vin", "raw_html_sha256", "split",
    "canonical_make", "canonical_model", "generation_year",
)
