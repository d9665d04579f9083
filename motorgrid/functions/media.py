"""Media types and content-addressed paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions.labels import literal_map


def media_type(header: Column) -> Column:
    """Bare type before ``;``, lower case; missing header is the empty string."""
    return F.coalesce(F.lower(F.trim(F.substring_index(header, ";", 1))), F.lit(""))


def media_extension(header: Column) -> Column:
    """File extension, null for an unsupported type."""
    return F.try_element_at(literal_map(K.MEDIA_EXTENSIONS), media_type(header))


def content_path(source: Column, listing_id: Column, digest: Column, extension: Column,
                 root: str | None = None) -> Column:
    """``<root>/<source>/<listing_id>/<digest><extension>``."""
    parts = [source, listing_id, F.concat(digest, extension)]
    return F.concat_ws("/", *([F.lit(root)] if root else []), *parts)


def synthetic_url(scheme: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), F.concat_ws("/", *[p.cast("string") for p in parts]))
