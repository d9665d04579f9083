"""Numeric and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorgrid import constants as K


def generation_year(year: Column) -> Column:
    """Start of the four-year bucket anchored at 1980; floor division also before the anchor."""
    steps = F.floor((year - K.GENERATION_ANCHOR) / K.GENERATION_YEARS)
    return (K.GENERATION_ANCHOR + steps * K.GENERATION_YEARS).cast("int")


def generation_label(year: Column) -> Column:
    start = generation_year(year)
    return F.concat(start.cast("string"), F.lit("-"),
                    (start + K.GENERATION_YEARS - 1).cast("string"))


def era_bucket(year: Column, size: int = 10) -> Column:
    """Decade (``2010s``) or ``start-end`` bucket; null year is ``unknown``."""
    if size <= 0:
        label = year.cast("string")
    else:
        start = (F.floor(year / size) * size).cast("int")
        label = (
            F.concat(start.cast("string"), F.lit("s")) if size == 10
            else F.concat(start.cast("string"), F.lit("-"), (start + size - 1).cast("string"))
        )
    return F.coalesce(label, F.lit(K.UNKNOWN))


def recency_weight(year_max: Column, current_year: int) -> Column:
    age = F.lit(current_year) - year_max
    return (
        F.when(age <= 0, 1.0)
        .when(age >= K.RECENCY_FLOOR_AGE, K.RECENCY_FLOOR)
        .otherwise(F.exp(-age / K.RECENCY_TAU))
    )


def backoff_seconds(attempts: Column) -> Column:
    """Doubling delay, capped at an hour."""
    return F.least(F.pow(F.lit(2.0), attempts), F.lit(float(K.BACKOFF_CAP_SECONDS))).cast("int")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def round_half_even(value: Column) -> Column:
    return F.rint(value).cast("bigint")


def is_off_peak(ts: Column, start_hour: int, end_hour: int) -> Column:
    """Hour in the half-open window, which may cross midnight; equal ends mean never."""
    hour = F.hour(ts)
    if start_hour == end_hour:
        return F.when(hour.isNotNull(), False)
    if start_hour < end_hour:
        return (hour >= start_hour) & (hour < end_hour)
    return (hour >= start_hour) | (hour < end_hour)


def view_index(view: Column) -> Column:
    """0-4 for the exterior views, 5 for any non-exterior one, null for an unknown label."""
    picked = F.when(view.isin(*K.NON_EXTERIOR_VIEWS), len(K.EXTERIOR_VIEWS))
    for index, name in enumerate(K.EXTERIOR_VIEWS):
        picked = picked.when(view == name, index)
    return picked


def binary_view_index(view: Column) -> Column:
    return F.when(view.isin(*K.EXTERIOR_VIEWS), 0).when(view.isin(*K.NON_EXTERIOR_VIEWS), 1)


def hash_split(key: Column) -> Column:
    """train / val / test from the first SHA-1 byte modulo ten: 0-7, 8, 9."""
    bucket = F.conv(F.substring(F.sha1(key), 1, 2), 16, 10).cast("int") % 10
    return F.when(bucket < 8, "train").when(bucket == 8, "val").otherwise("test")
