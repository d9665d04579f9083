"""String expressions: casing, trimming, slugs, number and year parsing, hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but later filters never get copies of the expressions.

    Catalyst pushes a filter through a projection by inlining what it refers to, which multiplies
    long parsing expressions. A generator with exactly one row stops that.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.drop(*columns).select("*", F.inline(F.array(made)))


# The characters Python's str.strip removes.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove white space of every Unicode kind at both ends (plain ``trim`` removes blanks)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def non_blank(col: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def capitalize(col: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(col.substr(1, 1)), F.lower(F.substr(col, F.lit(2))))


def map_runs(col: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """Cut text into the runs of ``pattern`` (one group, covering everything) and rejoin."""
    runs = F.regexp_extract_all(col, F.lit(pattern), F.lit(1))
    return F.array_join(F.transform(runs, body), "")


def title_case(col: Column) -> Column:
    """Capital after every non-letter: ``f-150`` → ``F-150``, ``3series`` → ``3Series``."""
    return map_runs(F.lower(col), r"(\p{L}+|\P{L}+)", capitalize)


def catalog_title(col: Column) -> Column:
    """Collapse white space and capitalise each word."""
    words = F.split(strip(col), rf"(?U){_WS}+")
    return F.array_join(F.transform(words, capitalize), " ")


def token_title(col: Column) -> Column:
    """Capitalise each run of ASCII letters, keep everything else."""
    return map_runs(
        col, r"([a-zA-Z]+|[^a-zA-Z]+)",
        lambda run: F.when(run.rlike("^[a-zA-Z]"), capitalize(run)).otherwise(run),
    )


def segment_title(col: Column) -> Column:
    """Capitalise each segment between blanks and hyphens: ``bmw`` → ``Bmw``."""
    return map_runs(F.lower(col), r"([^ -]+|[ -]+)", capitalize)


def slugify(col: Column) -> Column:
    """Anything but letters, digits, ``-`` and ``_`` becomes one ``_``; none at the ends."""
    safe = F.regexp_replace(col, r"[^\p{L}\p{N}_-]", "_")
    return F.regexp_replace(F.regexp_replace(safe, "_+", "_"), r"^_|_\z", "")


def hyphen_slug(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit(" "), F.lit("-"))


def parse_digits(col: Column) -> Column:
    """All digits joined as a number, null when there is none."""
    return F.regexp_replace(col, r"\D", "").try_cast("bigint")


def parse_year(col: Column, current_year: int) -> Column:
    """First isolated four-digit run between 1900 and next year."""
    runs = F.regexp_extract_all(col, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1))
    years = F.transform(runs, lambda run: run.cast("int"))
    return F.get(F.filter(years, lambda y: y.between(1900, current_year + 1)), F.lit(0))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null instead of the empty string when it does not match."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def text_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def tokens(col: Column, separators: str = r"[\s,/]+") -> Column:
    return F.filter(F.split(strip(col), separators), lambda t: t != "")


def choice_index(col: Column, candidates: int | Column) -> Column:
    """First integer in the text when it lies in [0, candidates), else -1."""
    n = F.lit(candidates) if isinstance(candidates, int) else candidates
    value = F.regexp_extract(col, r"(\d+)", 1).try_cast("bigint")
    return F.when(value.isNotNull() & (value < n), value).otherwise(F.lit(-1)).cast("int")


def key_value(col: Column, key: str) -> Column:
    """Value after ``key:`` up to the next pipe in a lower-cased attribute blob."""
    return extract(col, rf"\Q{key}\E:\s*([^|]+?)\s*(?:\||\z)")


def join_parts(sep: str, *parts: Column) -> Column:
    """Joined text, null as soon as one part is null."""
    every = parts[0].isNotNull()
    for part in parts[1:]:
        every = every & part.isNotNull()
    return F.when(every, F.concat_ws(sep, *parts))
