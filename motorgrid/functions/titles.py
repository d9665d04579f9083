"""Year, make and model from free text, auction names and page titles; VINs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions import text
from motorgrid.functions.text import let

_FREE_STOPS = ("$", "(", ")", "|", "·")
_NAME_STOPS = ("-", "$", "(", ")", "|", "·", ":")


def _null_if_empty(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def _until(words: Column, stop) -> Column:
    """Leading words before the first one for which ``stop`` holds."""
    marks = F.transform(words, lambda w, i: F.when(stop(w), i))
    first = F.get(F.filter(marks, lambda m: m.isNotNull()), F.lit(0))
    return F.slice(words, F.lit(1), F.coalesce(first, F.size(words)))


def _stops(marks: tuple[str, ...]):
    return lambda w: w.isin(*marks) | w.rlike(r"^[$(|]")


def _after(words: Column, start: Column) -> Column:
    """Words from the zero-based position on."""
    return F.slice(words, start + 1, F.greatest(F.size(words), F.lit(1)))


def _make_hit(words: Column, start: Column, makes: Iterable[str]) -> Column:
    """First position from ``start`` where two words, else one, are a known make."""
    known = tuple(makes)
    lowered = F.transform(words, F.lower)

    def probe(low: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            pair = F.concat(word, F.lit(" "), F.get(low, i + 1))
            return (
                F.when(i < start, F.lit(None))
                .when(pair.isin(*known),
                      F.struct(pair.alias("make"), F.lit(2).alias("width"), (i + 2).alias("end")))
                .when(word.isin(*known),
                      F.struct(word.alias("make"), F.lit(1).alias("width"), (i + 1).alias("end")))
            )

        return F.get(F.filter(F.transform(low, at), lambda h: h.isNotNull()), F.lit(0))

    return let(lowered, probe)


def free_title(col: Column, current_year: int,
               makes: Iterable[str] = K.KNOWN_TITLE_MAKES) -> Column:
    """struct(year, make, model) from a free-text listing title."""

    def body(words: Column) -> Column:
        def found(hit: Column) -> Column:
            make = hit["make"]
            named = F.when(
                (hit["width"] == 1) & (F.length(make) <= 3), F.upper(make)
            ).otherwise(text.title_case(make))
            year = text.parse_year(col, current_year)
            rest = _until(_after(words, hit["end"]), _stops(_FREE_STOPS))
            kept = F.filter(rest, lambda w: ~F.coalesce(w == year.cast("string"), F.lit(False)))
            model = _null_if_empty(F.transform(F.slice(kept, 1, 2), text.token_title))
            return F.struct(year.alias("year"), named.alias("make"), model.alias("model"))

        return let(_make_hit(words, F.lit(0), makes), found)

    return let(F.coalesce(text.tokens(col), F.array().cast("array<string>")), body)


def auction_name(col: Column, makes: Iterable[str] = K.KNOWN_TITLE_MAKES) -> Column:
    """struct(make, model, trim) from an auction name; scanning starts after the year word."""

    def body(words: Column) -> Column:
        years = F.filter(
            F.transform(words, lambda w, i: F.when(w.rlike(r"^\d{4}$"), i + 1)),
            lambda m: m.isNotNull(),
        )
        start = F.coalesce(F.get(years, F.lit(0)), F.lit(0))

        def found(hit: Column) -> Column:
            rest = _until(_after(words, hit["end"]), _stops(_NAME_STOPS))

            def named(run: Column) -> Column:
                model = F.get(run, F.lit(0))
                return F.struct(
                    text.segment_title(hit["make"]).alias("make"),
                    text.token_title(model).alias("model"),
                    _null_if_empty(F.transform(_after(run, F.lit(1)), text.token_title))
                    .alias("trim"),
                )

            return let(rest, named)

        return let(_make_hit(words, start, makes), found)

    return let(F.coalesce(text.tokens(col), F.array().cast("array<string>")), body)


def page_title(col: Column, current_year: int) -> Column:
    """struct(year, make, model, trim) from a page title: the words after the year."""
    bare = text.strip(F.regexp_replace(col, r"\s*\|\s*Cars\.com\s*$", ""))

    def body(year: Column) -> Column:
        def split_words(words: Column) -> Column:
            at = F.array_position(words, year.cast("string")).cast("int")

            def parts(rest: Column) -> Column:
                trim = _until(
                    _after(rest, F.lit(2)),
                    lambda w: F.lower(w).isin("for", "sale") | w.startswith("$"),
                )
                return F.struct(
                    year.alias("year"), F.get(rest, F.lit(0)).alias("make"),
                    F.get(rest, F.lit(1)).alias("model"), _null_if_empty(trim).alias("trim"),
                )

            return let(F.when(at > 0, _after(words, at)), parts)

        return let(text.tokens(bare, r"(?U)\s+"), split_words)

    return let(text.parse_year(col, current_year), body)


def vin(attributes: Column, body: Column) -> Column:
    """Labelled VIN of the (lower-cased) attributes, else the first one in the body."""
    return F.coalesce(
        F.upper(text.extract(attributes, r"vin:\s*([a-hj-npr-z0-9]{17})\b")),
        text.extract(F.upper(body), r"\b([A-HJ-NPR-Z0-9]{17})\b"),
    )
