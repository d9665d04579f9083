"""Label expressions: canonical makes and models, class ids, class-string and category parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions import text
from motorgrid.functions.calc import generation_label, generation_year

__all__ = [
    "category_label", "class_id", "class_slug", "display_name", "generation_label",
    "generation_year", "listing_key", "normalize_make", "normalize_model", "parse_id_path",
    "parse_spaced_class", "parse_underscore_class",
]


def literal_map(pairs: dict) -> Column:
    """Constant map of text to text or numbers, built in one call."""
    def sql(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{float(value)!r}D"

    return F.expr("map(" + ", ".join(sql(x) for pair in pairs.items() for x in pair) + ")")


def normalize_make(col: Column) -> Column:
    """Alias spelling when known, else title case; blank is null."""
    bare = text.non_blank(col)
    return F.coalesce(
        F.try_element_at(literal_map(K.MAKE_ALIASES), F.lower(bare)), text.title_case(bare)
    )


def normalize_model(col: Column) -> Column:
    return text.title_case(text.non_blank(col))


def class_id(year: Column, make: Column, model: Column) -> Column:
    """``year|make|model`` in lower case, null when a part is missing or blank."""
    return text.join_parts(
        "|", year.cast("string"), F.lower(text.non_blank(make)), F.lower(text.non_blank(model))
    )


def display_name(col: Column) -> Column:
    """``2012|honda|civic`` → ``2012-2015 Honda Civic``; anything else unchanged."""
    parts = F.split(col, r"\|")
    year = F.get(parts, F.lit(0)).try_cast("int")
    named = F.concat_ws(
        " ", generation_label(year),
        text.title_case(F.get(parts, F.lit(1))), text.title_case(F.get(parts, F.lit(2))),
    )
    return F.when((F.size(parts) == 3) & year.isNotNull(), named).otherwise(col)


def class_slug(make: Column, model: Column, year: Column | None = None,
               body: Column | None = None) -> Column:
    """Storage folder of a class: ``year_make_model[_body]``; missing year or body left out."""
    parts = [p for p in (None if year is None else year.cast("string"), make, model, body)
             if p is not None]
    return text.slugify(F.concat_ws("_", *parts))


def listing_key(source: Column, digest: Column) -> Column:
    return F.concat(source, F.lit(":"), digest)


def parse_underscore_class(col: Column) -> Column:
    """``make_model[_yyyy]`` → struct(year, make, model, reason); reason null when parsed."""
    whole = text.strip(col)
    year = text.extract(whole, r"_(\d{4})\z").try_cast("int")
    body = F.regexp_replace(whole, r"_\d{4}\z", "")
    cut = F.instr(body, "_")
    make = text.strip(F.substring_index(body, "_", 1))
    model = text.strip(F.substr(body, cut + 1))
    reason = (
        F.when(whole.isNull() | (whole == ""), "empty class")
        .when(cut == 0, "no separator")
        .when(make == "", "empty make")
        .when(model == "", "empty model")
    )
    good = reason.isNull()
    return F.struct(
        F.when(good, year).alias("year"), F.when(good, make).alias("make"),
        F.when(good, model).alias("model"), reason.alias("reason"),
    )


def parse_id_path(col: Column) -> Column:
    """``[…/]image/<make>/<model>/<year>/<name>.jpg`` → struct(make_id, model_id, year, reason)."""
    path = F.when(col.startswith("image/") | ~col.contains("/image/"), col).otherwise(
        F.concat(F.lit("image/"), F.substring_index(col, "/image/", -1)))
    found = F.regexp_extract(path, r"^image/(\d+/\d+/[^/]+)/[^/]+\.jpg$", 1)

    def fields(part: Column) -> Column:
        make_id, model_id = part["make"].try_cast("bigint"), part["model"].try_cast("bigint")
        token = part["token"]
        year = token.try_cast("int")
        reason = (
            F.when(token.isNull(), "not an image path")
            .when((make_id <= 0) | (model_id <= 0), "non-positive id")
            .when((token == "5008") | ~token.rlike(r"^\d{4}$"), "unusable year")
            .when(~year.between(1900, 2099), "year out of range")
        )
        good = reason.isNull()
        return F.struct(
            F.when(good, make_id).alias("make_id"), F.when(good, model_id).alias("model_id"),
            F.when(good, year).alias("year"), reason.alias("reason"),
        )

    # The path is matched once per row, however many fields are taken.
    return text.let(F.split(found, "/"), lambda parts: text.let(F.struct(
        F.get(parts, F.lit(0)).alias("make"), F.get(parts, F.lit(1)).alias("model"),
        F.get(parts, F.lit(2)).alias("token")), fields))


def parse_spaced_class(df: DataFrame, column: str, makes: DataFrame) -> DataFrame:
    """``Make Model [Body] yyyy`` → columns year, make, model, body_style, reason.

    ``makes`` has one column ``make_name``. The longest known prefix of three, two or one words
    is the make, else the first word. The three lookups are equi joins, so the make table may be
    of any size; Spark broadcasts it when its measured size allows.
    """
    known = makes.select(F.lower("make_name").alias("_key")).where("_key is not null").distinct()
    whole = text.strip(F.col(column))
    staged = (
        df.withColumn("_year", text.extract(whole, r"\s(\d{4})\z").try_cast("int"))
        .withColumn("_prefix", text.strip(F.regexp_replace(whole, r"\s+\d{4}\z", "")))
        .withColumn("_words", F.filter(F.split("_prefix", r"\s+"), lambda w: w != ""))
    )
    for n in (3, 2, 1):
        candidate = F.when(
            F.size("_words") >= n, F.array_join(F.slice("_words", 1, n), " ")
        )
        staged = (
            staged.withColumn(f"_cand{n}", candidate)
            .join(
                known.select(F.col("_key").alias(f"_hit{n}")),
                F.lower(F.col(f"_cand{n}")) == F.col(f"_hit{n}"), "left",
            )
        )
    width = (
        F.when(F.col("_hit3").isNotNull(), 3).when(F.col("_hit2").isNotNull(), 2).otherwise(1)
    )
    staged = (
        staged.withColumn("_width", width)
        .withColumn("_make", F.array_join(F.slice("_words", F.lit(1), F.col("_width")), " "))
        .withColumn("_rest", F.slice(
            "_words", F.col("_width") + 1, F.greatest(F.size("_words"), F.lit(1))))
        .withColumn("_two", F.when(
            F.size("_rest") >= 2, F.array_join(F.slice("_rest", -2, 2), " ")))
        .withColumn("_one", F.try_element_at("_rest", F.lit(-1)))
        .withColumn(
            "_body",
            F.when(F.col("_two").isin(*K.CAB_STYLES), F.col("_two"))
            .when(F.col("_one").isin(*K.BODY_STYLES), F.col("_one")),
        )
        .withColumn("_body_words", F.when(F.col("_two").isin(*K.CAB_STYLES), 2)
                    .when(F.col("_body").isNotNull(), 1).otherwise(0))
        .withColumn("_model", F.array_join(F.slice(
            "_rest", F.lit(1), F.greatest(F.size("_rest") - F.col("_body_words"), F.lit(0))), " "))
    )
    reason = (
        F.when(whole.isNull() | (whole == ""), "empty class")
        .when(F.col("_year").isNull(), "no trailing year")
        .when(F.size("_words") == 0, "no make before year")
        .when(F.size("_rest") == 0, "no model after make")
        .when(F.col("_model") == "", "no model before body")
    )
    good = F.col("reason").isNull()
    return staged.withColumn("reason", reason).select(
        *[df[c] for c in df.columns],
        F.when(good, F.col("_year")).alias("year"),
        F.when(good, F.col("_make")).alias("make"),
        F.when(good, F.col("_model")).alias("model"),
        F.when(good, F.col("_body")).alias("body_style"),
        "reason",
    )


def _known_category_make(key: Column) -> Column:
    return key.isin(*K.MAKE_ALIASES, *K.CATEGORY_MAKES)


def _bare_category(col: Column) -> Column:
    title = text.strip(col)
    bare = F.when(
        F.lower(title).startswith("category:"), text.strip(F.substr(title, F.lit(10)))
    ).otherwise(title)
    return text.strip(F.regexp_replace(F.replace(bare, F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _category_year(cats: Column, year_min: int, year_max: int) -> Column:
    def in_range(year: Column) -> Column:
        return F.when(year.between(year_min, year_max), year)

    def explicit(cat: Column) -> Column:
        hit = F.coalesce(
            text.extract(cat, K.CATEGORY_YEAR_PATTERN, 1),
            text.extract(cat, K.CATEGORY_YEAR_PATTERN, 2),
        )
        return in_range(hit.try_cast("int"))

    def prefixed(cat: Column) -> Column:
        year = text.extract(cat, r"^(\d{4})\s+\S").try_cast("int")
        word = F.lower(F.regexp_extract(cat, r"^\d{4}\s+([^ ]+)", 1))
        return F.when(_known_category_make(word), in_range(year))

    def midpoint(cat: Column) -> Column:
        return in_range(text.extract(cat, K.CATEGORY_DECADE_PATTERN).try_cast("int") + 5)

    return F.coalesce(*[_first(F.transform(cats, rule)) for rule in (explicit, prefixed, midpoint)])


def _category_make(cats: Column) -> Column:
    def make(cat: Column) -> Column:
        bare = text.strip(F.regexp_replace(cat, K.CATEGORY_MAKE_SUFFIX, ""))
        word = F.substring_index(bare, " ", 1)
        return (
            F.when(_known_category_make(F.lower(bare)), normalize_make(bare))
            .when(_known_category_make(F.lower(word)), normalize_make(word))
        )

    return _first(F.transform(cats, make))


def _category_model(cats: Column, make: Column) -> Column:
    def model(cat: Column) -> Column:
        tail = F.substr(cat, F.length(make) + 1)
        named = F.lower(cat).startswith(F.lower(make)) & tail.rlike("^[ -]")
        return F.when(named, text.non_blank(F.regexp_replace(tail, r"^[ -]+|[ -]+\z", "")))

    return _first(F.transform(cats, model))


def category_label(categories: Column, year_min: int = 1800, year_max: int = 2099) -> Column:
    """struct(year, make, model) from category names; the struct is null unless all are found."""

    def label(cats: Column) -> Column:
        def with_make(make: Column) -> Column:
            year = _category_year(cats, year_min, year_max)
            model = _category_model(cats, make)
            triple = F.struct(year.alias("year"), make.alias("make"), model.alias("model"))
            return text.let(triple, lambda t: F.when(
                t["year"].isNotNull() & t["make"].isNotNull() & t["model"].isNotNull(), t))

        return text.let(_category_make(cats), with_make)

    return text.let(
        F.filter(F.transform(categories, _bare_category), lambda c: c != ""), label)
