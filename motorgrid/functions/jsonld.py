"""Vehicle fields out of JSON-LD blocks and embedded page state, as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions import html as H
from motorgrid.functions import text
from motorgrid.functions.text import let


def child(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "variant")


def _kind(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node), F.lit("VOID"))


def _raw(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def _elements(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>")


# Casts look one level deep; schema_of_variant would walk the whole tree.
def _is_list(node: Column) -> Column:
    return _elements(node).isNotNull()


def _is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def truthy(node: Column) -> Column:
    """The node when it is neither null nor empty, zero or false."""
    return F.when(~_raw(node).isin("", "0", "0.0", "false", "[]", "{}"), node)


def as_text(node: Column) -> Column:
    """Stripped string of a JSON string; other types are null."""
    return F.when(_kind(node) == "STRING", text.non_blank(_raw(node)))


def name_or_text(node: Column) -> Column:
    return F.when(_is_object(node), as_text(child(node, "$.name"))).otherwise(as_text(node))


def as_integer(node: Column) -> Column:
    """JSON number cut to an integer, or the digits of a string."""
    number = F.when(
        _kind(node).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"),
        F.try_variant_get(node, "$", "double").cast("bigint"))
    return F.coalesce(number, F.when(_kind(node) == "STRING", text.parse_digits(_raw(node))))


def blocks(marked: Column) -> Column:
    """array<variant> of the JSON-LD objects of a page (as ``html.markup`` gives it).

    Lists and @graph lists are opened to any depth, in order; malformed blocks are skipped.
    """
    def open_once(found: Column) -> Column:
        return F.flatten(F.transform(found, lambda node: F.coalesce(
            _elements(node), F.try_variant_get(node, '$["@graph"]', "array<variant>"),
            F.array(node))))

    def is_closed(node: Column) -> Column:
        return _is_list(node) | F.try_variant_get(node, '$["@graph"]', "array<variant>").isNotNull()

    # A text nests at most as deep as it has brackets: that many rounds end every nesting. A round
    # with nothing left to open costs one comparison.
    def open_all(parsed: Column, brackets: Column) -> Column:
        def state(found: Column) -> Column:
            return let(found, lambda some: F.struct(
                some.alias("found"), F.exists(some, is_closed).alias("left")))

        return F.aggregate(
            F.sequence(F.lit(1), brackets), state(parsed),
            lambda held, _: F.when(held["left"], state(open_once(held["found"]))).otherwise(held))["found"]

    def of_scripts(raw: Column) -> Column:
        parsed = F.filter(F.transform(raw, lambda r: F.try_parse_json(text.strip(r))),
                          lambda node: node.isNotNull())
        longest = F.array_max(F.transform(raw, lambda r: F.length(r) - F.length(F.translate(r, "[", ""))))
        return open_all(parsed, F.greatest(longest, F.lit(1)))

    scripts = H.scripts(marked, lambda tag: F.lower(H.attribute(tag, "type")) == "application/ld+json")
    return F.filter(let(scripts, of_scripts), _is_object)


def _types(node: Column) -> Column:
    """Lower-case ``@type`` names; a single name is a list of one."""
    kind = child(node, '$["@type"]')
    names = F.coalesce(
        F.try_variant_get(kind, "$", "array<string>"), F.array(_raw(kind)))
    return F.transform(names, lambda name: F.lower(name))


def find_vehicle(found: Column) -> Column:
    """First block of the best type: Vehicle, then Car, then Product."""
    typed = F.transform(found, lambda b: F.struct(b.alias("node"), _types(b).alias("types")))

    def first(blocks_: Column, name: str) -> Column:
        return F.get(F.filter(
            blocks_, lambda t: F.array_contains(t["types"], name)), F.lit(0))["node"]

    return let(typed, lambda t: F.coalesce(*[first(t, name) for name in K.VEHICLE_TYPES]))


def image_urls(node: Column) -> Column:
    """http(s) URLs of a string, a list or image objects, without repeats."""
    items = F.when(_is_list(node), _elements(node)).otherwise(F.array(node))

    def url(item: Column) -> Column:
        nested = F.coalesce(truthy(child(item, "$.url")), truthy(child(item, "$.contentUrl")))
        return F.when(_is_object(item), as_text(nested)).otherwise(as_text(item))

    return F.array_distinct(F.filter(
        F.transform(items, url), lambda u: u.rlike("^https?://")))


def _first_truthy(node: Column, *keys: str) -> Column:
    return F.coalesce(*[truthy(child(node, f"$.{key}")) for key in keys])


def vehicle_fields(node: Column, current_year: int) -> Column:
    """struct of the block's vehicle fields; ``brand_make`` also looks at the brand."""
    maker = child(node, "$.manufacturer")
    year = as_text(_first_truthy(node, "vehicleModelDate", "modelDate", "productionDate"))
    mileage = child(node, "$.mileageFromOdometer")
    odometer = F.when(_is_object(mileage), as_integer(child(mileage, "$.value"))).otherwise(
        as_integer(mileage))
    return F.struct(
        as_text(child(node, "$.name")).alias("name"),
        text.parse_year(year, current_year).alias("year"),
        name_or_text(maker).alias("make"),
        name_or_text(_first_truthy(node, "manufacturer", "brand")).alias("brand_make"),
        name_or_text(child(node, "$.model")).alias("model"),
        as_text(_first_truthy(node, "vehicleConfiguration", "trim")).alias("trim"),
        odometer.alias("mileage"),
        as_text(child(node, "$.vehicleIdentificationNumber")).alias("vin"),
        as_text(child(node, "$.bodyType")).alias("body_style"),
        image_urls(child(node, "$.image")).alias("image_urls"),
    )


def page_state(marked: Column) -> Column:
    """Variant of the embedded vehicle state, null when absent, malformed or no object."""
    raw = F.get(H.scripts(marked, lambda tag: H.attribute(tag, "id") == K.STATE_SCRIPT_ID), F.lit(0))
    return let(F.try_parse_json(text.strip(raw)), lambda s: F.when(_is_object(s), s))


def state_fields(state: Column) -> Column:
    """struct of the fields in the two sub-trees; the first usable value wins."""
    def values(dimension: str, flat: str) -> list[Column]:
        rich = child(state, f"$.call_source_dni_metadata.dimensions.{dimension}")
        first = F.when(_is_list(rich), F.get(_elements(rich), F.lit(0))).otherwise(rich)
        return [first, child(state, f"$.dealer_chat_metadata.carsData.{flat}")]

    def text_of(dimension: str, flat: str) -> Column:
        return F.coalesce(*[as_text(v) for v in values(dimension, flat)])

    def integer_of(name: str) -> Column:
        return F.coalesce(*[as_integer(v) for v in values(name, name)])

    return F.struct(
        integer_of("year").cast("int").alias("year"), text_of("make", "make").alias("make"),
        text_of("model", "model").alias("model"), text_of("trim", "trim").alias("trim"),
        integer_of("mileage").alias("mileage"), text_of("vin", "vin").alias("vin"),
        text.title_case(text_of("bodyStyle", "bodystyle")).alias("body_style"),
    )
