"""URL expressions: parts, sources, native ids, resolution, search templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions import text
from motorgrid.functions.labels import literal_map
from motorgrid.functions.text import let

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.-]*"
_PARTS = rf"^(?:({_SCHEME}):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def host(url: Column) -> Column:
    return text.extract(F.lower(url), rf"^(?:{_SCHEME}:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def path(url: Column) -> Column:
    return _part(url, 3)


def source_for_url(url: Column) -> Column:
    """Source whose site serves the URL, null for an unknown host."""
    name = host(url)
    return F.coalesce(
        F.try_element_at(literal_map(K.HOST_SOURCES), name),
        F.when(name.endswith("." + K.CRAIGSLIST_DOMAIN) | (name == K.CRAIGSLIST_DOMAIN),
               "craigslist"),
    )


def is_inventory_listing(url: Column) -> Column:
    """Either vehicle-detail folder, ending in an id of six or more digits."""
    where = path(url)
    return (
        where.contains("/cars-for-sale/vehicledetails/")
        | where.contains("/cars-for-sale/vehicle/")
    ) & where.rlike(r"[/-]\d{6,}/?$")


def is_auction_listing(url: Column) -> Column:
    """``/auctions/`` with one or two further segments."""
    where = path(url)
    segments = F.filter(F.split(where, "/"), lambda s: s != "")
    return where.startswith("/auctions/") & F.size(segments).isin(2, 3)


SITEMAP_FILTERS = {"autotrader": is_inventory_listing, "carsandbids": is_auction_listing}


def native_id(url: Column, source: Column) -> Column:
    """Site's own id or slug of a listing URL."""
    picked = None
    for name, pattern in K.NATIVE_ID_PATTERNS.items():
        value = text.extract(url if name == "cars_com" else path(url), pattern)
        picked = F.when(source == name, value) if picked is None \
            else picked.when(source == name, value)
    return picked


def strip_tracking(query: Column) -> Column:
    """Query string without ``utm_*`` parameters, order and duplicates kept."""
    kept = F.filter(
        F.split(query, "&"), lambda pair: (pair != "") & ~pair.startswith("utm_"))
    return F.array_join(kept, "&")


def _resolve_dots(segments: Column) -> Column:
    """Apply ``.`` and ``..`` segments; a trailing one leaves a folder."""
    stack = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc).otherwise(F.array_append(acc, seg)),
    )
    folder = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(
        F.when(folder, F.array_append(stack, F.lit(""))).otherwise(stack), "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _merged_path(base_path: Column, ref_path: Column) -> Column:
    folders = F.when(
        base_path.endswith("/") | (base_path == ""), F.split(base_path, "/")
    ).otherwise(F.split(F.regexp_replace(base_path, r"/?[^/]*\z", ""), "/"))
    relative = let(
        F.concat(folders, F.split(ref_path, "/")),
        lambda segs: F.filter(
            segs, lambda s, i: (i == 0) | (i == F.size(segs) - 1) | (s != "")),
    )
    return let(
        F.when(ref_path.startswith("/"), F.split(ref_path, "/")).otherwise(relative),
        _resolve_dots,
    )


def normalize_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base``, drop the fragment and ``utm_*`` parameters."""

    def resolve(parts: Column) -> Column:
        b, r = parts["b"], parts["r"]
        absolute = (r["scheme"] != "") & (F.lower(r["scheme"]) != F.lower(b["scheme"]))
        own_host = absolute | (r["netloc"] != "")
        own_path = own_host | (r["path"] != "")
        scheme = F.lower(F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]))
        netloc = F.when(own_host, r["netloc"]).otherwise(b["netloc"])
        where = (
            F.when(own_host, r["path"]).when(r["path"] == "", b["path"])
            .otherwise(_merged_path(b["path"], r["path"]))
        )
        query = F.when(own_path | (r["query"] != ""), r["query"]).otherwise(b["query"])
        clean = strip_tracking(F.regexp_replace(query, r"^\?", ""))
        rooted = F.when(
            (netloc != "") & (where != "") & ~where.startswith("/"), F.concat(F.lit("/"), where)
        ).otherwise(where)
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), netloc, rooted,
            F.when(clean != "", F.concat(F.lit("?"), clean)).otherwise(""),
        )

    def pieces(url: Column) -> Column:
        return F.struct(
            _part(url, 1).alias("scheme"), _part(url, 2).alias("netloc"),
            _part(url, 3).alias("path"), _part(url, 4).alias("query"),
        )

    # Most links are absolute, or rooted without dots: those need no general resolution.
    return (
        F.when(href.rlike(r"^https?://[^/?#;]+(/[^?#;]*)?$"), href)
        .when(href.rlike(r"^/[^/?#;][^?#;]*$") & ~href.contains("/.")
              & base.rlike(r"^https?://[^/?#]"),
              F.concat(F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), href))
        .otherwise(let(F.struct(pieces(base).alias("b"), pieces(href).alias("r")), resolve))
    )


def form_encode(col: Column) -> Column:
    encoded = F.replace(F.url_encode(col), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def search_urls(site: str, make: Column, model: Column, year_min: Column, year_max: Column,
                cities: tuple[str, ...] = K.CRAIGSLIST_CITIES) -> Column:
    """Search URLs of a site for one class and year range, as an array."""
    make_slug, model_slug = text.hyphen_slug(make), text.hyphen_slug(model)
    phrase = form_encode(F.concat_ws(" ", make, model))
    lo, hi = year_min.cast("string"), year_max.cast("string")

    def url(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    if site == "cars_com":
        return F.array(url(
            "https://www.cars.com/shopping/results/?makes[]=", make_slug, "&models[]=", make_slug,
            "-", model_slug, "&year_min=", lo, "&year_max=", hi, "&stock_type=all"))
    if site == "autotrader":
        return F.array(url(
            "https://www.autotrader.com/cars-for-sale/all-cars/", make_slug, "/", model_slug,
            "?yearMin=", lo, "&yearMax=", hi))
    if site == "craigslist":
        return F.array(*[url(
            f"https://{city}.craigslist.org/search/cta?auto_make_model=", phrase,
            "&min_auto_year=", lo, "&max_auto_year=", hi, "&query=", phrase) for city in cities])
    if site == "bat":
        return F.array(url(
            "https://bringatrailer.com/", make_slug, "/", model_slug, "/?year_min=", lo,
            "&year_max=", hi))
    if site == "hemmings":
        return F.array(url(
            "https://www.hemmings.com/classifieds/cars-for-sale/", make_slug, "/", model_slug,
            "?YearFrom=", lo, "&YearTo=", hi))
    if site == "carsandbids":
        return F.array(url(
            "https://carsandbids.com/search?q=", phrase, "&year_min=", lo, "&year_max=", hi))
    raise ValueError(f"unknown site: {site!r}")
