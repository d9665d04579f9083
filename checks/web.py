"""URLs, stored pages and sitemaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import RAW_MAKES, big, canonical, listings, now, over, pick, query, queue, r6, sql_list, table
from motorgrid import constants as K
from motorgrid.functions import html as H
from motorgrid.functions import jsonld, text, urls
from motorgrid.operators import catalog, crawlqueue, pages, sitemaps
from motorgrid.plans.batches import apply_page_results
from motorgrid.sources.sitemaps import sitemap_links

_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"


@query("url_source", rf"""
    SELECT page_id, coalesce(CASE page_id % 4 WHEN 0 THEN 'cars_com' WHEN 1 THEN 'craigslist'
      WHEN 2 THEN 'bat' END, 'unknown') AS source FROM pages""")
def _(spark, sf):
    host = pick(("www.CARS.com", "m.ny.craigslist.org", "u@bringatrailer.com:80", "x.example.com"),
                F.col("page_id") % 4)
    url = F.regexp_replace("url", r"^([a-z]+)://[^/?#]*", F.concat(F.lit("$1://"), host))
    return table(spark, sf, "pages").select(
        "page_id", F.coalesce(urls.source_for_url(url), F.lit("unknown")).alias("source"))


@query("url_host", rf"SELECT page_id, {_HOST} AS host FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("listing_url_predicates", """
    SELECT page_id, page_id % 3 = 0 AND page_id >= 0 AS inventory, page_id % 3 = 1 AS auction FROM pages""")
def _(spark, sf):
    tail = pick(("/cars-for-sale/vehicledetails/a-b-1234567/", "/auctions/9aQ/2017-x", "/auctions/a/b/bids"),
                F.col("page_id") % 3)
    url = F.regexp_replace("url", r"^([a-z]+://[^/?#]*)[^?#]*", F.concat(F.lit("$1"), tail))
    return table(spark, sf, "pages").select(
        "page_id", urls.is_inventory_listing(url).alias("inventory"),
        urls.is_auction_listing(url).alias("auction"))


# Listing URL of a numbered part: text before and after the number.
_LISTING_URLS = {
    "cars_com": ("https://www.cars.com/vehicledetail/id-", "/?x=1"),
    "autotrader": ("https://www.autotrader.com/cars-for-sale/vehicle/", ""),
    "craigslist": ("https://sfbay.craigslist.org/eby/cto/d/red-car/", ".html"),
    "bat": ("https://bringatrailer.com/listing/lot-", "/"),
    "hemmings": ("https://www.hemmings.com/classifieds/cars-for-sale/x/", "/"),
    "carsandbids": ("https://carsandbids.com/auctions/lot-", ""),
}


def _listing_url(source, number):
    prefix = suffix = None
    for name, (head, tail) in _LISTING_URLS.items():
        prefix = F.when(source == name, head) if prefix is None else prefix.when(source == name, head)
        suffix = F.when(source == name, tail) if suffix is None else suffix.when(source == name, tail)
    return F.concat(prefix, number.cast("string"), suffix)


_SRC_SQL = f"({sql_list(K.QUEUE_SOURCES)})[p_partkey % 6 + 1]"
_ID_SQL = f"""CASE {_SRC_SQL} WHEN 'cars_com' THEN 'id-' WHEN 'bat' THEN 'lot-' WHEN 'carsandbids'
    THEN 'lot-' ELSE '' END || (1000000 + p_partkey)"""


@query("native_listing_id", f"SELECT p_partkey, {_ID_SQL} AS native_id FROM part")
def _(spark, sf):
    source = pick(K.QUEUE_SOURCES, F.col("p_partkey") % 6)
    url = _listing_url(source, F.col("p_partkey") + 1000000)
    return table(spark, sf, "part").select("p_partkey", urls.native_id(url, source).alias("native_id"))


# Base URL without its last path segment, in SQL.
_SITE = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_DIR = rf"""({_SITE} || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) = '' THEN '/'
    ELSE regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*/|/)', 1) END)"""


@query("normalize_url", rf"""
    SELECT page_id, i, CASE i WHEN 0 THEN {_SITE} || '/a/d?k=1' WHEN 1 THEN {_DIR} || 'rel/x'
      WHEN 2 THEN 'https://other.org/p?q' WHEN 3 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.net/z'
      WHEN 4 THEN regexp_extract(url, '^([^?#]*)', 1) || '?page=2' END AS link
    FROM pages, range(5) t(i)""")
def _(spark, sf):
    hrefs = ("/a/b/../c/./../d?utm_source=x&k=1&utm_medium=y#frag", "rel/x", "https://other.org/p?q#f",
             "//cdn.net/z", "?page=2&utm_x=1")
    rows = table(spark, sf, "pages").select(
        "page_id", "url", F.posexplode(F.array(*[F.lit(h) for h in hrefs])).alias("i", "href"))
    return rows.select("page_id", big("i"), urls.normalize_url(F.col("url"), F.col("href")).alias("link"))


_LINKS = rf"""
    SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS position FROM (
      SELECT page_id, unnest(range(len(h))) AS pos, CASE WHEN unnest(h) LIKE '/%' THEN {_SITE} ||
        regexp_replace(unnest(h), '#.*', '') ELSE unnest(h) END AS link
      FROM (SELECT *, list_filter(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1), lambda x: x <> '')
        AS h FROM pages)) GROUP BY page_id, link"""


@query("page_links", _LINKS)
def _(spark, sf):
    return pages.page_links(table(spark, sf, "pages")).select("page_id", "link", big("position"))


@query("page_titles", r"""
    SELECT page_id, trim(replace(replace(replace(replace(replace(replace(
      regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
      '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS title FROM pages""")
def _(spark, sf):
    return _marked(table(spark, sf, "pages")).select("page_id", F.coalesce(
        pages.unescaped_title(F.col("shown")), F.lit("")).alias("title"))


# Markup that is easily misread: links in comments and scripts, ">" in values, "<" in text.
_DECOYS = (
    '<!-- <a href="/vehicledetail/none/">x</a><a rel="next" href="?page=99">n</a> --><p data-x="a>b" '
    'title=\'<a href="/no">\'>I <3 this car, 2 < 3' + " and more words" * 20 + "</p>"
    '<script>var a = "<a href=\\"/vehicledetail/script/\\">next</a>";</script>')


def _marked(df):
    """With the marked-up page, read once, and the same decoded."""
    marked = text.with_once(df, {"marked": H.markup(F.col("html"))})
    return text.with_once(marked, {"shown": H.decoded(F.col("marked"))})


# One page per part with two listing links (one of them twice), noise and a next link.
def _search_pages(spark, sf):
    part = table(spark, sf, "part").repartition(32)
    source = pick(K.QUEUE_SOURCES, F.col("p_partkey") % 6)
    first = _listing_url(source, F.col("p_partkey") + 1000000)
    second = _listing_url(source, F.col("p_partkey") + 2000000)
    tail = F.when(source == "cars_com", "&y=2").otherwise("")
    nexts = pick(('<a rel="prev next" href="?page=2&amp;utm_source=z">more</a>',
                  "<a aria-label='Next' href='/p/2'>›</a>", "<a href=\"/p/3\"> Next </a>",
                  "<a href=\"/p/1\">Previous</a>"), F.col("p_partkey") % 4)
    shown = F.concat(
        F.lit(f'<html><body>{_DECOYS}<a href="/about">About</a><a title="a>b" class="c" href="'), first,
        F.lit('">A</a>'),
        F.lit("<p><a href='"), second, F.lit("'><b>B</b></a> <a href=\""), first, tail,
        F.lit("\">again</a><a name=\"x\">no link</a>"), nexts, F.lit("</body></html>"))
    return part.select(
        F.concat(F.lit("https://site.example/s/"), F.col("p_partkey"), F.lit("/list")).alias("url"),
        source.alias("source"), F.lit("search").alias("kind"), shown.alias("html"),
        F.lit(2010).alias("target_year"), F.col("p_brand").alias("target_make"),
        F.col("p_name").alias("target_model"), "p_partkey")


def _url_sql(number):
    whens = " ".join(
        f"WHEN '{s}' THEN '{h}' || ({number}) || '{t}'" for s, (h, t) in _LISTING_URLS.items()
        if s != "cars_com")
    return (f"CASE {_SRC_SQL} WHEN 'cars_com' THEN 'https://site.example/vehicledetail/id-' || "
            f"({number}) || '/' {whens} END")


_FOUND = f"""
    SELECT p_partkey, {_SRC_SQL} AS source, i AS position, CASE i WHEN 0 THEN {_url_sql('1000000 + p_partkey')}
      WHEN 1 THEN {_url_sql('2000000 + p_partkey')} ELSE CASE p_partkey % 4
      WHEN 0 THEN 'https://site.example/s/' || p_partkey || '/list?page=2'
      WHEN 1 THEN 'https://site.example/p/2' WHEN 2 THEN 'https://site.example/p/3' END END AS url,
      CASE WHEN i < 2 THEN 'listing' ELSE 'search' END AS kind, p_brand AS target_make
    FROM part, range(3) t(i)"""


@query("discovered_urls", f"SELECT * FROM ({_FOUND}) WHERE url IS NOT NULL")
def _(spark, sf):
    found = pages.discovered_urls(_search_pages(spark, sf))
    return found.select(
        F.regexp_extract("page_url", r"/s/(\d+)/", 1).cast("bigint").alias("p_partkey"), "source",
        big("position"), "url", "kind", "target_make")


@query("next_page", f"""
    SELECT p_partkey, coalesce(url, 'none') AS next_url FROM ({_FOUND}) WHERE position = 2""")
def _(spark, sf):
    return pages.search_results(_search_pages(spark, sf)).select(
        "p_partkey", F.coalesce("next_url", F.lit("none")).alias("next_url"))


@query("search_page_notes", """
    SELECT page_id, 'no listing cards found' AS note FROM pages""")
def _(spark, sf):
    stored = table(spark, sf, "pages").select(
        "page_id", "url", "html", F.lit("bat").alias("source"), F.lit("search").alias("kind"))
    return pages.search_results(stored).select("page_id", "note")


def _json(value):
    return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))


def _object(**fields):
    parts = [F.lit("{")]
    for i, (key, value) in enumerate(fields.items()):
        parts += [F.lit((", " if i else "") + f'"{key}": '), value]
    return F.concat(*parts, F.lit("}"))


def _script(body, attrs='type="application/ld+json"'):
    return F.concat(F.lit(f"<script {attrs}>"), body, F.lit("</script>"))


def listing_pages(spark, sf):
    """One listing page per part, in the source's own style."""
    # The table is one small file: its rows are spread, so that all cores make and parse pages.
    part = table(spark, sf, "part").repartition(32)
    key, source = F.col("p_partkey"), pick(K.QUEUE_SOURCES, F.col("p_partkey") % 6)
    year = (2008 + F.col("p_size") % 8).cast("string")
    trim, model = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    make = F.trim(pick(RAW_MAKES, key % 8))
    vin = F.upper(F.substring(F.sha1(key.cast("string")), 1, 17))
    miles = F.floor("p_retailprice").cast("string")
    photos = F.concat(F.lit('["https://img/a'), key.cast("string"), F.lit(
        '.jpg", {"@type": "ImageObject", "url": "https://img/b.jpg"}, "https://img/b.jpg", "ftp://no"]'))
    full = dict(
        vehicleModelDate=_json(year), model=_object(name=_json(model)), trim=_json(trim),
        vehicleIdentificationNumber=_json(vin), bodyType=_json(F.lit("Sedan")),
        mileageFromOdometer=_object(value=miles), image=photos)
    car = _object(**{"@type": _json(F.lit("car")), "manufacturer": _object(name=_json(make)), **full})
    listed = _object(**{"@type": F.lit('["Thing", "Vehicle"]'), "brand": _json(make), **full,
                        "mileageFromOdometer": _json(F.concat(miles, F.lit(" mi")))})
    named = _object(**{"@type": _json(F.lit("Product")), "brand": F.lit("null"), "name": _json(
        F.concat_ws(" ", F.lit("No Reserve:"), year, F.lit("Honda"), model, trim, F.lit("- x")))})
    lot = _object(**{"@type": _json(F.lit("Product")), "brand": _json(make), "name": _json(
        F.concat_ws(" ", year, make))})
    state = _object(
        call_source_dni_metadata=_object(dimensions=_object(
            year=F.concat(F.lit("["), _json(year), F.lit("]")),
            make=F.concat(F.lit("["), _json(make), F.lit("]")), model=F.lit("[]"))),
        dealer_chat_metadata=_object(carsData=_object(
            model=_json(model), trim=_json(trim), mileage=miles, vin=_json(vin),
            bodystyle=_json(F.lit("sedan")))))
    # Lists and @graph wrappers, twenty deep.
    graph = F.concat(F.lit('{"@graph": [[{"@type": "Offer"}, ' + '{"@graph": [[' * 9), car,
                     F.lit("]]}" * 9 + "]]}"))
    broken = F.lit("{not json")
    gallery = F.concat(
        F.lit('<img slot="image" src="https://platform.cstatic-images.com/a'), key.cast("string"),
        F.lit('.jpg"><img slot="image" src="https://platform.cstatic-images.com/b.jpg">'
              '<img slot="image" src="https://other/x.jpg"><img src="https://platform.cstatic-images.com/c">'))
    classified = F.concat(
        F.lit('<span id="titletextonly">'), year, F.lit(" honda "), model, F.lit(
            ' ex</span><p class="attrgroup"><span>VIN: <b>'), vin, F.lit(
            "</b></span><span>odometer: <b>"), miles, F.lit(
            '</b></span><span>type: <b>sedan</b></span></p><section id="postingbody">Nice' + _DECOYS +
            '</section>'
            '<a class="thumb" href="https://img/a'), key.cast("string"), F.lit(
            '.jpg"></a><div class="gallery">' + "<div class='slide'>" * 20
            + '<img alt="a>b" src="https://img/b.jpg">' + "</div>" * 20 +
            '<img src="https://img/b.jpg"></div><img src="https://img/not-in-it.jpg">'))
    body = (
        F.when(source == "cars_com", F.when(F.col("p_size") % 2 == 0, _script(graph)).otherwise(
            F.concat(_script(state, f'type="application/json" id="{K.STATE_SCRIPT_ID}"'), gallery)))
        .when(source == "autotrader", F.concat(_script(broken), _script(car)))
        .when(source == "craigslist", classified).when(source == "bat", _script(named))
        .when(source == "hemmings", _script(lot))
        .otherwise(_script(F.concat(F.lit("["), listed, F.lit("]"))))
    )
    return part.select(
        "p_partkey", "p_size", source.alias("source"), F.lit("listing").alias("kind"),
        _listing_url(source, key + 1000000).alias("url"),
        F.concat(F.lit(f"<html><head></head><body>{_DECOYS}"), body, F.lit("</body></html>")).alias("html"),
        F.lit(1999).alias("target_year"), F.lit(None).cast("string").alias("target_make"),
        F.lit("hinted").alias("target_model"))


_RICH = "source IN ('cars_com', 'autotrader', 'carsandbids')"
_TRIM_MAKE = f"trim(({sql_list(RAW_MAKES)})[p_partkey % 8 + 1])"
PARSED_SQL = f"""
    SELECT source || ':' || {_ID_SQL} AS listing_id, source,
      CASE source WHEN 'craigslist' THEN '1999' ELSE (2008 + p_size % 8)::VARCHAR END AS year,
      CASE WHEN source IN ('bat', 'craigslist') THEN 'Honda' ELSE {_TRIM_MAKE} END AS make,
      CASE WHEN source IN ('hemmings', 'craigslist') THEN 'hinted' WHEN source = 'bat'
        THEN upper(model[1]) || model[2:] ELSE model END AS model,
      CASE WHEN {_RICH} THEN trim WHEN source = 'bat' THEN upper(trim[1]) || trim[2:] ELSE '' END AS trim,
      CASE WHEN {_RICH} OR source = 'craigslist' THEN 'Sedan' ELSE '' END AS body_style,
      CASE WHEN {_RICH} OR source = 'craigslist' THEN floor(p_retailprice)::INT ELSE 0 END::BIGINT AS mileage,
      CASE WHEN {_RICH} OR source = 'craigslist' THEN upper(sha1(p_partkey::VARCHAR)[:17]) ELSE '' END AS vin,
      CASE WHEN {_RICH} OR source = 'craigslist' THEN 2 ELSE 0 END::BIGINT AS n_images,
      CASE WHEN source = 'cars_com' AND p_size % 2 = 1 THEN 'page state used' ELSE '' END AS note
    FROM (SELECT *, {_SRC_SQL} AS source, split_part(p_name, ' ', 1) AS trim,
      split_part(p_name, ' ', 2) AS model FROM part)"""


@query("parse_listings", PARSED_SQL)
def _(spark, sf):
    parsed = pages.parse_listings(listing_pages(spark, sf), 2026)
    blank = F.lit("")
    return parsed.select(
        "listing_id", "source", F.col("year").cast("string").alias("year"),
        *[F.coalesce(c, blank).alias(c) for c in ("make", "model", "trim", "body_style", "vin", "note")],
        F.coalesce("mileage", F.lit(0)).cast("bigint").alias("mileage"),
        F.size("image_urls").cast("bigint").alias("n_images"))


@query("listing_image_items", f"""
    SELECT CASE WHEN source = 'cars_com' AND p_size % 2 = 1 THEN 'https://platform.cstatic-images.com/'
        ELSE 'https://img/' END || CASE WHEN i = 0 THEN 'a' || p_partkey ELSE 'b' END || '.jpg' AS url,
      source, 'image' AS kind, source || ':' || {_ID_SQL} AS parent_listing_id
    FROM (SELECT *, {_SRC_SQL} AS source FROM part), range(2) t(i)
    WHERE {_RICH} OR source = 'craigslist'""")
def _(spark, sf):
    return pages.image_items(pages.listing_images(listing_pages(spark, sf), 2026))


@query("jsonld_blocks", """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END
      WHEN 2 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN p_partkey % 6 IN (1, 5) OR p_partkey % 6 = 0 AND
      p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE '' END AS model FROM part""")
def _(spark, sf):
    found = text.with_once(_marked(listing_pages(spark, sf)), {"found": jsonld.blocks(F.col("marked"))})
    node = jsonld.find_vehicle(F.col("found"))
    return found.select(
        "p_partkey", F.size("found").cast("bigint").alias("n"),
        F.coalesce(jsonld.name_or_text(jsonld.child(node, "$.model")), F.lit("")).alias("model"))


@query("page_state_fields", """
    SELECT p_partkey, (2008 + p_size % 8)::BIGINT AS year, split_part(p_name, ' ', 2) AS model,
      'Sedan' AS body_style FROM part WHERE p_partkey % 6 = 0 AND p_size % 2 = 1""")
def _(spark, sf):
    state = _marked(listing_pages(spark, sf)).select(
        "p_partkey", jsonld.page_state(F.col("marked")).alias("s")).where("s is not null")
    return state.select("p_partkey", jsonld.state_fields(F.col("s")).alias("f")).select(
        "p_partkey", F.col("f.year").cast("bigint").alias("year"), "f.model", "f.body_style")


@query("classified_fields", """
    SELECT p_partkey, (2008 + p_size % 8)::BIGINT AS year, 'Honda' AS make, upper(split_part(p_name, ' ', 2)[1])
      || split_part(p_name, ' ', 2)[2:] || ' Ex' AS model, floor(p_retailprice)::BIGINT AS mileage,
      upper(sha1(p_partkey::VARCHAR)[:17]) AS vin FROM part WHERE p_partkey % 6 = 2""")
def _(spark, sf):
    shown = _marked(listing_pages(spark, sf).where("source = 'craigslist'")).select(
        "p_partkey", pages.classified_fields(F.col("url"), F.col("shown"), 2026).alias("f"))
    return shown.select("p_partkey", F.col("f.parsed.year").cast("bigint").alias("year"),
                        "f.parsed.make", "f.parsed.model", "f.mileage", "f.vin")


@query("gallery_images", """
    SELECT p_partkey, 'https://platform.cstatic-images.com/' || CASE i WHEN 0 THEN 'a' || p_partkey ELSE 'b'
      END || '.jpg' AS url FROM part, range(2) t(i) WHERE p_partkey % 6 = 0 AND p_size % 2 = 1""")
def _(spark, sf):
    return _marked(listing_pages(spark, sf)).select(
        "p_partkey", F.explode(pages.gallery_images(F.col("shown"))).alias("url"))


_STATUS = "([200, 200, 200, 403, 404, 429, 503, 0])[page_id % 8 + 1]"
_TAGGED = rf"""
    (SELECT page_id, url, html, status, concat_ws('|', CASE WHEN status = 0 THEN 'transport_error' END,
        CASE WHEN status = 403 THEN 'http_403' END, CASE WHEN status = 429 THEN 'http_429' END,
        CASE WHEN status >= 500 THEN 'http_5xx' END, CASE WHEN status = 404 THEN 'http_404' END,
        CASE WHEN status = 200 AND page_id % 5 = 0 THEN 'cloudflare_challenge' END,
        CASE WHEN status = 200 AND strlen(html) + len(x) < 8000 THEN 'unhydrated_shell' END,
        CASE WHEN status > 0 AND page_id % 3 = 0 THEN 'content_markers:/auctions/,auction-item' END,
        CASE WHEN status = 200 AND page_id % 3 <> 0 AND strlen(html) + len(x) >= 8000
          THEN 'parser_mismatch_candidate' END) AS tags, strlen(html) + len(x) AS n_bytes
    FROM (SELECT *, {_STATUS} AS status, CASE WHEN page_id % 3 = 0 THEN '<a href="/auctions/">auction-item'
        ELSE '' END || CASE WHEN page_id % 5 = 0 AND {_STATUS} = 200 THEN 'Just a moment' ELSE '' END AS x
      FROM pages))"""


def _tagged(spark, sf):
    status = F.nullif(pick((200, 200, 200, 403, 404, 429, 503, 0), F.col("page_id") % 8), F.lit(0))
    extra = F.concat(
        F.when(F.col("page_id") % 3 == 0, '<a href="/auctions/">auction-item').otherwise(""),
        F.when((F.col("page_id") % 5 == 0) & (status == 200), "Just a moment").otherwise(""))
    stored = table(spark, sf, "pages").select(
        "page_id", "url", F.concat("html", extra).alias("html"), status.alias("status"),
        F.lit("carsandbids").alias("source"))
    return pages.block_tags(stored)


@query("page_block_tags", f"SELECT page_id, tags FROM {_TAGGED}")
def _(spark, sf):
    return _tagged(spark, sf).select("page_id", F.array_join("tags", "|").alias("tags"))


@query("keep_page", f"""
    SELECT page_id, CASE WHEN status = 0 OR status >= 400 THEN false WHEN tags LIKE '%cloudflare%' THEN false
      WHEN tags LIKE '%unhydrated%' THEN false WHEN tags LIKE '%content_markers:%' THEN true
      ELSE n_bytes > 1000 END AS keep FROM {_TAGGED}""")
def _(spark, sf):
    return pages.keep_page(_tagged(spark, sf)).select("page_id", "keep")


@query("apply_page_results", over("v_listings", f"""
    , p AS (SELECT p_partkey, {_SRC_SQL} AS source, p_partkey % 7 = 3 AS failed FROM part),
    found AS (SELECT DISTINCT kind, url FROM (
      SELECT f.kind, f.url, f.source FROM ({_FOUND}) f JOIN p USING (p_partkey)
      WHERE f.url IS NOT NULL AND NOT failed))
    SELECT 'search' AS kind, CASE WHEN failed THEN 'failed' ELSE 'done' END AS status, count(*) AS n FROM p
      GROUP BY ALL
    UNION ALL SELECT kind, 'pending', count(*) FROM (SELECT DISTINCT ON (url) kind, url FROM found
      ORDER BY url, kind) GROUP BY kind"""))
def _(spark, sf):
    stored = _search_pages(spark, sf)
    start = crawlqueue.new_items(
        stored.select("url", "source", "kind", "target_year", "target_make", "target_model"), now())
    failed = F.col("p_partkey") % 7 == 3
    fetched = stored.select(
        F.col("url").alias("queue_url"), "url", F.when(~failed, F.col("html")).alias("html"),
        F.when(failed, "timeout").alias("error"))
    after = apply_page_results(start, listings(spark, sf), fetched, now(), 2026)["queue"]
    # Several sites share the example next-page links; they are queued once.
    return after.groupBy("kind", "status").agg(F.count("*").alias("n"))


def _catalog_rows(spark, sf):
    return canonical(spark, sf).where("year is not null").select(
        F.abs(F.hash("canonical_make")).cast("bigint").alias("make_id"),
        F.when(F.col("canonical_make") == "BMW", "Bmw").otherwise(F.col("canonical_make"))
        .alias("make_name"),
        F.abs(F.hash("canonical_model")).cast("bigint").alias("model_id"),
        F.col("canonical_model").alias("model_name"), "year")


_MODELS = """(SELECT CASE canonical_make WHEN 'BMW' THEN 'Bmw' ELSE canonical_make END AS make,
    canonical_model AS model, min(year) AS year_min, max(year) AS year_max,
    string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years,
    count(DISTINCT year) AS n FROM v_canonical WHERE year IS NOT NULL GROUP BY ALL)"""


@query("catalog_model_years", over("v_canonical", f"""
    SELECT make AS make_name, model AS model_name, years FROM {_MODELS}"""))
def _(spark, sf):
    return catalog.model_years(_catalog_rows(spark, sf)).select(
        "make_name", "model_name", F.array_join(F.transform(
            "years", lambda y: y.cast("string")), ",").alias("years"))


@query("catalog_document", over("v_canonical", f"""
    SELECT count(DISTINCT make) AS total_makes, count(*) AS total_models, sum(n)::BIGINT AS total_class_entries,
      string_agg(DISTINCT make, ',' ORDER BY make) AS makes FROM {_MODELS}"""))
def _(spark, sf):
    doc = catalog.build_catalog(_catalog_rows(spark, sf), "parts", "2026-01-01", (1990, 2030))
    totals = ("total_makes", "total_models", "total_class_entries")
    return doc.groupBy(*[F.col(f"meta.{c}").cast("bigint").alias(c) for c in totals]).agg(
        F.array_join(F.array_sort(F.collect_list(F.col("makes")[0]["make_name"])), ",").alias("makes"))


@query("catalog_totals", over("v_canonical", f"""
    SELECT count(DISTINCT make) AS total_makes, count(*) AS total_models, sum(n)::BIGINT AS total_class_entries
    FROM {_MODELS}"""))
def _(spark, sf):
    return catalog.catalog_totals(catalog.model_years(_catalog_rows(spark, sf)))


_WEIGHTS = " ".join(f"WHEN '{m}' THEN {w}" for m, w in K.MAKE_POPULARITY.items())
_RANKED = f"""(SELECT *, (CASE make {_WEIGHTS} ELSE 0.3 END)::DOUBLE * CASE WHEN 2020 - year_max <= 0 THEN 1
    ELSE exp(-(2020 - year_max) / 15.0) END AS score FROM {_MODELS} ORDER BY score DESC, make, model LIMIT 30)"""


@query("rank_models", over("v_canonical", f"""
    SELECT make, model, year_min::BIGINT AS year_min, year_max::BIGINT AS year_max, round(score, 6)::DOUBLE
      AS score FROM {_RANKED}"""))
def _(spark, sf):
    ranked = catalog.rank_models(catalog.model_years(_catalog_rows(spark, sf)), 2020, 30)
    return ranked.select("make", "model", big("year_min"), big("year_max"), r6("score").alias("score"))


@query("seed_rows", over("v_canonical", f"""
    SELECT 'https://bringatrailer.com/' || replace(lower(make), ' ', '-') || '/' || lower(model) ||
      '/?year_min=' || year_min || '&year_max=' || year_max AS url, 'bat' AS source,
      year_min::BIGINT AS target_year FROM {_RANKED}
    UNION ALL SELECT 'https://' || city || '.craigslist.org/search/cta?auto_make_model=' ||
      replace(make || ' ' || model, ' ', '+') || '&min_auto_year=' || year_min || '&max_auto_year=' ||
      year_max || '&query=' || replace(make || ' ' || model, ' ', '+'), 'craigslist', year_min::BIGINT
    FROM {_RANKED}, (SELECT unnest({sql_list(K.CRAIGSLIST_CITIES)}) AS city)"""))
def _(spark, sf):
    ranked = catalog.rank_models(catalog.model_years(_catalog_rows(spark, sf)), 2020, 30)
    return catalog.seed_rows(ranked, ["bat", "craigslist"]).select("url", "source", big("target_year"))


def _sitemap_table(spark, sf):
    """Region → nation → supplier documents; suppliers list two pages each."""
    def doc(kind, key):
        return F.concat(F.lit(f"http://s/{kind}/"), F.col(key))

    region = table(spark, sf, "region").select(
        F.lit("http://s/root").alias("document"), F.lit("sitemapindex").alias("root"),
        F.col("r_regionkey").cast("int").alias("position"), doc("region", "r_regionkey").alias("loc"))
    nation = table(spark, sf, "nation").select(
        doc("region", "n_regionkey").alias("document"), F.lit("sitemapindex").alias("root"),
        F.col("n_nationkey").cast("int").alias("position"), doc("nation", "n_nationkey").alias("loc"))
    supplier = table(spark, sf, "supplier").select(
        doc("nation", "s_nationkey").alias("document"), F.lit("sitemapindex").alias("root"),
        F.col("s_suppkey").cast("int").alias("position"), doc("supplier", "s_suppkey").alias("loc"))
    urlset = table(spark, sf, "supplier").select(
        doc("supplier", "s_suppkey").alias("document"), F.lit("urlset").alias("root"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), F.col("s_suppkey").alias("k")
    ).select("document", "root", "position", F.concat(F.lit("http://p/"), "k", F.lit("/"), "position").alias("loc"))
    return region.union(nation).union(supplier).union(urlset)


@query("expand_sitemaps", """
    SELECT 'http://p/' || s_suppkey || '/' || i AS url, row_number() OVER (ORDER BY n_regionkey, n_nationkey,
      s_suppkey, i) AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey, range(2) t(i)""")
def _(spark, sf):
    links = _sitemap_table(spark, sf)
    roots = links.where("document = 'http://s/root'").select("document").distinct()
    walked = sitemaps.expand_sitemaps(links, roots)
    from pyspark.sql import Window

    order = Window.partitionBy("root").orderBy("path")
    return walked.select("url", F.row_number().over(order).cast("bigint").alias("place"))


@query("sitemap_links", """
    SELECT 'd' || c_custkey AS document, i AS position, 'http://p/' || c_custkey || '?a=1&b=' || i AS loc
    FROM customer, range(2) t(i) WHERE c_custkey % 3 <> 2""")
def _(spark, sf):
    key = F.col("c_custkey").cast("string")

    def loc(i):
        return F.concat(F.lit("<url><loc> http://p/"), key, F.lit(f"?a=1&amp;b={i} </loc></url>"))

    whole = F.concat(F.lit('<?xml version="1.0"?>\n<urlset xmlns="http://x">'), loc(0), loc(1), F.lit("</urlset>"))
    body = F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("<urlset>"), loc(0))).otherwise(whole)
    docs = table(spark, sf, "customer").select(F.concat(F.lit("d"), key).alias("document"), body.alias("body"))
    return sitemap_links(docs).select("document", big("position"), "loc")


_SEEDS = """
    WITH m AS (SELECT * FROM orders WHERE o_orderkey % 3 < 2 ORDER BY o_orderkey{limit})
    SELECT 'carsandbids' AS source, ({walked}) AS walked, count(*) AS matched,
      count(DISTINCT o_custkey) FILTER (o_custkey % 4 <> 0) AS inserted,
      count(*) - count(DISTINCT o_custkey) FILTER (o_custkey % 4 <> 0) AS duplicates,
      (SELECT string_agg('https://carsandbids.com/auctions/lot-' || o_custkey, ' ' ORDER BY o_orderkey)
        FROM (SELECT * FROM m ORDER BY o_orderkey LIMIT 5)) AS examples FROM m"""


@query("sitemap_seed_stats_limited", _SEEDS.format(
    limit=" LIMIT 400", walked="SELECT count(*) FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM m)"))
def _(spark, sf):
    return _seed_stats(spark, sf, 400)


@query("sitemap_seed_stats", _SEEDS.format(limit="", walked="SELECT count(*) FROM orders"))
def _(spark, sf):
    return _seed_stats(spark, sf, None)


def _seed_stats(spark, sf, max_listings):
    def link(key):
        return F.concat(F.lit("https://carsandbids.com/auctions/lot-"), key)

    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), F.when(
        F.col("o_orderkey") % 3 < 2, link(F.col("o_custkey"))).otherwise("https://carsandbids.com/x")
        .alias("url"))
    held = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(link(F.col("c_custkey")).alias("url"))
    return crawlqueue.sitemap_stats(
        rows, held, "carsandbids", urls.SITEMAP_FILTERS["carsandbids"](F.col("url")), max_listings
    ).withColumn("examples", F.array_join("examples", " "))


@query("url_dedupe_in_order", f"""
    SELECT page_id, string_agg(link, ' ' ORDER BY position) AS links FROM ({_LINKS}) GROUP BY page_id""")
def _(spark, sf):
    rows = pages.page_links(table(spark, sf, "pages")).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "link"))).alias("all"))
    return rows.select("page_id", F.array_join(F.transform("all", lambda x: x["link"]), " ").alias("links"))


@query("page_text_hash", r"""
    SELECT page_id, sha256(array_to_string(list_filter(list_transform(string_split_regex(
      regexp_replace(regexp_replace(html, '<!--.*?-->', '<>', 'gs'),
        '<(script|style)\b.*?</(script|style)>', '<>', 'gs'), '<[^>]*>'),
      lambda x: regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'),
      '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
        '^\s+|\s+$', '', 'g')),
      lambda p: p <> ''), ' ')) AS digest FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.text_hash(H.inner_text(H.decoded(H.markup(F.col("html"))))).alias("digest"))


@query("queue_snapshot_sources", over("v_queue", "SELECT source, kind, count(*) AS n FROM v_queue GROUP BY ALL"))
def _(spark, sf):
    return queue(spark, sf).groupBy("source", "kind").agg(F.count("*").alias("n"))
