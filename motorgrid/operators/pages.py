"""Whole-table page jobs: links, next pages, listings, block tags.

Every page is handled inside its own row; nothing is grouped or shuffled before the results are.
Pages need url and html; listing and search jobs also source, kind and the target_* hints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions import html as H
from motorgrid.functions import jsonld, text, titles, urls
from motorgrid.functions.text import let

HINTS = ("target_year", "target_make", "target_model")


def _href(link: Column) -> Column:
    return H.attribute(link["attrs"], "href")


def _normalized(page_url: Column, hrefs: Column) -> Column:
    """Resolved links in page order, repeats dropped."""
    return F.array_distinct(F.transform(hrefs, lambda h: urls.normalize_url(page_url, h)))


def _shown(pages: DataFrame) -> DataFrame:
    """With ``_marked``, the marked-up page, and ``_shown``, the same decoded."""
    marked = text.with_once(pages, {"_marked": H.markup(F.col("html"))})
    return text.with_once(marked, {"_shown": H.decoded(F.col("_marked"))})


def page_links(pages: DataFrame) -> DataFrame:
    """All links of every page: url, position (first occurrence), link."""
    hrefs = F.filter(
        F.transform(H.tags(F.col("_shown"), "a"), lambda t: H.attribute(t, "href")),
        lambda h: h.isNotNull())
    links = text.with_once(_shown(pages), {"_links": _normalized(F.col("url"), hrefs)})
    keep = [c for c in pages.columns if c != "html"]
    return links.select(*keep, F.posexplode("_links").alias("position", "link"))


def _listing_links(page_url: Column, marked: Column, source: Column) -> Column:
    """Listing URLs of a search page by the source's own pattern."""
    cards = K.LISTING_HREF_PATTERNS["cars_com"]

    def hrefs(names: str, attr: str = "href") -> Column:
        return F.transform(H.tags(marked, names), lambda t: H.attribute(t, attr))

    def is_listing(href: Column) -> Column:
        hit = None
        for name, pattern in K.LISTING_HREF_PATTERNS.items():
            if name != "cars_com":
                test = href.rlike(pattern)
                hit = F.when(source == name, test) if hit is None \
                    else hit.when(source == name, test)
        return hit

    ids = F.transform(
        F.filter(F.concat(hrefs("a|fuse-button|spark-link-button"),
                          hrefs("card-gallery", "card-href")), lambda h: h.rlike(cards)),
        lambda h: F.regexp_extract(h, K.NATIVE_ID_PATTERNS["cars_com"], 1))
    own = F.transform(
        F.array_distinct(ids), lambda i: F.concat(F.lit("/vehicledetail/"), i, F.lit("/")))
    matched = F.when(source == "cars_com", own).when(
        source.isin(*K.QUEUE_SOURCES), F.filter(hrefs("a"), is_listing))
    return _normalized(page_url, matched)


def next_page(page_url: Column, marked: Column, source: Column | None = None) -> Column:
    """Link to the next result page of a marked-up page, null when there is none.

    First anchor with rel=next, or an aria-label with ``next``, or a text with ``next`` but not
    ``prev``. cars_com tries the three signals one after the other and wants exact words.
    """
    def described(a: Column) -> Column:
        return F.struct(
            _href(a).alias("href"),
            F.lower(F.coalesce(H.attribute(a["attrs"], "rel"), F.lit("")))
            .rlike(r"(^|\s)next(\s|$)").alias("rel"),
            F.lower(F.coalesce(H.attribute(a["attrs"], "aria-label"), F.lit(""))).alias("aria"),
            F.lower(H.inner_text(a["body"], "")).alias("words"))

    def lenient(a: Column) -> Column:
        return a["rel"] | a["aria"].contains("next") | (
            a["words"].contains("next") & ~a["words"].contains("prev"))

    def first(found: Column, test) -> Column:
        return F.get(F.filter(found, test), F.lit(0))["href"]

    def pick(found: Column) -> Column:
        anywhere = first(found, lenient)
        if source is None:
            return anywhere
        staged = F.coalesce(
            first(found, lambda a: a["rel"]), first(found, lambda a: a["aria"] == "next"),
            first(found, lambda a: a["words"] == "next"))
        return F.when(source == "cars_com", staged).otherwise(anywhere)

    return let(F.transform(H.anchors(marked), described), lambda found: let(
        pick(found), lambda h: F.when(h.isNotNull(), urls.normalize_url(page_url, h))))


def search_results(pages: DataFrame) -> DataFrame:
    """Search pages with ``listing_urls``, ``next_url`` and ``note``."""
    src, url, shown = F.col("source"), F.col("url"), F.col("_shown")
    found = text.with_once(_shown(pages.where("kind = 'search'")), {
        "listing_urls": _listing_links(url, shown, src), "next_url": next_page(url, shown, src)}).drop(
        "_marked", "_shown")
    return found.withColumn("note", F.when(
        F.coalesce(F.size("listing_urls"), F.lit(0)) <= 0, "no listing cards found"))


def discovered_urls(pages: DataFrame) -> DataFrame:
    """Queue rows out of search pages: listings in page order, then the next page."""
    def item(url: Column, kind: str) -> Column:
        return F.struct(url.alias("url"), F.lit(kind).alias("kind"))

    items = F.concat(
        F.transform("listing_urls", lambda u: item(u, "listing")),
        F.when(F.col("next_url").isNotNull(), F.array(item(F.col("next_url"), "search")))
        .otherwise(F.array().cast("array<struct<url:string,kind:string>>")))
    found = search_results(pages).select(
        F.col("url").alias("page_url"), "source", *HINTS, F.posexplode(items).alias("position", "_i"))
    return found.select("page_url", "position", "_i.url", "source", "_i.kind", *HINTS)


def gallery_images(marked: Column) -> Column:
    """https images of the gallery slot on the photo host."""
    shown = F.filter(
        H.tags(marked, "img"), lambda t: F.coalesce(H.attribute(t, "slot") == "image", F.lit(False)))
    return F.array_distinct(F.filter(
        F.transform(shown, lambda t: H.attribute(t, "src")),
        lambda u: u.startswith("https://") & u.contains(K.GALLERY_HOST)))


def _classified_images(url: Column, marked: Column) -> Column:
    """https or http images of a marked-up classified page: thumbs, then the gallery."""
    thumbs = F.transform(
        F.filter(H.tags(marked, "a"), lambda t: H.has_class(t, "thumb")),
        lambda t: H.attribute(t, "href"))
    shown = F.transform(H.tags_within(
        marked, "div", lambda tag: H.attribute(tag, "class").rlike(r"\b(?:gallery|swipe)\b"), "img"),
        lambda t: H.attribute(t, "src"))
    return F.filter(
        _normalized(url, F.filter(F.concat(thumbs, shown), lambda u: u.isNotNull())),
        lambda u: u.rlike("^https?://"))


def _post_id(marked: Column) -> Column:
    notes = F.transform(H.sections(marked, "p", "postinginfo"), lambda p: F.regexp_extract(
        F.lower(H.inner_text(p)), r"post id:\s*(\d{6,})", 1))
    return F.get(F.filter(notes, lambda n: n != ""), F.lit(0))


def classified_fields(url: Column, marked: Column, current_year: int) -> Column:
    """struct of a marked-up classified page: title parts, attributes, VIN, images, post id."""
    heading = H.element(marked, "h[12]", lambda tag: H.has_class(tag, "postingtitle"))
    title = F.coalesce(
        text.non_blank(H.inner_text(H.element(
            marked, "span", lambda tag: H.attribute(tag, "id") == "titletextonly"), "")),
        text.non_blank(H.inner_text(heading)))
    spans = F.flatten(F.transform(H.sections(marked, "p", "attrgroup"), lambda g: F.transform(
        F.regexp_extract_all(g, F.lit(
            f"(?i){H.OPEN}span{H.ATTRS}[^{H.END}]*+{H.END}((?:[^{H.OPEN}]++|{H.OPEN}(?!/span{H.ATTRS}))*+)"),
            F.lit(1)), lambda span: H.inner_text(span))))
    attrs = F.lower(F.array_join(spans, " | "))
    body = F.coalesce(H.inner_text(H.element(
        marked, "section", lambda tag: H.attribute(tag, "id") == "postingbody")), F.lit(""))
    return F.struct(
        title.alias("title"), titles.free_title(title, current_year).alias("parsed"),
        text.parse_digits(text.key_value(attrs, "odometer")).alias("mileage"),
        text.title_case(text.key_value(attrs, "type")).alias("body_style"),
        titles.vin(attrs, body).alias("vin"), _classified_images(url, marked).alias("image_urls"),
        _post_id(marked).alias("post_id"),
    )


def page_heading(marked: Column) -> Column:
    """Vehicle heading of a marked-up page, else its title."""
    return F.coalesce(
        text.non_blank(H.inner_text(H.element(
            marked, "h1", lambda tag: H.attribute(tag, "id") == "vehicle-title"), "")),
        text.non_blank(unescaped_title(marked)))


def unescaped_title(marked: Column) -> Column:
    return H.inner_text(H.element(marked, "title", lambda _: F.lit(True)), "")


def _images(src: Column, classified: Column, linked: Column) -> Column:
    return (
        F.when(src == "craigslist", classified)
        .when((src == "cars_com") & (F.coalesce(F.size(linked), F.lit(0)) <= 0), F.col("_photos"))
        .otherwise(F.coalesce(linked, F.array().cast("array<string>")))
    )


def _failure(src: Column, year: Column, make: Column) -> Column:
    """Why a page gives no listing, null if it gives one."""
    no_vehicle = F.when(
        src == "cars_com",
        F.col("_node").isNull() & F.col("_state").isNull() & (year.isNull() | make.isNull())
    ).when(src == "craigslist", False).otherwise(F.col("_node").isNull())
    return (
        F.when(~src.isin(*K.QUEUE_SOURCES) | src.isNull(), "no parser for the source")
        .when(F.col("_id").isNull(), "no listing id in the URL")
        .when(no_vehicle, "no vehicle data on the page")
    )


def listing_images(pages: DataFrame, current_year: int) -> DataFrame:
    """listing_id, source and image_urls as ``parse_listings`` gives them, without the other fields."""
    src, url = F.col("source"), F.col("url")
    marked, shown = F.col("_marked"), F.col("_shown")
    classified = src == "craigslist"
    staged = text.with_once(_shown(pages.where("kind = 'listing'").select("source", "url", "html")).drop("html"), {
        "_node": F.when(~classified, jsonld.find_vehicle(jsonld.blocks(marked))),
        "_state": F.when(src == "cars_com", jsonld.page_state(marked)),
    }).drop("_marked")
    # A title makes a listing only where nothing else does.
    bare = (src == "cars_com") & F.col("_node").isNull() & F.col("_state").isNull()
    staged = text.with_once(staged, {
        "_cl": F.when(classified, _classified_images(url, shown)),
        "_ld": F.when(F.col("_node").isNotNull(), jsonld.image_urls(jsonld.child(F.col("_node"), "$.image"))),
        "_photos": F.when(src == "cars_com", gallery_images(shown)),
        "_head": F.when(bare, titles.page_title(page_heading(shown), current_year)),
        "_id": F.coalesce(urls.native_id(url, src), F.when(classified, _post_id(shown))),
    }).drop("_shown")
    good = _failure(src, F.col("_head.year"), F.col("_head.make")).isNull()
    return text.with_once(staged, {
        "listing_id": F.when(good, F.concat(src, F.lit(":"), F.col("_id"))),
        "image_urls": F.when(good, _images(src, F.col("_cl"), F.col("_ld")))}).select(
        "listing_id", "source", "image_urls")


def parse_listings(pages: DataFrame, current_year: int) -> DataFrame:
    """Listing pages → one row each: listing fields, image_urls and note.

    ``listing_id`` is null on pages that give no listing; ``note`` says why. The order in which
    the page's signals are used depends on the source.
    """
    src, url, html = F.col("source"), F.col("url"), F.col("html")
    marked, shown = F.col("_marked"), F.col("_shown")
    classified = src == "craigslist"
    staged = text.with_once(_shown(pages.where("kind = 'listing'")), {
        "_node": F.when(~classified, jsonld.find_vehicle(jsonld.blocks(marked))),
        "_state": F.when(src == "cars_com", jsonld.page_state(marked)),
        "_cl": F.when(classified, classified_fields(url, shown, current_year)),
        "_head": F.when(
            src == "cars_com", titles.page_title(page_heading(shown), current_year)),
        "_photos": F.when(src == "cars_com", gallery_images(shown)),
    }).drop("_marked", "_shown")
    staged = text.with_once(staged, {
        "_ld": F.when(F.col("_node").isNotNull(), jsonld.vehicle_fields(
            F.col("_node"), current_year)),
        "_st": F.when(F.col("_state").isNotNull(), jsonld.state_fields(F.col("_state"))),
        "_id": F.coalesce(urls.native_id(url, src), F.col("_cl.post_id")),
    })
    staged = text.with_once(staged, {
        "_auction": F.when(src == "bat", titles.auction_name(F.col("_ld.name")))})
    hint_year, hint_make, hint_model = (F.col(h) for h in HINTS)
    hinted = src.isin("bat", "hemmings", "carsandbids")
    named_year = F.when(hinted, text.parse_year(F.col("_ld.name"), current_year))
    # The title only fills in when year, make or model is still open.
    open_fields = (
        F.coalesce("_ld.year", "_st.year").isNull() | F.coalesce("_ld.make", "_st.make").isNull()
        | F.coalesce("_ld.model", "_st.model").isNull()
    )
    name_parsed = F.col("_ld.brand_make").isNull() | F.col("_ld.model").isNull()

    def by_source(cars: Column, bat: Column, hints: Column, classified_value: Column,
                  plain: Column) -> Column:
        return (
            F.when(src == "cars_com", cars).when(src == "bat", bat)
            .when(src.isin("hemmings", "carsandbids"), hints).when(classified, classified_value)
            .otherwise(plain)
        )

    head = {f: F.when(open_fields, F.col(f"_head.{f}")) for f in ("year", "make", "model", "trim")}
    auction = {f: F.when(name_parsed, F.col(f"_auction.{f}")) for f in ("make", "model", "trim")}
    fields = {
        "year": by_source(
            F.coalesce(F.col("_ld.year"), F.col("_st.year"), head["year"]),
            F.coalesce(F.col("_ld.year"), named_year, hint_year),
            F.coalesce(F.col("_ld.year"), named_year, hint_year),
            F.coalesce(hint_year, F.col("_cl.parsed.year")), F.col("_ld.year")),
        "make": by_source(
            F.coalesce(F.col("_ld.make"), F.col("_st.make"), head["make"]),
            F.coalesce(F.col("_ld.brand_make"), auction["make"], hint_make),
            F.coalesce(F.col("_ld.brand_make"), hint_make),
            F.coalesce(text.non_blank(hint_make), F.col("_cl.parsed.make")), F.col("_ld.make")),
        "model": by_source(
            F.coalesce(F.col("_ld.model"), F.col("_st.model"), head["model"]),
            F.coalesce(F.col("_ld.model"), auction["model"], hint_model),
            F.coalesce(F.col("_ld.model"), hint_model),
            F.coalesce(text.non_blank(hint_model), F.col("_cl.parsed.model")),
            F.col("_ld.model")),
        "trim": by_source(
            F.coalesce(F.col("_ld.trim"), F.col("_st.trim"), head["trim"]),
            F.coalesce(F.col("_ld.trim"), auction["trim"]), F.col("_ld.trim"),
            F.lit(None).cast("string"), F.col("_ld.trim")),
        "body_style": F.coalesce("_ld.body_style", "_st.body_style", "_cl.body_style"),
        "mileage": F.coalesce("_ld.mileage", "_st.mileage", "_cl.mileage").cast("int"),
        "vin": F.coalesce("_ld.vin", "_st.vin", "_cl.vin"),
    }
    images = _images(src, F.col("_cl.image_urls"), F.col("_ld.image_urls"))
    filled = text.with_once(
        staged, {**{f"_{name}": value for name, value in fields.items()}, "_images": images})
    failure = _failure(src, F.col("_year"), F.col("_make"))
    remark = (
        F.when((src == "cars_com") & F.col("_node").isNull(), "page state used")
        .when(classified & F.col("_cl.title").isNull(), "no title")
        .when(classified & F.col("_make").isNull() & F.col("_model").isNull(),
              "no make or model in the title")
    )
    good = failure.isNull()

    def only_good(value: Column) -> Column:
        return F.when(good, value)

    done = text.with_once(filled, {
        "listing_id": only_good(F.concat(src, F.lit(":"), F.col("_id"))),
        **{name: only_good(F.col(f"_{name}")) for name in fields},
        "raw_html_sha256": only_good(text.text_hash(html)),
        "image_urls": only_good(F.col("_images")),
        "note": F.coalesce(failure, remark)})
    return done.select(
        "listing_id", "source", "url", *fields, "raw_html_sha256", "image_urls", "note")


def image_items(listings: DataFrame) -> DataFrame:
    """Queue rows for the images of parsed listings."""
    return listings.where("listing_id is not null").select(
        F.explode("image_urls").alias("url"), "source", F.lit("image").alias("kind"),
        F.col("listing_id").alias("parent_listing_id"))


def block_tags(pages: DataFrame) -> DataFrame:
    """Add ``tags``: HTTP trouble, challenge page, shell, content markers, parser mismatch."""
    status, html, src = F.col("status"), F.col("html"), F.col("source")

    def any_of(markers: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for marker in markers:
            found = found | html.contains(marker)
        return found

    hits = F.lit(None).cast("array<string>")
    picked = None
    for name, markers in K.CONTENT_MARKERS.items():
        value = F.array_compact(F.array(*[F.when(html.contains(m), F.lit(m)) for m in markers]))
        picked = F.when(src == name, value) if picked is None else picked.when(src == name, value)
    hits = F.coalesce(picked, F.array().cast("array<string>"))
    shell = (status == 200) & (F.octet_length(html) < K.SHELL_BYTES)
    staged = text.with_once(pages, {"_hits": hits})
    has_hits = F.size("_hits") > 0
    content = F.concat(F.lit("content_markers:"), F.array_join(F.slice("_hits", 1, 3), ","))
    tags = F.array_compact(F.array(
        F.when(status == 403, "http_403"), F.when(status == 429, "http_429"),
        F.when(status >= 500, "http_5xx"), F.when(status == 404, "http_404"),
        F.when(any_of(K.CHALLENGE_MARKERS), "cloudflare_challenge"),
        F.when(shell, "unhydrated_shell"), F.when(has_hits, content),
        F.when((status == 200) & ~has_hits & ~shell, "parser_mismatch_candidate")))
    return staged.withColumn("tags", F.when(
        status.isNull(), F.array(F.lit("transport_error"))).otherwise(tags)).drop("_hits")


def keep_page(pages: DataFrame) -> DataFrame:
    """Add ``keep`` to tagged pages. robots and sitemap files are kept whenever they answer."""
    def tagged(prefix: str) -> Column:
        return F.exists("tags", lambda t: t.startswith(prefix))

    size = F.octet_length("html")
    lower = F.lower("url")
    meta = lower.endswith("/robots.txt") | lower.endswith("sitemap.xml")
    keep = (
        F.when(F.col("status").isNull() | (F.col("status") >= 400), False)
        .when(tagged("cloudflare_challenge"), False)
        .when(tagged("unhydrated_shell") & ~meta, False)
        .when(meta, size > 0).when(tagged("content_markers:"), True)
        .otherwise(size > K.SMALL_PAGE_BYTES)
    )
    return pages.withColumn("keep", keep)
