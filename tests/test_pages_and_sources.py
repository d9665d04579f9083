import json

import pytest
from pyspark.sql import functions as F

from motorgrid import schemas
from motorgrid.operators import catalog, crawlqueue, filters, lookups, pages, sitemaps
from motorgrid.plans import ingest
from motorgrid.plans.batches import apply_page_results
from motorgrid.sources import catalog as catalog_source
from motorgrid.sources.images import scan_image_tree
from motorgrid.sources.sitemaps import scan_sitemap_xml

NOW = F.lit("2024-06-01 00:00:00").cast("timestamp")
PAGE = ("url string, source string, kind string, html string, target_year int, target_make string, "
        "target_model string")


def _ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>'
                   for b in blocks)


def _parse(spark, *rows):
    df = spark.createDataFrame([(u, s, "listing", h, *(hints or (None, None, None))) for u, s, h, hints in rows], PAGE)
    return {r.url: r for r in pages.parse_listings(df, 2026).collect()}


VEHICLE = {
    "@type": "Vehicle", "manufacturer": {"name": " Honda "}, "model": "Civic", "vehicleModelDate": "2019",
    "mileageFromOdometer": "12,345 mi", "vehicleIdentificationNumber": "V1", "bodyType": "Sedan",
    "image": ["https://a/1.jpg", {"contentUrl": "https://a/2.jpg"}, "https://a/1.jpg", "data:x"], "trim": ""}


def test_jsonld_precedence_and_flattening(spark):
    product = {"@type": "Product", "manufacturer": "No", "model": "No"}
    u = "https://www.autotrader.com/cars-for-sale/vehicle/{}"
    got = _parse(
        spark,
        (u.format(1000001), "autotrader", _ld("{bad", product, [{"@graph": [[VEHICLE]]}]), None),
        (u.format(1000002), "autotrader", _ld({"@type": ["thing", "CAR"], "model": {"name": "X"},
                                                "vehicleModelDate": 2019, "mileageFromOdometer": {"value": 12.9}}), None),
        (u.format(1000003), "autotrader", "<p>nothing</p>", None),
        (u.format("x"), "autotrader", _ld(VEHICLE), None))
    a = got[u.format(1000001)]
    assert (a.listing_id, a.year, a.make, a.model, a.mileage, a.trim, a.vin) == (
        "autotrader:1000001", 2019, "Honda", "Civic", 12345, None, "V1")
    assert a.image_urls == ["https://a/1.jpg", "https://a/2.jpg"] and a.note is None
    b = got[u.format(1000002)]
    assert (b.year, b.model, b.mileage, b.make) == (None, "X", 12, None)
    assert got[u.format(1000003)].listing_id is None and "no vehicle" in got[u.format(1000003)].note
    assert got[u.format("x")].note == "no listing id in the URL"


def test_cars_page_state_and_title(spark):
    state = {"call_source_dni_metadata": {"dimensions": {"year": ["2020"], "make": ["Honda"], "trim": []}},
             "dealer_chat_metadata": {"carsData": {"model": "civic", "mileage": 7, "bodystyle": "sport utility"}}}
    script = f'<script type="application/json" id="CarsWeb.VehicleDetailController.show">{json.dumps(state)}</script>'
    u = "https://www.cars.com/vehicledetail/{}/"
    photo = '<img slot="image" src="https://platform.cstatic-images.com/1.jpg">'
    got = _parse(
        spark, (u.format("s"), "cars_com", script + photo + photo, None),
        (u.format("t"), "cars_com", "<title>Used 2018 Kia Rio LX For Sale | Cars.com</title>", None),
        (u.format("h"), "cars_com", '<h1 id="vehicle-title">New 2017 Ford <b>Fiesta</b></h1><title>x</title>', None),
        (u.format("n"), "cars_com", "<title>no year</title>", None),
        (u.format("m"), "cars_com", _ld({"@type": "Car", "model": "Rio"}) + script, None))
    s = got[u.format("s")]
    assert (s.year, s.make, s.model, s.mileage, s.body_style, s.image_urls) == (
        2020, "Honda", "civic", 7, "Sport Utility", ["https://platform.cstatic-images.com/1.jpg"])
    assert s.note == "page state used"
    t = got[u.format("t")]
    assert (t.year, t.make, t.model, t.trim) == (2018, "Kia", "Rio", "LX")
    h = got[u.format("h")]
    # Pieces of text are joined without a blank.
    assert (h.year, h.make, h.model) == (2017, "FordFiesta", None)
    assert got[u.format("n")].listing_id is None
    m = got[u.format("m")]
    assert (m.make, m.model, m.note) == ("Honda", "Rio", None)


def test_auction_and_hints(spark):
    b = "https://bringatrailer.com/listing/{}/"
    h = "https://www.hemmings.com/classifieds/cars-for-sale/x/1234567"
    c = "https://carsandbids.com/auctions/abc-1"
    name = {"@type": "Product", "name": "No Reserve: 1986 Honda Civic Si - Sold", "brand": None}
    got = _parse(
        spark, (b.format("a"), "bat", _ld(name), (1999, "Hint", "Hinted")),
        (b.format("b"), "bat", _ld({"@type": "Product", "name": "Parts", "brand": "Ford"}), (1999, "Hint", "Hinted")),
        (h, "hemmings", _ld({"@type": "Product", "name": "1970 Ford", "brand": {"name": "Ford"}}), (1, "a", "Mustang")),
        (c, "carsandbids", _ld(VEHICLE), (1, "a", "b")))
    a = got[b.format("a")]
    assert (a.listing_id, a.year, a.make, a.model, a.trim) == ("bat:a", 1986, "Honda", "Civic", "Si")
    other = got[b.format("b")]
    assert (other.year, other.make, other.model) == (1999, "Ford", "Hinted")
    assert (got[h].year, got[h].make, got[h].model) == (1970, "Ford", "Mustang")
    assert (got[c].listing_id, got[c].year, got[c].make) == ("carsandbids:abc-1", 2019, "Honda")


def test_classified_page(spark):
    html = ('<h1 class="postingtitle"><span id="titletextonly">2015 ford f-150 xlt</span></h1>'
            '<p class="attrgroup"><span><b>2015 ford</b></span></p><p class="attrgroup"><span>odometer: <b>88000</b></span>'
            '<span>type: <b>pickup</b></span></p><section id="postingbody">VIN 1FTFW1ET5DFC10312 nice</section>'
            '<a class="thumb" href="/i/1.jpg"></a><div class="swipe"><img src="https://i/2.jpg"></div>')
    u = "https://ny.craigslist.org/mnh/cto/d/ford/7654321.html"
    v = "https://ny.craigslist.org/post"
    got = _parse(spark, (u, "craigslist", html, None),
                 (v, "craigslist", '<p class="postinginfo">post id: 7000001</p>', (2001, "Kia", "Rio")))
    r = got[u]
    assert (r.year, r.make, r.model, r.mileage, r.body_style, r.vin) == (
        2015, "Ford", "F-150 Xlt", 88000, "Pickup", "1FTFW1ET5DFC10312")
    assert r.image_urls == ["https://ny.craigslist.org/i/1.jpg", "https://i/2.jpg"]
    w = got[v]
    assert (w.listing_id, w.year, w.make, w.note) == ("craigslist:7000001", 2001, "Kia", "no title")


def test_search_page_shapes(spark):
    html = ('<a href="/listing/a-1/">x</a><a href="https://bringatrailer.com/listing/a-1/?utm_source=q">query is no match</a>'
            '<a href="/listing/A">upper</a><a href=\' /listing/b-2 \'>y</a><a href="/listing/a-1/">again</a>'
            '<a aria-label="go NEXT" href="?page=2&amp;utm_x=1#f">2</a>')
    cars = ('<fuse-button href="/vehicledetail/z1/?attribution=1">v</fuse-button><a href="/vehicledetail/z1/">v</a>'
            '<card-gallery card-href="/vehicledetail/z2/photos/">g</card-gallery><a href="/n">Next page</a>'
            '<a aria-label="Next" href="/p3">3</a>')
    rows = [("https://bringatrailer.com/kia/", "bat", "search", html, 2010, "Kia", None),
            ("https://www.cars.com/shopping/", "cars_com", "search", cars, None, None, None),
            ("https://x.org/", "hemmings", "search", "<a href='/prev-next'>previous next</a>", None, None, None)]
    df = spark.createDataFrame(rows, PAGE)
    got = [(r.source, r.kind, r.url) for r in pages.discovered_urls(df).orderBy("page_url", "position").collect()]
    assert got == [
        ("bat", "listing", "https://bringatrailer.com/listing/a-1/"),
        ("bat", "listing", "https://bringatrailer.com/listing/b-2"),
        ("bat", "search", "https://bringatrailer.com/kia/?page=2"),
        ("cars_com", "listing", "https://www.cars.com/vehicledetail/z1/"),
        ("cars_com", "listing", "https://www.cars.com/vehicledetail/z2/"),
        ("cars_com", "search", "https://www.cars.com/p3")]
    notes = {r.source: r.note for r in pages.search_results(df).collect()}
    assert notes == {"bat": None, "cars_com": None, "hemmings": "no listing cards found"}


def test_page_batch(spark):
    queue = spark.createDataFrame(
        [(u, s, k, None, None, None, None, "in_progress", 0, None, None, None, None) for u, s, k in (
            ("https://www.autotrader.com/cars-for-sale/vehicle/1000001", "autotrader", "listing"),
            ("https://www.autotrader.com/cars-for-sale/vehicle/1000002", "autotrader", "listing"),
            ("https://bringatrailer.com/kia/", "bat", "search"), ("http://none/", "other", "listing"))],
        schemas.CRAWL_QUEUE)
    listings = spark.createDataFrame([], schemas.LISTINGS)
    fetched = spark.createDataFrame([
        ("https://www.autotrader.com/cars-for-sale/vehicle/1000001",) * 2 + (_ld(VEHICLE), None),
        ("https://www.autotrader.com/cars-for-sale/vehicle/1000002",) * 2 + (None, "timeout"),
        ("https://bringatrailer.com/kia/",) * 2 + ('<a href="/listing/a/">a</a>', None),
        ("http://none/",) * 2 + ("<p>x</p>", None)], "queue_url string, url string, html string, error string")
    done = apply_page_results(queue, listings, fetched, NOW, 2026)
    status = {r.url: (r.status, r.kind, r.last_error) for r in done["queue"].collect()}
    assert status["https://www.autotrader.com/cars-for-sale/vehicle/1000001"][0] == "done"
    assert status["https://www.autotrader.com/cars-for-sale/vehicle/1000002"] == ("failed", "listing", "timeout")
    assert status["http://none/"] == ("failed", "listing", "no parser for the source")
    assert status["https://bringatrailer.com/listing/a/"] == ("pending", "listing", None)
    assert status["https://a/1.jpg"][1] == "image" and len(status) == 7
    again = apply_page_results(done["queue"], done["listings"], fetched, NOW, 2026)
    assert done["listings"].count() == again["listings"].count() == 1
    assert again["queue"].count() == 7


def test_page_batch_broadcasts_no_pages(spark):
    """Computed pages look small to Spark: 20 bytes each, whatever their length."""
    rows = spark.range(20)
    url = F.concat(F.lit("https://bringatrailer.com/"), "id", F.lit("/"))
    queue = crawlqueue.new_items(rows.select(
        url.alias("url"), F.lit("bat").alias("source"), F.lit("search").alias("kind")), NOW)
    fetched = rows.select(url.alias("queue_url"), url.alias("url"), F.repeat(F.lit("<p>x"), 2000).alias("html"),
                          F.lit(None).cast("string").alias("error"))
    done = apply_page_results(queue, spark.createDataFrame([], schemas.LISTINGS), fetched, NOW, 2026)
    for out in (done["queue"], done["listings"], crawlqueue.mark_claimed(queue, queue.select("url"), NOW)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.status for r in done["queue"].collect()} == {"done"}


SITEMAP = "document string, root string, position int, loc string"


def _walk(links, root, max_depth=3):
    """Depth-first walk that enters each document once."""
    docs, out, seen = {}, [], set()
    for doc, kind, pos, loc in links:
        docs.setdefault(doc, (kind, []))[1].append((pos, loc))

    def visit(doc, depth):
        if doc in seen:
            return
        seen.add(doc)
        kind, entries = docs.get(doc, ("none", []))
        for _, loc in sorted(entries):
            if kind == "urlset":
                out.append(loc)
            elif kind == "sitemapindex" and depth + 1 <= max_depth:
                visit(loc, depth + 1)

    visit(root, 0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sitemap_walk(spark, tmp_path, seed):
    import random

    rng = random.Random(seed)
    names = [f"d{i}" for i in range(9)]
    links = []
    for i, name in enumerate(names):
        kind = "sitemapindex" if i < 6 else "urlset"
        for pos in range(3):
            # Cycles, repeats and unknown documents are allowed.
            loc = rng.choice([*names, "missing"]) if i < 6 else f"http://p/{name}/{pos}"
            links.append((name, kind, pos, loc))
    df = spark.createDataFrame(links, SITEMAP)
    roots = spark.createDataFrame([("d0",)], "document string")
    got = [r.url for r in sitemaps.expand_sitemaps(df, roots).orderBy("path").collect()]
    assert got == _walk(links, "d0")
    assert sitemaps.expand_sitemaps(df, roots, max_urls=2).count() == min(2, len(got))


def test_sitemap_walk_of_many_ways(spark):
    # 30 layers of two documents, each of which names both of the next layer: 2 ** 30 ways.
    links = [(f"{side}{layer}", "sitemapindex", pos, f"{name}{layer + 1}") for layer in range(30)
             for side in "ab" for pos, name in enumerate("ba")]
    links += [(f"{side}30", "urlset", pos, f"http://p/{side}/{pos}") for side in "ab" for pos in range(2)]
    df = spark.createDataFrame(links, SITEMAP)
    roots = spark.createDataFrame([("a0",)], "document string")
    got = [r.url for r in sitemaps.expand_sitemaps(df, roots, 30).orderBy("path").collect()]
    assert got == _walk(links, "a0", 30) and len(got) == 4
    assert sitemaps.expand_sitemaps(df, roots, 29).count() == 0


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_sitemap_walk_below_its_limit(spark, depth):
    import random

    # A document that is entered at the limit is not opened, though a later way to it is shorter.
    rng = random.Random(depth)
    links = [(f"d{i}", "sitemapindex", pos, rng.choice([f"d{rng.randrange(14)}", "missing", None]))
             for i in range(10) for pos in range(4)]
    links += [(f"d{i}", "urlset", 0, f"http://p/{i}") for i in range(10, 14)]
    df = spark.createDataFrame(links, SITEMAP)
    names = ["d0", "d3", "d11", "absent"]
    roots = spark.createDataFrame([(n,) for n in [*names, "d3"]], "document string")
    got = {n: [] for n in names}
    for r in sitemaps.expand_sitemaps(df, roots, depth).orderBy("root", "path").collect():
        got[r["root"]].append(r["url"])
    whole = [link for link in links if link[3] is not None]
    assert got == {n: _walk(whole, n, depth) for n in names}
    seen = {n: _entered(whole, n, depth) for n in names}
    assert {tuple(r) for r in sitemaps.not_followed(df, roots, depth).collect()} == {
        (n, loc) for n in names for doc, kind, _, loc in whole
        if kind == "sitemapindex" and doc in seen[n] and loc not in seen[n]}


def _entered(links, root, max_depth):
    """Documents that the walk enters."""
    seen = set()

    def visit(doc, depth):
        if doc in seen or depth > max_depth:
            return
        seen.add(doc)
        for _, loc in sorted((pos, loc) for d, kind, pos, loc in links
                             if d == doc and kind == "sitemapindex"):
            visit(loc, depth + 1)

    visit(root, 0)
    return seen


def test_sitemap_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<?xml version="1.0"?><s:urlset xmlns:s="x"><s:url><s:loc> http://p/1?a=1&amp;b=2 </s:loc></s:url>'
        "<s:url><s:lastmod>1</s:lastmod></s:url></s:urlset>")
    (tmp_path / "b.xml").write_text("<sitemapindex><sitemap><loc>http://s/a</loc></sitemap></sitemapindex>\n")
    (tmp_path / "c.xml").write_text("<urlset><url><loc>http://broken</loc></url>")
    (tmp_path / "d.xml").write_text("<html><body></body></html>")
    got = sorted((r.document[-5:], r.root, r.loc) for r in scan_sitemap_xml(spark, str(tmp_path)).collect())
    assert got == [("a.xml", "urlset", "http://p/1?a=1&b=2"), ("b.xml", "sitemapindex", "http://s/a")]


def test_image_tree_ingest(spark, tmp_path):
    root = tmp_path / "set"
    for name, data in {
        "VMMRdb/honda_civic_2005/1.jpg": b"one", "VMMRdb/honda_civic_2005/2.JPG": b"two",
        "VMMRdb/x/honda_civic/3.png": b"one", "VMMRdb/bad/4.jpg": b"four", "VMMRdb/.hid/5.jpg": b"h",
        "__MACOSX/honda_civic_2005/6.jpg": b"m", "VMMRdb/honda_civic_2005/7.txt": b"t", "VMMRdb/8.jpg": b"top",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    files = scan_image_tree(spark, str(root))
    assert sorted(r.entry for r in files.select("entry").collect()) == [
        "VMMRdb/bad/4.jpg", "VMMRdb/honda_civic_2005/1.jpg", "VMMRdb/honda_civic_2005/2.JPG",
        "VMMRdb/x/honda_civic/3.png"]
    assert "content" not in files.select("entry")._jdf.queryExecution().executedPlan().toString()
    known = spark.createDataFrame([], "image_id string")
    done = ingest.ingest_labelled_images(ingest.label_underscore(files), "vmmrdb", known, "train", NOW)
    assert {r.outcome: r.n for r in done["audit"].collect()} == {"inserted": 2, "existing": 1, "no separator": 1}
    rows = done["listings"].collect()
    assert {(r.year, r.make, r.model) for r in rows} == {(2005, "honda", "civic")}
    image = done["images"].where("bytes = 3").orderBy("local_path").first()
    assert image.local_path.startswith("images/2005_honda_civic/") and image.position == 1
    again = ingest.ingest_labelled_images(
        ingest.label_underscore(files), "vmmrdb", done["images"].select("image_id"), "train", NOW)
    assert again["listings"].count() == 0


def test_catalog_files(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "Kia", 11, "Rio", 2001), (1, "Kia", 11, "Rio", 2000), (1, "Kia", 10, "Ceed", 2010), (2, "Bmw", 20, "M3", 1970),
         (2, "Bmw", 21, "Z4", 1900)], "make_id bigint, make_name string, model_id bigint, model_name string, year int")
    doc = catalog.build_catalog(rows, "test", "2026-01-01", (1950, 2020))
    meta = doc.first().meta
    assert doc.select("meta").distinct().count() == 1
    assert (meta.total_makes, meta.total_models, meta.total_class_entries) == (2, 3, 4)
    assert [r.makes[0].make_name for r in doc.collect()] == ["Bmw", "Kia"]
    catalog_source.write_catalog(doc, str(tmp_path / "catalog"))
    back = catalog_source.read_catalog(spark, str(tmp_path / "catalog"), lines=True).collect()
    assert sorted((r.model_name, r.year) for r in back) == [("Ceed", 2010), ("M3", 1970), ("Rio", 2000), ("Rio", 2001)]
    folder = tmp_path / "models" / "7"
    folder.mkdir(parents=True)
    (folder / "2010.json").write_text(json.dumps({"Results": [
        {"Model_ID": 1, "Model_Name": "RIO  GT", "Make_ID": 7, "Make_Name": "KIA"},
        {"Model_ID": 1, "Model_Name": "other"}, {"Model_ID": None, "Model_Name": "x"}, {"Model_ID": 2, "Model_Name": ""}]}))
    got = catalog_source.read_model_responses(spark, str(tmp_path / "models")).collect()
    assert [(r.make_id, r.make_name, r.model_id, r.model_name, r.year) for r in got] == [(7, "Kia", 1, "Rio Gt", 2010)]
    makes = tmp_path / "makes.json"
    makes.write_text(json.dumps({"Results": [{"MakeId": 1, "MakeName": "ALFA ROMEO"}, {"MakeId": 1, "MakeName": "B"},
                                             {"MakeId": 2, "MakeName": None}]}))
    assert [tuple(r) for r in catalog_source.read_make_responses(spark, str(makes)).collect()] == [(1, "Alfa Romeo")]


def test_ranking(spark):
    models = spark.createDataFrame(
        [("Ford", "F", 1, 1, [2000, 2026]), ("Mercedes-benz", "C", 2, 2, [2026]), ("Odd", "A", 3, 3, []),
         ("Toyota", "B", 4, 4, [2026])], "make_name string, model_name string, make_id int, model_id int, years array<int>")
    ranked = catalog.rank_models(models, 2026).collect()
    assert [(r.make, r.score) for r in ranked] == [("Ford", 1.0), ("Toyota", 1.0), ("Mercedes-benz", 0.3)]
    loose = catalog.rank_models(models, 2026, ignore_case=True).collect()
    assert loose[2].score == 0.8
    assert catalog.rank_models(models, 2026, 0).count() == 0
    with pytest.raises(ValueError):
        catalog.rank_models(models, 2026, -1)
    seeds = catalog.seed_rows(catalog.rank_models(models, 2026, 1), ["bat", "craigslist"], cities=("a", "b"))
    assert [(r.source, r.target_year) for r in seeds.collect()] == [
        ("bat", 2000), ("craigslist", 2000), ("craigslist", 2000)]


def test_filters_reject_bad_arguments(spark):
    assert filters.source_list("a, b,,") == ["a", "b"] and filters.source_list(["a "]) == ["a"]
    for bad in ("", " , ", [], ["a", " "]):
        with pytest.raises(ValueError):
            filters.source_list(bad)
    listings = spark.createDataFrame([("1", 5)], "listing_id string, mileage int")
    with pytest.raises(ValueError):
        filters.update_listings(listings, spark.createDataFrame([("1", "u")], "listing_id string, url string"))


def test_idempotent_insert(spark):
    target = spark.createDataFrame([("a", 0)], "k string, n int")
    incoming = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "k string, n int")
    once = lookups.upsert_new(target, incoming, "k", ["n"])
    twice = lookups.upsert_new(once, incoming, "k", ["n"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 0), ("b", 2)]


def test_orderings(spark):
    images = spark.createDataFrame(
        [("c", "l", None, "2024-01-01"), ("b", "l", 2, "2024-01-02"), ("a", "l", 2, "2024-01-01"), ("x", "m", 1, "2024-01-01")],
        "image_id string, listing_id string, position int, downloaded_at string")
    assert [r.image_id for r in filters.images_for_listing(images, "l").collect()] == ["a", "b", "c"]
    listings = spark.createDataFrame(
        [("1", "s", 2010, "Kia", "Rio", "2024-01-01"), ("2", "s", 2010, "Kia", "Rio", "2024-01-03"),
         ("3", "t", 2011, "Kia", "Ceed", "2024-01-02")],
        "listing_id string, source string, year int, make string, model string, scraped_at string")
    assert [r.listing_id for r in filters.list_by_class(listings).collect()] == ["2", "3", "1"]
    assert [r.listing_id for r in filters.list_by_class(listings, make="Kia", model="Rio", limit=1).collect()] == ["2"]
    assert filters.list_by_class(listings, year=1).count() == 0


def test_images_of_listings_without_their_other_fields(spark):
    """The rows of ``parse_listings``, for pages with and without a listing, and no hash of the page."""
    photo = '<img slot="image" src="https://platform.cstatic-images.com/1.jpg">'
    cars, post = "https://www.cars.com/vehicledetail/{}/", "https://sfbay.craigslist.org/eby/cto/d/x/{}.html"
    thumb = '<a class="thumb" href="/t.jpg"></a><p class="postinginfo">post id: 7654321</p>'
    rows = [(cars.format("a1"), "cars_com", photo + _ld(VEHICLE)), (cars.format("a2"), "cars_com", photo),
            (cars.format("a3"), "cars_com", f"<title>2019 Honda Civic LX | Cars.com</title>{photo}"),
            (post.format(7654321), "craigslist", thumb), ("https://x.craigslist.org/z", "craigslist", thumb),
            ("https://bringatrailer.com/listing/lot-1/", "bat", "<p>nothing</p>"),
            ("https://www.autotrader.com/cars-for-sale/vehicle/1000001", "autotrader", _ld(VEHICLE)),
            ("https://other/1", "other", _ld(VEHICLE)), ("https://other/2", None, _ld(VEHICLE)),
            (cars.format("a4"), "cars_com", None)]
    df = spark.createDataFrame([(u, s, "listing", h, None, None, None) for u, s, h in rows], PAGE)
    found = pages.listing_images(df, 2026)
    names = ["listing_id", "source", "image_urls"]
    assert sorted(map(repr, found.collect())) == sorted(
        map(repr, pages.parse_listings(df, 2026).select(*names).collect()))
    assert found.where("listing_id is not null and size(image_urls) > 0").count() == 5
    assert "sha2" not in found._jdf.queryExecution().executedPlan().toString()
