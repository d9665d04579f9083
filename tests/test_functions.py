from urllib.parse import quote_plus, urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from motorgrid.functions import calc, labels, media, text, titles, urls, vectors

V = F.col("v")


def test_title_and_strip_follow_python(evaluate):
    words = ["f-150", "o'neil", "3series", "RL SEDAN", "ABT A3", "citroën c4", "a", "", "x  y"]
    assert evaluate(text.title_case(V), words) == [w.title() for w in words]
    padded = [" a ", "\tb\n", " c ", "d", "", "  "]
    assert evaluate(text.strip(V), padded) == [w.strip() for w in padded]
    catalog = ["  ALFA   ROMEO ", "MERCEDES-BENZ", "bmw"]
    assert evaluate(text.catalog_title(V), catalog) == ["Alfa Romeo", "Mercedes-benz", "Bmw"]
    assert evaluate(text.token_title(V), ["f-150", "cx-5", "CIVIC", "ÉCLAIR x"]) == [
        "F-150", "Cx-5", "Civic", "ÉClair X"]
    assert evaluate(text.segment_title(V), ["bmw", "land rover", "mercedes-benz"]) == [
        "Bmw", "Land Rover", "Mercedes-Benz"]


def test_make_model_and_class(evaluate):
    raw = ["Chevy", " bwm ", "MAZDA", "acura", "Benz", "land-rover", "", None, "  ", "Smart"]
    assert evaluate(labels.normalize_make(V), raw) == [
        "Chevrolet", "BMW", "Mazda", "Acura", "Mercedes-Benz", "Land Rover", None, None, None,
        "smart"]
    assert evaluate(labels.normalize_model(V), ["rl sedan", "ABT A3", " ", None]) == [
        "Rl Sedan", "Abt A3", None, None]
    years = [1980, 1983, 1984, 2012, 2015, 2016, 1979, 1976, 1975, None]
    assert evaluate(labels.generation_year(V), years, "v int") == [
        1980, 1980, 1984, 2012, 2012, 2016, 1976, 1976, 1972, None]
    assert evaluate(labels.generation_label(V), [2014], "v int") == ["2012-2015"]
    parts = [(2012, " Honda", "Civic "), (None, "a", "b"), (2012, " ", "b"), (2012, "a", None)]
    assert evaluate(
        labels.class_id(F.col("y"), F.col("mk"), F.col("md")), parts, "y int, mk string, md string"
    ) == ["2012|honda|civic", None, None, None]
    assert evaluate(labels.display_name(V), ["2012|honda|civic", "x|y", "a|b|c"]) == [
        "2012-2015 Honda Civic", "x|y", "a|b|c"]
    assert evaluate(text.slugify(V), ["a b//c__d", "_x_", "Ford F-150 é"]) == [
        "a_b_c_d", "x", "Ford_F-150_é"]


def test_numbers(evaluate):
    assert evaluate(text.parse_digits(V), ["12,345 mi", "$45,000", "none", None]) == [
        12345, 45000, None, None]
    assert evaluate(text.parse_year(V, 2026), [
        "1999 Honda", "12345 2010", "1800 and 2027", "2028", None]) == [1999, 2010, 2027, None, None]
    assert evaluate(calc.era_bucket(V), [2012, None, 1979], "v int") == [
        "2010s", "unknown", "1970s"]
    assert evaluate(calc.era_bucket(V, 4), [2013], "v int") == ["2012-2015"]
    assert evaluate(calc.era_bucket(V, 0), [2013, None], "v int") == ["2013", "unknown"]
    weights = evaluate(calc.recency_weight(V, 2026), [2026, 2030, 2011, 1986, 1900], "v int")
    assert weights[0] == weights[1] == 1.0 and weights[3] == weights[4] == 0.02
    assert abs(weights[2] - 0.36787944) < 1e-8
    assert evaluate(calc.backoff_seconds(V), [1, 4, 11, 12, 40], "v int") == [
        2, 16, 2048, 3600, 3600]
    assert evaluate(calc.round_half_even(V), [0.5, 1.5, 2.5, 10.4], "v double") == [0, 2, 2, 10]
    assert evaluate(calc.view_index(V), ["front", "three-quarter-rear", "detail", "odd"]) == [
        0, 4, 5, None]
    assert evaluate(calc.binary_view_index(V), ["front", "interior", "odd"]) == [0, 1, None]
    hours = [f"2024-01-01 {h:02d}:30:00" for h in (1, 6, 22)]
    when = F.to_timestamp("v")
    assert evaluate(calc.is_off_peak(when, 22, 4), hours) == [True, False, True]
    assert evaluate(calc.is_off_peak(when, 1, 6), hours) == [True, False, False]
    assert evaluate(calc.is_off_peak(when, 3, 3), hours) == [False, False, False]
    assert evaluate(text.choice_index(V, 5), ["3", "-1", "answer 4!", "9", "no", None]) == [
        3, 1, 4, -1, -1, -1]


def test_class_strings(evaluate):
    rows = evaluate(labels.parse_underscore_class(V), [
        "honda_civic_2005", "ford_f-150_2010", "chevrolet_silverado_1500_2012",
        "mercedes benz_s550", "", "honda", "_civic", "honda_", "honda_2005"])
    assert [tuple(r) for r in rows] == [
        (2005, "honda", "civic", None), (2010, "ford", "f-150", None),
        (2012, "chevrolet", "silverado_1500", None), (None, "mercedes benz", "s550", None),
        (None, None, None, "empty class"), (None, None, None, "no separator"),
        (None, None, None, "empty make"), (None, None, None, "empty model"),
        (None, None, None, "no separator")]
    rows = evaluate(labels.parse_id_path(V), [
        "image/1/22/2012/abc.jpg", "Data/x/image/1/22/2012/abc.jpg", "image/0/2/2012/a.jpg",
        "image/1/2/5008/a.jpg", "image/1/2/nan/a.jpg", "image/1/2/1850/a.jpg", "misc/a.mat"])
    assert [tuple(r) for r in rows] == [
        (1, 22, 2012, None), (1, 22, 2012, None), (None, None, None, "non-positive id"),
        (None, None, None, "unusable year"), (None, None, None, "unusable year"),
        (None, None, None, "year out of range"), (None, None, None, "not an image path")]


def test_spaced_class(spark):
    makes = spark.createDataFrame([("Acura",), ("Am General",), ("Hyundai",)], "make_name string")
    raw = ["Acura RL Sedan 2012", "AM General Hummer SUV 2000", "Hyundai Sonata 2007",
           "Ford F-150 Regular Cab 2012", "Acura 2012", "Acura Sedan 2012", "Acura RL", " ", "2012"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    out = labels.parse_spaced_class(df, "raw", makes).orderBy("i").collect()
    assert [(r.year, r.make, r.model, r.body_style, r.reason) for r in out] == [
        (2012, "Acura", "RL", "Sedan", None), (2000, "AM General", "Hummer", "SUV", None),
        (2007, "Hyundai", "Sonata", None, None), (2012, "Ford", "F-150", "Regular Cab", None),
        (None, None, None, None, "no model after make"),
        (None, None, None, None, "no model before body"),
        (None, None, None, None, "no trailing year"), (None, None, None, None, "empty class"),
        (None, None, None, None, "no trailing year")]


def test_category_labels(evaluate):
    cases = [
        (["Category:1965 Ford Mustang", "Category:Ford Mustang"], (1965, "Ford", "Mustang")),
        (["Category:1960s automobiles"], None),
        (["Category:Cars introduced in 1972", "Category:Chevrolet Chevelle"],
         (1972, "Chevrolet", "Chevelle")),
        (["1960s_cars", "BMW vehicles", "BMW 2002"], (1965, "BMW", "vehicles")),
        (["1965 Top Album Covers", "Ford Mustang"], None),
        (["Forde X", "1970 automobiles"], None),
        (["1970 automobiles", "Chevy (cars)", "Chevrolet-Nova"], (1970, "Chevrolet", "Nova")),
        ([], None), (None, None),
    ]
    got = evaluate(labels.category_label(V), [c for c, _ in cases], "v array<string>")
    assert [None if g is None else tuple(g) for g in got] == [e for _, e in cases]
    assert evaluate(labels.category_label(V, 1900, 1960), [cases[0][0]], "v array<string>") == [
        None]


def test_titles(evaluate):
    free = evaluate(titles.free_title(V, 2026), [
        "2019 ford f-150 supercrew $20,000", "BMW 328i 2011", "clean land rover defender (rare)",
        "nothing here 2005", "gmc", "", None, "ford f-150 2019 lariat xl"])
    assert [tuple(r) for r in free] == [
        (2019, "Ford", "F-150 Supercrew"), (2011, "BMW", "328I"),
        (None, "Land Rover", "Defender"), (2005, None, None), (None, "GMC", None),
        (None, None, None), (None, None, None), (2019, "Ford", "F-150 Lariat")]
    auction = evaluate(titles.auction_name(V), [
        "No Reserve: 1986 Honda Civic Si 5-Speed", "1989 Porsche 911 Carrera - Sold",
        "Land Rover Defender", "1990 bmw $5", "1990 Unknown Thing", None])
    assert [tuple(r) for r in auction] == [
        ("Honda", "Civic", "Si 5-Speed"), ("Porsche", "911", "Carrera"),
        ("Land Rover", "Defender", None), ("Bmw", None, None), (None, None, None),
        (None, None, None)]
    page = evaluate(titles.page_title(V, 2026), [
        "Used 2020 Honda Civic LX Sport For Sale $1 | Cars.com", "2020", "no year", None,
        "x2020 2020 Kia", "(2020) Kia"])
    assert [tuple(r) for r in page] == [
        (2020, "Honda", "Civic", "LX Sport"), (2020, None, None, None), (None,) * 4, (None,) * 4,
        (2020, "Kia", None, None), (2020, None, None, None)]
    assert evaluate(titles.vin(F.col("a"), F.col("b")), [
        ("vin: 1hgcm82633a004352 | x", ""), ("", "the vin 1HGCM82633A004352."), ("", "none")],
        "a string, b string") == ["1HGCM82633A004352", "1HGCM82633A004352", None]
    assert evaluate(text.key_value(V, "odometer"), ["type: suv | odometer: 12,000 | z", "x"]) == [
        "12,000", None]


def test_url_parts(evaluate):
    links = ["https://www.cars.com/vehicledetail/abc/", "http://NewYork.craigslist.org/a",
             "https://x.example.com/", "nonsense", "https://bringatrailer.com:443/listing/z/"]
    assert evaluate(urls.source_for_url(V), links) == [
        "cars_com", "craigslist", None, None, "bat"]
    inventory = ["https://a.com/cars-for-sale/vehicledetails/x/1234567",
                 "https://a.com/cars-for-sale/vehicle/123456/", "https://a.com/vehicle/1234567",
                 "https://a.com/cars-for-sale/vehicledetails/x-123"]
    assert evaluate(urls.is_inventory_listing(V), inventory) == [True, True, False, False]
    auctions = ["https://c.com/auctions/a", "https://c.com/auctions/a/b", "https://c.com/auctions/",
                "https://c.com/auctions/a/b/bids", "https://c.com/other"]
    assert evaluate(urls.is_auction_listing(V), auctions) == [True, True, False, False, False]
    ids = evaluate(urls.native_id(F.col("u"), F.col("s")), [
        ("https://www.cars.com/vehicledetail/ab-1/?x=1", "cars_com"),
        ("https://a.com/cars-for-sale/vehicle/123456", "autotrader"),
        ("https://ny.craigslist.org/cto/d/z/7654321.html", "craigslist"),
        ("https://bringatrailer.com/listing/1989-porsche/", "bat"),
        ("https://bringatrailer.com/other", "bat")], "u string, s string")
    assert ids == ["ab-1", "123456", "7654321", "1989-porsche", None]


def _python_normalize(base, href):
    parts = urlparse(urljoin(base, href))
    query = "&".join(
        p for p in parts.query.split("&") if p and not p.split("=", 1)[0].startswith("utm_"))
    return urlunparse(parts._replace(fragment="", query=query))


def test_normalize_url_follows_python(evaluate):
    bases = ["https://a.com/x/y?q=1#f", "https://a.com", "http://a.com/x/", "http://a.com/a/b/c"]
    hrefs = ["z", "/z?utm_source=a&k=1&utm_x", "../z", "./", "..", "../../../z/./w", "?p=2", "#top",
             "", "//b.com/k", "https://c.com/a/../b?utm_a=1#x", "mailto:me@x.com", "a//b", "/a//b/..",
             "https://c.com?k=1&k=1&&utm_q=2", "z/"]
    pairs = [(b, h) for b in bases for h in hrefs]
    got = evaluate(urls.normalize_url(F.col("b"), F.col("h")), pairs, "b string, h string")
    assert list(zip(pairs, got)) == [((b, h), _python_normalize(b, h)) for b, h in pairs]


def test_search_urls(evaluate):
    args = (F.lit("Land Rover"), F.lit("Range*Rover"), F.lit(2001), F.lit(2009))
    only = {s: evaluate(urls.search_urls(s, *args), ["x"])[0] for s in (
        "cars_com", "autotrader", "craigslist", "bat", "hemmings", "carsandbids")}
    assert only["cars_com"] == [
        "https://www.cars.com/shopping/results/?makes[]=land-rover&models[]=land-rover-range*rover"
        "&year_min=2001&year_max=2009&stock_type=all"]
    assert len(only["craigslist"]) == 10
    assert quote_plus("Land Rover Range*Rover") in only["craigslist"][0]
    assert only["carsandbids"][0].endswith("&year_min=2001&year_max=2009")


def test_media_and_vectors(evaluate):
    headers = ["image/JPEG; charset=x", "image/png", "text/html", None]
    assert evaluate(media.media_type(V), headers) == ["image/jpeg", "image/png", "text/html", ""]
    assert evaluate(media.media_extension(V), headers) == [".jpg", ".png", None, None]
    assert evaluate(vectors.l2_normalize(V), [[3.0, 4.0], [0.0, 0.0]], "v array<double>") == [
        [0.6, 0.8], [0.0, 0.0]]
    assert abs(evaluate(vectors.cosine(V, V), [[1.0, 2.0]], "v array<float>")[0] - 1) < 1e-9


def test_character_references_and_markup(evaluate):
    from motorgrid.functions import html

    v = F.col("v")
    assert evaluate(html.unescape(v), [
        "caf&eacute; &#8217;x &amp;lt;", "&bogus; & &#x1F600; &#xD800; a&b;", "&&amp;&", "&#0;", None, ""]) == [
        "café ’x &lt;", "&bogus; & 😀 &#xD800; a&b;", "&&&", "&#0;", None, ""]
    assert evaluate(html.inner_text(html.decoded(html.markup(v))), [
        "<p title='a>b'>x<!-- <b>no --><script>var a='</p>'</script> y&copy;</p>"]) == [
        "x y©"]


def test_markup_that_is_easily_misread(evaluate):
    from motorgrid.functions import html, jsonld

    marked = html.markup(F.col("v"))
    page = html.decoded(marked)
    assert evaluate(html.inner_text(page), [
        "I <3 this car. Great <b>runner</b> now", "a<!-->b<!-- - -- > -->c<!--d", "x <", "x</ y>z<?php 1 > 2?>",
        "<p title='it's' class=a>one</p>", "<b>un<i>closed", "<script>a</script x>b<style>c", "<p a='", "<p x=y",
        "2 < 3 & 4 > 1", "", None]) == [
        "I <3 this car. Great runner now", "a b c", "x <", "x z 2?>", "one", "un closed", "b", "", "",
        "2 < 3 & 4 > 1", "", None]
    links = F.transform(html.tags(page, "a"), lambda t: html.attribute(t, "href"))
    assert evaluate(links, [
        '<!-- <a href="/no"> --><a title="a>b" href="/x">', "<a data-href=/n href=/caf&eacute; >",
        """<A title='href="/no"' HREF = '/y'>""", '<a title="&quot; href=/no " href="/?a=1&amp;b=&#39;&#34;">', "<a href>", "<a\nhref=/z/>", "<abbr href=/no>"]) == [
        ["/x"], ["/café"], ["/y"], ["/?a=1&b='\""], [None], ["/z/"], []]
    body = F.transform(html.anchors(page), lambda a: html.inner_text(a["body"]))
    assert evaluate(body, ["<a href=x>one<b> two</b><a href=y>three</a> four"]) == [["one two", "three"]]
    nested = html.element(page, "div", lambda tag: html.attribute(tag, "id") == "in")
    deep = "<div>" * 50 + "x" + "</div>" * 50
    assert evaluate(html.inner_text(nested), [
        f"<div>a</div><div id=in>{deep}y</div>z", "<div id='in'>open<div>b</div>c", "<div id=out>a</div>"]) == [
        "x y", "open b c", None]
    types = F.transform(jsonld.blocks(marked), lambda b: F.try_variant_get(b, '$["@type"]', "string"))
    wrapped = '{"@graph": [[' * 10 + '{"@type": "Car"}, 3' + "]]}" * 10
    script = "<script type='application/ld+json'>{}</script>"
    assert evaluate(types, [
        script.format(f'[{{"@type": "Offer"}}, {wrapped}, "text", null]') + "<!--" + script.format("{}") + "-->",
        script.format('{"@graph": {"@type": "x"}, "@type": "Thing"}'), script.format("[[[]]]"), "none"]) == [
        ["Offer", "Car"], ["Thing"], [], []]


def test_long_markup_takes_linear_time(spark):
    """A megabyte of what a backtracking or nesting pattern would choke on."""
    import time

    from motorgrid.functions import html

    n = 2**20
    pages = ["<" * n, "x <" + "y" * n, "<a " * (n // 3), "<a x=" + "y" * n, "<a x='" + "y<a " * (n // 4),
             "<!--" * (n // 4), "<script>" * (n // 8), "</" * (n // 2), '="' * (n // 2), "<p>" * (n // 3),
             "<a href=x>" * (n // 10), "<b" * (n // 2), "&" * n, "&amp;" * (n // 5)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").repartition(12)
    marked = df.select("i", html.decoded(html.markup(F.col("html"))).alias("m"))
    began = time.time()
    rows = marked.select("i", F.length(html.inner_text(F.col("m"))).alias("n"), F.size(
        html.tags(F.col("m"), "a")).alias("links")).collect()
    assert time.time() - began < 60
    found = {r.i: (r.n, r.links) for r in rows}
    assert found[0] == (n, 0) and found[1] == (1, 0) and found[10] == (0, n // 10)


def test_id_path_is_matched_once(spark):
    rows = spark.range(3).select(labels.parse_id_path(F.concat(F.lit("x/image/1/2/2012/a"), "id", F.lit(".jpg"))).alias("c"))
    plan = rows.select("c.make_id", "c.year", "c.reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and "regexp_replace" not in plan


def test_id_paths_with_odd_parts(evaluate):
    got = evaluate(labels.parse_id_path(V), [
        "/image/1/2/2012/a.jpg", "x/image/image/1/2/2012/a.jpg", "image/9/image/1/2/2012/a.jpg",
        "a\nb/image/1/2/2012/a.jpg", "ximage/1/2/2012/a.jpg", "image/99999999999999999999/2/2012/a.jpg", "", None])
    assert [(r["make_id"], r["reason"]) for r in got] == [
        (1, None), (1, None), (None, "not an image path"), (1, None), (None, "not an image path"), (None, None),
        (None, "not an image path"), (None, "not an image path")]
