"""Label, text, number and date expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    CANONICAL_MAKES, RAW_MAKES, big, canonical, listings, over, pick, query, r6, sql_list, stamp,
    table,
)
from motorgrid import constants as K
from motorgrid.functions import calc, labels, media, text, titles, urls
from motorgrid.functions import vectors as vec

# Spellings spread over the parts: hyphen, apostrophe, digit, white space, upper case.
_SPELLED = ("f-150 {}", "o'neil {}", "3series {}", "  rl  {} ", "ABT {}", "cx/5 {}")
_TITLED = ("F-150 {}", "O'Neil {}", "3Series {}", "Rl  {}", "Abt {}", "Cx/5 {}")


def _spelled(spark, sf):
    part = table(spark, sf, "part")
    shape = pick(_SPELLED, F.col("p_partkey") % 6)
    return part.withColumn("raw", F.replace(shape, F.lit("{}"), F.split("p_name", " ")[1]))


_RAW_SQL = f"replace(({sql_list(_SPELLED)})[p_partkey % 6 + 1], '{{}}', split_part(p_name, ' ', 2))"
_CAP = "upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]"


def _titled(shapes):
    return f"replace(({sql_list(shapes)})[p_partkey % 6 + 1], '{{}}', {_CAP})"


@query("normalize_make", f"""
    SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN
      ({sql_list(CANONICAL_MAKES)})[p_partkey % 8 + 1] END AS make FROM part""")
def _(spark, sf):
    raw = F.when(F.col("p_size") % 9 != 0, pick(RAW_MAKES, F.col("p_partkey") % 8)).otherwise("  ")
    return table(spark, sf, "part").select(
        "p_partkey", labels.normalize_make(raw).alias("make"))


@query("normalize_make_aliases", """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MINI' WHEN 1 THEN 'smart' WHEN 2 THEN 'Lamborghini'
      ELSE p_brand END AS make FROM part""")
def _(spark, sf):
    raw = F.coalesce(pick(("Mini", "SMART", "lamorghini"), F.col("p_partkey") % 4), F.lower("p_brand"))
    return table(spark, sf, "part").select("p_partkey", labels.normalize_make(raw).alias("make"))


@query("normalize_model", f"SELECT p_partkey, {_titled(_TITLED)} AS model FROM part")
def _(spark, sf):
    return _spelled(spark, sf).select(
        "p_partkey", labels.normalize_model(F.col("raw")).alias("model"))


@query("title_case", f"""
    SELECT p_partkey, {_titled((*_TITLED[:3], '  Rl  {} ', *_TITLED[4:]))} AS title FROM part""")
def _(spark, sf):
    return _spelled(spark, sf).select("p_partkey", text.title_case(F.col("raw")).alias("title"))


@query("strip_text", r"""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS digest
    FROM documents""")
def _(spark, sf):
    padded = F.concat(F.lit("\t \n"), "text", F.lit(" \t\r\n"))
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(text.strip(padded), 256).alias("digest"))


@query("catalog_title_case", f"""
    SELECT p_partkey, {_titled(('F-150 {}', "O'neil {}", '3series {}', 'Rl {}', 'Abt {}', 'Cx/5 {}'))}
      AS title FROM part""")
def _(spark, sf):
    return _spelled(spark, sf).select("p_partkey", text.catalog_title(F.col("raw")).alias("title"))


@query("token_title_case", f"""
    SELECT p_partkey, {_titled((*_TITLED[:3], '  Rl  {} ', *_TITLED[4:]))} AS title FROM part""")
def _(spark, sf):
    return _spelled(spark, sf).select("p_partkey", text.token_title(F.col("raw")).alias("title"))


@query("segment_title_case", f"""
    SELECT p_partkey, {_titled(('F-150 {}', "O'neil {}", '3series {}', '  Rl  {} ', 'Abt {}', 'Cx/5 {}'))}
      AS title FROM part""")
def _(spark, sf):
    return _spelled(spark, sf).select("p_partkey", text.segment_title(F.col("raw")).alias("title"))


_CLASS_SQL = """generation_year || '|' || lower(canonical_make) || '|' || lower(canonical_model)"""


@query("class_id", over("v_canonical", f"SELECT listing_id, {_CLASS_SQL} AS class_id FROM v_canonical"))
def _(spark, sf):
    return canonical(spark, sf).select("listing_id", labels.class_id(
        F.col("generation_year"), F.col("canonical_make"), F.col("canonical_model"))
        .alias("class_id"))


@query("display_name", over("v_canonical", """
    SELECT listing_id, CASE WHEN generation_year IS NULL THEN 'no class' ELSE
      generation_year || '-' || (generation_year + 3) || ' ' || CASE canonical_make WHEN 'BMW'
      THEN 'Bmw' ELSE canonical_make END || ' ' || canonical_model END AS name FROM v_canonical"""))
def _(spark, sf):
    ident = F.coalesce(labels.class_id(
        F.col("generation_year"), F.col("canonical_make"), F.col("canonical_model")),
        F.lit("no class"))
    return canonical(spark, sf).select("listing_id", labels.display_name(ident).alias("name"))


@query("slugify", rf"""
    SELECT p_partkey, trim(regexp_replace({_RAW_SQL}, '[^A-Za-z0-9-]+', '_', 'g'), '_') AS slug
    FROM part""")
def _(spark, sf):
    return _spelled(spark, sf).select("p_partkey", text.slugify(F.col("raw")).alias("slug"))


@query("class_slug", over("v_listings", r"""
    SELECT listing_id, trim(regexp_replace(concat_ws('_', year, make, model, trim),
      '[^A-Za-z0-9-]+', '_', 'g'), '_') AS slug FROM v_listings"""))
def _(spark, sf):
    return listings(spark, sf).select("listing_id", labels.class_slug(
        F.col("make"), F.col("model"), F.col("year"), F.col("trim")).alias("slug"))


@query("generation_label", """
    SELECT o_orderkey, g || '-' || (g + 3) AS label FROM (SELECT o_orderkey,
      1980 + floor((year(o_orderdate) - 30 - 1980) / 4.0)::INT * 4 AS g FROM orders)""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", calc.generation_label(F.year("o_orderdate") - 30).alias("label"))


@query("generation_year", """
    SELECT o_orderkey, (1980 + floor((year(o_orderdate) - o_custkey % 60 - 1980) / 4.0) * 4)::BIGINT
      AS generation FROM orders""")
def _(spark, sf):
    year = (F.year("o_orderdate") - F.col("o_custkey") % 60).cast("int")
    return table(spark, sf, "orders").select(
        "o_orderkey", calc.generation_year(year).cast("bigint").alias("generation"))


@query("era_bucket", """
    SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'unknown'
        ELSE (year(o_orderdate) // 10 * 10) || 's' END AS era,
      CASE WHEN o_custkey % 7 = 0 THEN 'unknown' ELSE (year(o_orderdate) // 4 * 4) || '-' ||
        (year(o_orderdate) // 4 * 4 + 3) END AS era4 FROM orders""")
def _(spark, sf):
    year = F.when(F.col("o_custkey") % 7 != 0, F.year("o_orderdate"))
    return table(spark, sf, "orders").select(
        "o_orderkey", calc.era_bucket(year).alias("era"), calc.era_bucket(year, 4).alias("era4"))


@query("recency_weight", """
    SELECT p_partkey, round(CASE WHEN p_size - 5 <= 0 THEN 1 WHEN p_size - 5 >= 40 THEN 0.02
      ELSE exp(-(p_size - 5) / 15.0) END, 6)::DOUBLE AS weight FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", r6(calc.recency_weight(F.lit(2031) - F.col("p_size"), 2026)).alias("weight"))


@query("retry_backoff", """
    SELECT event_id, strftime(ts + to_seconds(least(2 ** (user_id % 16), 3600)::INT),
      '%Y-%m-%d %H:%M:%S') AS next_try FROM events""")
def _(spark, sf):
    seconds = calc.backoff_seconds(F.col("user_id") % 16)
    return table(spark, sf, "events").select(
        "event_id", stamp(calc.plus_seconds(F.col("ts"), seconds)).alias("next_try"))


@query("round_half_even", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
      round_even(l_quantity * 0.5, 0)::BIGINT AS half FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", big("l_linenumber"), "l_partkey", "l_suppkey",
        calc.round_half_even(F.col("l_quantity") * 0.5).alias("half"))


@query("off_peak_flag", """
    SELECT event_id, hour(ts) >= 22 OR hour(ts) < 4 AS night, hour(ts) >= 1 AND hour(ts) < 6
      AS early, false AS never FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", calc.is_off_peak(F.col("ts"), 22, 4).alias("night"),
        calc.is_off_peak(F.col("ts"), 1, 6).alias("early"),
        calc.is_off_peak(F.col("ts"), 3, 3).alias("never"))


@query("view_index", over("v_images", f"""
    SELECT coalesce(view, 'none') AS view, coalesce((CASE WHEN view = 'interior' THEN 5 ELSE
      list_position({sql_list(K.EXTERIOR_VIEWS)}, view) - 1 END)::VARCHAR, 'rejected') AS six,
      coalesce((CASE WHEN view = 'interior' THEN 1 WHEN view IS NOT NULL THEN 0 END)::VARCHAR,
      'rejected') AS two, count(*) AS n FROM v_images GROUP BY ALL"""))
def _(spark, sf):
    from checks.base import images

    view = F.col("view")
    return images(spark, sf).groupBy(
        F.coalesce(view, F.lit("none")).alias("view"),
        F.coalesce(calc.view_index(view).cast("string"), F.lit("rejected")).alias("six"),
        F.coalesce(calc.binary_view_index(view).cast("string"), F.lit("rejected")).alias("two"),
    ).agg(F.count("*").alias("n"))


@query("parse_digits", """
    SELECT c_custkey, c_custkey * 1000 + 500 AS digits, 'none' AS missing FROM customer""")
def _(spark, sf):
    raw = F.concat("c_name", F.lit(",5 and 00 mi"))
    return table(spark, sf, "customer").select(
        "c_custkey", text.parse_digits(raw).alias("digits"),
        F.coalesce(text.parse_digits(F.col("c_mktsegment")).cast("string"), F.lit("none"))
        .alias("missing"))


@query("parse_year", r"""
    SELECT doc_id, coalesce(list_filter(list_transform(regexp_extract_all(
      regexp_replace(text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)', 1),
      lambda x: x::INT), lambda y: y BETWEEN 1900 AND 2027)[1], 0)::BIGINT AS year FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.coalesce(text.parse_year(F.col("text"), 2026), F.lit(0)).cast("bigint").alias("year"))


@query("choice_index", r"""
    SELECT conv_id, turn, CASE WHEN try_cast(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) < 5
      THEN regexp_extract(text, '([0-9]+)', 1)::BIGINT ELSE -1 END AS choice FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.choice_index(F.col("text"), 5).cast("bigint").alias("choice"))


@query("text_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.text_hash(F.col("text")).alias("digest"))


@query("media_type", """
    SELECT doc_id, (['image/jpeg', 'image/png', 'text/html', ''])[doc_id % 4 + 1] AS media,
      coalesce((['.jpg', '.png'])[doc_id % 4 + 1], 'unsupported') AS ext FROM documents""")
def _(spark, sf):
    header = pick((" Image/JPEG; charset=x", "image/png", "text/html;q=1"), F.col("doc_id") % 4)
    return table(spark, sf, "documents").select(
        "doc_id", media.media_type(header).alias("media"),
        F.coalesce(media.media_extension(header), F.lit("unsupported")).alias("ext"))


@query("content_path", """
    SELECT doc_id, concat_ws('/', 'data', source, source || ':' || doc_id, sha256(text) || '.jpg')
      AS path FROM documents""")
def _(spark, sf):
    listing = labels.listing_key(F.col("source"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", media.content_path(
        F.col("source"), listing, text.text_hash(F.col("text")),
        media.media_extension(F.lit("image/jpeg")), "data").alias("path"))


@query("synthetic_urls", """
    SELECT doc_id, 'vmmrdb:' || sha256(text) AS listing_id, 'vmmrdb://' || source || '/' || sha256(text)
      AS url FROM documents""")
def _(spark, sf):
    digest = text.text_hash(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", labels.listing_key(F.lit("vmmrdb"), digest).alias("listing_id"),
        media.synthetic_url("vmmrdb", F.col("source"), digest).alias("url"))


@query("vin_extract", r"""
    SELECT doc_id, coalesce(nullif(regexp_extract(upper(replace(text, 'ß', 'ss') || ' ' || v),
      '(?:^|[^\p{L}\p{N}_])([A-HJ-NPR-Z0-9]{17})(?:[^\p{L}\p{N}_]|$)', 1), ''), 'none') AS vin
    FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN upper(sha256(text)[:17]) ELSE '' END AS v
      FROM documents)""")
def _(spark, sf):
    vin = F.when(F.col("doc_id") % 3 == 0, F.upper(F.substring(F.sha2("text", 256), 1, 17))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(titles.vin(
        F.lit("no label"), F.concat_ws(" ", "text", vin)), F.lit("none")).alias("vin"))


@query("vin_attribute", "SELECT doc_id, upper(sha256(text)[:17]) AS vin FROM documents")
def _(spark, sf):
    attrs = F.concat(F.lit("type: suv | vin: "), F.substring(F.sha2("text", 256), 1, 17), F.lit(" | x"))
    return table(spark, sf, "documents").select("doc_id", titles.vin(attrs, F.col("text")).alias("vin"))


@query("key_value_extract", r"""
    SELECT event_id, event_type AS kind, regexp_extract(props, '([0-9]+)', 1) AS odometer FROM events""")
def _(spark, sf):
    blob = F.concat(F.lit("odometer: "), F.regexp_extract("props", r"(\d+)", 1),
                    F.lit(" | type:  "), "event_type", F.lit("  "))
    return table(spark, sf, "events").select(
        "event_id", text.key_value(blob, "type").alias("kind"),
        text.key_value(blob, "odometer").alias("odometer"))


_CLASS_FORMS = ("{make}_{model}_{year}", "{make}_{model}", "_{model}", "{make}", "{make}_")


def _form(forms, col, make, model, year):
    out = pick(forms, col)
    for name, value in (("make", make), ("model", model), ("year", year)):
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


@query("parse_underscore_class", """
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN (2000 + p_size % 20)::VARCHAR END AS year,
      CASE WHEN p_partkey % 5 < 2 THEN split_part(p_name, ' ', 1) END AS make,
      CASE WHEN p_partkey % 5 < 2 THEN split_part(p_name, ' ', 2) END AS model,
      (['', '', 'empty make', 'no separator', 'empty model'])[p_partkey % 5 + 1] AS reason FROM part""")
def _(spark, sf):
    raw = _form(_CLASS_FORMS, F.col("p_partkey") % 5, F.split("p_name", " ")[0],
                F.split("p_name", " ")[1], F.lit(2000) + F.col("p_size") % 20)
    parsed = table(spark, sf, "part").select(
        "p_partkey", labels.parse_underscore_class(raw).alias("c"))
    return parsed.select("p_partkey", F.col("c.year").cast("string").alias("year"), "c.make", "c.model",
                         F.coalesce("c.reason", F.lit("")).alias("reason"))


_SPACED_FORMS = ("AM General {model} SUV {year}", "{make} {model} Crew Cab {year}", "{make} {model}",
                 "{make} {year}", "unheard {model} {year}", "{make} Sedan {year}")


@query("parse_spaced_class", """
    SELECT p_partkey, CASE WHEN k IN (0, 1, 4) THEN (2000 + p_size % 20)::VARCHAR END AS year,
      CASE k WHEN 0 THEN 'AM General' WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 4 THEN 'unheard' END
        AS make, CASE WHEN k IN (0, 1, 4) THEN split_part(p_name, ' ', 2) END AS model,
      CASE k WHEN 0 THEN 'SUV' WHEN 1 THEN 'Crew Cab' END AS body_style,
      (['', '', 'no trailing year', 'no model after make', '', 'no model before body'])[k + 1] AS reason
    FROM (SELECT *, p_partkey % 6 AS k FROM part)""")
def _(spark, sf):
    part = table(spark, sf, "part")
    raw = _form(_SPACED_FORMS, F.col("p_partkey") % 6, F.split("p_name", " ")[0],
                F.split("p_name", " ")[1], F.lit(2000) + F.col("p_size") % 20)
    makes = part.select(F.initcap(F.split("p_name", " ")[0]).alias("make_name")).union(
        part.limit(1).select(F.lit("Am General")))
    done = labels.parse_spaced_class(part.select("p_partkey", raw.alias("raw")), "raw", makes)
    return done.select("p_partkey", F.col("year").cast("string").alias("year"), "make", "model",
                       "body_style", F.coalesce("reason", F.lit("")).alias("reason"))


@query("parse_id_path", """
    SELECT l_orderkey, l_suppkey, CASE WHEN good THEN l_partkey::VARCHAR END AS make_id,
      CASE WHEN good THEN y::VARCHAR END AS year, CASE WHEN good THEN '' WHEN l_partkey <= 0
      THEN 'non-positive id' ELSE 'unusable year' END AS reason
    FROM (SELECT *, l_partkey > 0 AND y <> 5008 AS good FROM (SELECT *, CASE WHEN l_linenumber = 4
      THEN 5008 ELSE year(l_shipdate) END AS y FROM lineitem))""")
def _(spark, sf):
    year = F.when(F.col("l_linenumber") == 4, 5008).otherwise(F.year("l_shipdate"))
    path = F.concat(F.lit("top/x/image/"), F.concat_ws("/", "l_partkey", F.lit(7), year, F.lit("a.jpg")))
    parsed = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", labels.parse_id_path(path).alias("c"))
    return parsed.select(
        "l_orderkey", "l_suppkey", F.col("c.make_id").cast("string").alias("make_id"),
        F.col("c.year").cast("string").alias("year"), F.coalesce("c.reason", F.lit("")).alias("reason"))


@query("category_label", """
    SELECT p_partkey, CASE WHEN k < 4 THEN (CASE k WHEN 2 THEN 1965 ELSE 1950 + p_size END)::VARCHAR
      END AS year, CASE WHEN k < 4 THEN 'Chevrolet' END AS make,
      CASE WHEN k < 4 THEN split_part(p_name, ' ', 2) END AS model
    FROM (SELECT *, p_partkey % 6 AS k FROM part)""")
def _(spark, sf):
    k, year = F.col("p_partkey") % 6, (F.lit(1950) + F.col("p_size")).cast("string")
    model = F.split("p_name", " ")[1]
    named = F.concat(F.lit("Category:Chevrolet "), model)
    cats = (
        F.when(k == 0, F.array(F.concat(F.lit("Category:Cars introduced in "), year), named))
        .when(k == 1, F.array(F.lit("Chevy (cars)"), named, F.concat(year, F.lit(" Chevy x"))))
        .when(k == 2, F.array(named, F.lit("Category:1960s_automobiles")))
        .when(k == 3, F.array(F.concat(year, F.lit(" vehicles")), F.lit("Sedans"), named))
        .when(k == 4, F.array(F.concat(year, F.lit(" Top Album Covers")), named))
        .otherwise(F.array(F.concat(year, F.lit(" cars")), F.lit("Chevrolet"))))
    found = table(spark, sf, "part").select("p_partkey", labels.category_label(cats).alias("c"))
    return found.select("p_partkey", F.col("c.year").cast("string").alias("year"), "c.make", "c.model")


@query("free_title", over("v_listings", """
    SELECT listing_id, coalesce(year::VARCHAR, '') AS year,
      (['', '', 'Mazda', '', 'Acura', '', 'Ford', 'Honda'])[listing_id::BIGINT % 8 + 1] AS make,
      CASE WHEN listing_id::BIGINT % 8 IN (2, 4, 6, 7) THEN upper(model[1]) || model[2:] || ' ' ||
        upper(trim[1]) || trim[2:] ELSE '' END AS model FROM v_listings"""))
def _(spark, sf):
    title = F.concat_ws(" ", F.lit("clean"), "make", "year", "model", "trim", F.lit("$9,000 x"))
    parsed = listings(spark, sf).select("listing_id", titles.free_title(title, 2026).alias("t"))
    blank = F.lit("")
    return parsed.select("listing_id", F.coalesce(F.col("t.year").cast("string"), blank).alias("year"),
                         F.coalesce("t.make", blank).alias("make"), F.coalesce("t.model", blank).alias("model"))


@query("auction_name", over("v_listings", """
    SELECT listing_id, (['', '', 'Mazda', '', 'Acura', '', 'Ford', 'Honda'])[listing_id::BIGINT % 8 + 1]
        AS make,
      CASE WHEN listing_id::BIGINT % 8 IN (2, 4, 6, 7) THEN upper(model[1]) || model[2:] ELSE '' END
        AS model,
      CASE WHEN listing_id::BIGINT % 8 IN (2, 4, 6, 7) THEN upper(trim[1]) || trim[2:] || ' Gt' ELSE ''
        END AS trim FROM v_listings"""))
def _(spark, sf):
    name = F.concat_ws(" ", F.lit("No Reserve: honda 1999"), "make", "model", "trim", F.lit("GT - sold"))
    parsed = listings(spark, sf).select("listing_id", titles.auction_name(name).alias("t"))
    blank = F.lit("")
    return parsed.select("listing_id", *[F.coalesce(f"t.{c}", blank).alias(c) for c in ("make", "model", "trim")])


@query("page_title", over("v_listings", """
    SELECT listing_id, coalesce(year::VARCHAR, '') AS year, CASE WHEN year IS NOT NULL THEN trim ELSE ''
      END AS make, CASE WHEN year IS NOT NULL THEN model ELSE '' END AS model,
      CASE WHEN year IS NOT NULL THEN 'LX Sport' ELSE '' END AS trim FROM v_listings"""))
def _(spark, sf):
    title = F.concat_ws(" ", F.lit("Used"), "year", "trim", "model", F.lit("LX Sport For Sale $1 | Cars.com"))
    parsed = listings(spark, sf).select("listing_id", titles.page_title(title, 2026).alias("t"))
    blank = F.lit("")
    return parsed.select("listing_id", F.coalesce(F.col("t.year").cast("string"), blank).alias("year"),
                         *[F.coalesce(f"t.{c}", blank).alias(c) for c in ("make", "model", "trim")])


@query("l2_normalize", """
    SELECT vec_id, i AS pos, round(x / n, 6) + 0.0::DOUBLE AS value FROM (
      SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i,
        sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def _(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", F.posexplode(
        vec.l2_normalize(F.col("embedding"))).alias("pos", "value"))
    return unit.select("vec_id", big("pos"), r6("value").alias("value"))


@query("cosine_per_row", """
    SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
      + 0.0::DOUBLE AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select(
        "vec_id", r6(vec.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("search_url_templates", over("v_listings", f"""
    SELECT listing_id, 'https://www.cars.com/shopping/results/?makes[]=' || mk || '&models[]=' || mk ||
        '-' || lower(model) || '&year_min=' || year || '&year_max=' || (year + 3) || '&stock_type=all'
        AS cars_com,
      'https://www.autotrader.com/cars-for-sale/all-cars/' || mk || '/' || lower(model) || '?yearMin='
        || year || '&yearMax=' || (year + 3) AS autotrader,
      'https://bringatrailer.com/' || mk || '/' || lower(model) || '/?year_min=' || year || '&year_max='
        || (year + 3) AS bat,
      'https://www.hemmings.com/classifieds/cars-for-sale/' || mk || '/' || lower(model) ||
        '?YearFrom=' || year || '&YearTo=' || (year + 3) AS hemmings,
      'https://carsandbids.com/search?q=' || q || '&year_min=' || year || '&year_max=' || (year + 3)
        AS carsandbids,
      array_to_string(list_transform({sql_list(K.CRAIGSLIST_CITIES)}, lambda c:
        'https://' || c || '.craigslist.org/search/cta?auto_make_model=' || q || '&min_auto_year=' || year ||
        '&max_auto_year=' || (year + 3) || '&query=' || q), ' ') AS craigslist
    FROM (SELECT *, replace(lower(make), ' ', '-') AS mk, replace(make || ' ' || model, ' ', '+') AS q
      FROM v_listings WHERE year IS NOT NULL)"""))
def _(spark, sf):
    rows = listings(spark, sf).where("year is not null")
    args = (F.col("make"), F.col("model"), F.col("year"), F.col("year") + 3)
    return rows.select("listing_id", *[
        F.array_join(urls.search_urls(site, *args), " ").alias(site)
        for site in ("cars_com", "autotrader", "bat", "hemmings", "carsandbids", "craigslist")])
