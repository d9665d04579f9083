"""Composite jobs, live smoothing, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    big, canonical, images, listings, now, over, pick, query, queue, r6, sql_list,
    stamp, table,
)
from checks.scalars import _CLASS_FORMS, _SPACED_FORMS, _form
from checks.tables import _COHERENT, _EXT, _SUMMARY
from checks.vectors import _long, _long_sql, protos, view_protos
from checks.web import _catalog_rows
from motorgrid import constants as K
from motorgrid.operators import catalog, crawlqueue, live
from motorgrid.plans import ingest, labelling, retrieval
from motorgrid.session import shared_path
from motorgrid.sources import catalog as catalog_source
from motorgrid.sources import tables
from motorgrid.sources.images import labelled_files, scan_image_tree, write_files
from motorgrid.sources.sitemaps import scan_sitemap_xml
from motorgrid.streaming import jobs as streams


def _scratch(spark, name):
    return shared_path(spark, name)


# ---- smoothing and detections -------------------------------------------------

_LABELS = ("civic", "accord", "camry", "f-150")
# Confidences are multiples of 1/128, so that sums and ties do not depend on the order of adding;
# their means have at most ten digits or no tie in the tenth.


def predictions(spark, sf):
    """Events as predictions: the user is the slot."""
    events = table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("slot"), "ts", F.col("event_id").alias("seq"),
        pick(_LABELS, F.col("event_id") % 4).alias("label"),
        F.concat(F.lit("c"), F.col("event_id") % 4).alias("class_id"),
        (F.floor(F.col("value")) / 128.0).alias("confidence"))


_SMOOTHED = f"""
    (WITH p AS (SELECT user_id AS slot, ts, event_id AS seq, ({sql_list(_LABELS)})[event_id % 4 + 1] AS label,
        floor(value) / 128.0::DOUBLE AS confidence FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY ts, seq) AS i FROM p),
    h AS (SELECT a.seq, b.label, count(*) AS k, avg(b.confidence) AS m FROM n a JOIN n b
      ON a.slot = b.slot AND b.i BETWEEN a.i - 7 AND a.i GROUP BY ALL)
    SELECT seq, label AS smoothed_label, 'c' || (list_position({sql_list(_LABELS)}, label) - 1)
        AS smoothed_class_id, round(m, 10) AS smoothed_confidence FROM h
    QUALIFY row_number() OVER (PARTITION BY seq ORDER BY k DESC, m DESC, label) = 1)"""


def _voted(df):
    return df.select("seq", "smoothed_label", "smoothed_class_id",
                     F.round("smoothed_confidence", 10).alias("smoothed_confidence"))


@query("smooth_predictions", f"SELECT * FROM {_SMOOTHED}")
def _(spark, sf):
    return _voted(live.smooth_predictions(predictions(spark, sf)))


@query("smooth_predictions_blocked", f"SELECT * FROM {_SMOOTHED}")
def _(spark, sf):
    # Tiny blocks: most histories cross a block border.
    return _voted(live.smooth_predictions(predictions(spark, sf), block_rows=16))


_BATCHES, _FILES_EACH = 4, 4


def _in_batches(df, by, folder):
    """``df`` as a stream of four micro-batches that follow the order of ``by`` (a number)."""
    cuts = df.select(by.alias("v")).approxQuantile("v", [0.25, 0.5, 0.75], 0.01)
    part = F.lit(0)
    for cut in cuts:
        part = part + (by > cut).cast("int")
    for i in range(_BATCHES):
        # As many files for every batch, one batch after the other: a stream reads them in this order.
        df.where(part == i).repartition(_FILES_EACH).write.parquet(f"{folder}/in/{i}")
    return streams.read_stream(df.sparkSession, f"{folder}/in", df, files_per_batch=_FILES_EACH)


def _all_batches(query):
    """The finished query, which must have read four batches or more."""
    query.awaitTermination()
    batches = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    if len(batches) < _BATCHES:
        raise AssertionError(f"{len(batches)} micro-batches")


@query("smooth_predictions_stream", f"SELECT * FROM {_SMOOTHED}")
def _(spark, sf):
    folder = _scratch(spark, "smooth")
    raw = _in_batches(table(spark, sf, "events"), F.unix_micros(F.col("ts").cast("timestamp")), folder)
    rows = raw.select(
        F.col("user_id").alias("slot"), "ts", F.col("event_id").alias("seq"),
        pick(_LABELS, F.col("event_id") % 4).alias("label"),
        F.concat(F.lit("c"), F.col("event_id") % 4).alias("class_id"),
        (F.floor(F.col("value")) / 128.0).alias("confidence"))
    _all_batches(streams.smooth_stream(rows, folder))
    return _voted(streams.smoothed_rows(spark, folder))


_KINDS = ("car", "truck", "bird", "bus", "motorcycle")


@query("most_prominent_detection", f"""
    SELECT frame_id, detection_id, label, round(score, 6) + 0.0::DOUBLE AS score FROM (
      SELECT event_id // 5 AS frame_id, event_id AS detection_id, ({sql_list(_KINDS)})[event_id % 5 + 1] AS label,
        (user_id % 10 + 1) * (event_id % 7 + 1) * (value / 100) AS score, value / 100 AS confidence FROM events)
    WHERE label <> 'bird' AND confidence >= 0.15
    QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, detection_id) = 1""")
def _(spark, sf):
    shown = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 5).alias("frame_id"), F.col("event_id").alias("detection_id"),
        pick(_KINDS, F.col("event_id") % 5).alias("label"), (F.col("value") / 100).alias("confidence"),
        (F.col("user_id") % 10 + 1).cast("double").alias("width"),
        (F.col("event_id") % 7 + 1).cast("double").alias("height"))
    return live.most_prominent(shown).select("frame_id", "detection_id", "label", r6("score").alias("score"))


# ---- queue history ------------------------------------------------------------

_ACTIONS = {"signup": "requeue", "view": "enqueue", "purchase": "done", "error": "failed", "click": "dead"}


def queue_events(events):
    action = None
    for name, value in _ACTIONS.items():
        test = F.col("event_type") == name
        action = F.when(test, value) if action is None else action.when(test, value)
    return events.select(
        F.concat(F.lit("http://q/"), "user_id").alias("url"),
        pick(K.QUEUE_SOURCES, F.col("user_id") % 6).alias("source"), F.lit("listing").alias("kind"),
        action.alias("action"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("e"), "event_id")).alias("error"),
        F.date_trunc("second", "ts").alias("ts"), F.col("event_id").alias("seq"))


def start_queue(spark, sf):
    """Every third user's URL is already in the queue."""
    users = table(spark, sf, "events").where("user_id % 3 = 0").select(
        F.concat(F.lit("http://q/"), "user_id").alias("url"),
        pick(K.QUEUE_SOURCES, F.col("user_id") % 6).alias("source"), F.lit("listing").alias("kind")).distinct()
    return crawlqueue.new_items(users, F.lit("2020-01-01 00:00:00").cast("timestamp"))


_FOLDED = """
    (WITH e AS (SELECT 'http://q/' || user_id AS url, user_id, event_id, date_trunc('second', ts) AS ts,
        CASE event_type WHEN 'signup' THEN 'requeue' WHEN 'view' THEN 'enqueue' WHEN 'purchase' THEN 'done'
          WHEN 'error' THEN 'failed' ELSE 'dead' END AS action,
        CASE WHEN event_id % 3 <> 0 THEN 'e' || event_id END AS error FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS i FROM e),
    b AS (SELECT url, any_value(user_id) AS user_id, CASE WHEN any_value(user_id) % 3 = 0 THEN 0
      ELSE min(i) FILTER (action = 'enqueue') END AS birth FROM o GROUP BY url),
    v AS (SELECT o.*, birth FROM o JOIN b USING (url) WHERE i > birth),
    r AS (SELECT url, max(i) FILTER (action = 'requeue') AS reset FROM v GROUP BY url),
    s AS (SELECT v.url, count(*) FILTER (action = 'failed' AND i > coalesce(reset, 0)) AS attempts,
        arg_max(action, i) FILTER (action <> 'enqueue') AS last,
        max(ts) FILTER (action = 'failed' AND i > coalesce(reset, 0)) AS fail_ts,
        max(CASE WHEN i = reset THEN ts END) AS reset_ts,
        arg_max(struct_pack(e := CASE WHEN action IN ('failed', 'dead') THEN error END), i) FILTER (action IN
          ('done', 'failed', 'requeue') OR action = 'dead' AND error IS NOT NULL) AS err
      FROM v LEFT JOIN r USING (url) GROUP BY v.url)
    SELECT b.url, coalesce(attempts, 0) AS attempts, CASE last WHEN 'done' THEN 'done' WHEN 'dead' THEN 'dead'
        WHEN 'failed' THEN CASE WHEN attempts >= 5 THEN 'dead' ELSE 'failed' END ELSE 'pending' END AS status,
      s.err.e AS last_error, strftime(CASE WHEN fail_ts IS NOT NULL THEN fail_ts + to_seconds(least(2 ** attempts,
        3600)::INT) WHEN reset_ts IS NOT NULL THEN reset_ts WHEN b.user_id % 3 = 0 THEN TIMESTAMP '2020-01-01'
        ELSE o.ts END, '%Y-%m-%d %H:%M:%S') AS next_try_at
    FROM b LEFT JOIN s USING (url) LEFT JOIN o ON o.url = b.url AND o.i = b.birth WHERE birth IS NOT NULL)"""


def _state(df):
    return df.select("url", big("attempts"), "status", "last_error", stamp("next_try_at").alias("next_try_at"))


@query("queue_fold_events", f"SELECT * FROM {_FOLDED}")
def _(spark, sf):
    return _state(crawlqueue.fold_events(start_queue(spark, sf), queue_events(table(spark, sf, "events"))))


@query("queue_fold_stream", f"SELECT * FROM {_FOLDED}")
def _(spark, sf):
    folder = _scratch(spark, "fold")
    raw = _in_batches(table(spark, sf, "events"), F.unix_micros(F.col("ts").cast("timestamp")), folder)
    _all_batches(streams.queue_stream(queue_events(raw), folder, start_queue(spark, sf)))
    return _state(streams.latest_state(spark, folder))


@query("ingest_dedupe_stream", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(spark, sf):
    folder = _scratch(spark, "ingest")
    raw = _in_batches(table(spark, sf, "documents"), F.col("doc_id"), folder)
    rows = raw.select(F.sha2("text", 256).alias("digest"), "doc_id")
    _all_batches(streams.ingest_stream(rows, folder, "digest", ["doc_id"]))
    return spark.read.parquet(f"{folder}/out").select("digest", "doc_id")


@query("dedupe_within_watermark", "SELECT DISTINCT user_id FROM events")
def _(spark, sf):
    folder = _scratch(spark, "within")
    raw = streams.read_stream(spark, sf, table(spark, sf, "events"), "events.parquet")
    rows = raw.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    kept = streams.dedupe_within(rows, "user_id", "ts", "3650 days").select("user_id")
    kept.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# ---- ingest -------------------------------------------------------------------


def _files(spark, sf, folder, content="text"):
    """Documents as image files; ``folder`` is the class folder."""
    docs = table(spark, sf, "documents")
    top = F.when(F.col("doc_id") % 11 == 0, "__MACOSX/").when(
        F.col("doc_id") % 13 == 0, "VMMRdb/.hidden/").otherwise("VMMRdb/")
    ext = pick((".jpg", ".PNG", ".jpeg", ".txt"), F.col("doc_id") % 4)
    files = docs.select(
        F.concat(top, folder, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), ext).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"), F.encode(content, "UTF-8").alias("content"))
    return labelled_files(files)


_FILES = """(SELECT *, n_chars, sha256(text) AS image_id, doc_id % 5 AS k FROM documents
    WHERE doc_id % 4 <> 3 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0)"""
_EXTS = "(['.jpg', '.png', '.jpeg'])[doc_id % 4 + 1]"


def _known(spark, sf):
    docs = table(spark, sf, "documents").where("source = 'src2'")
    return docs.select(F.sha2("text", 256).alias("image_id")).distinct()


_KNOWN = "image_id IN (SELECT sha256(text) FROM documents WHERE source = 'src2')"


def _underscore(spark, sf):
    folder = _form(_CLASS_FORMS, F.col("doc_id") % 5, F.col("lang"), F.col("source"), F.lit(2005))
    return ingest.ingest_labelled_images(
        ingest.label_underscore(_files(spark, sf, folder)), "vmmrdb", _known(spark, sf), "train", now())


@query("ingest_images", f"""
    SELECT image_id, 'vmmrdb:' || image_id AS listing_id, 'images/' || slug || '/' || image_id || {_EXTS} AS local_path,
      'vmmrdb://' || slug || '/' || image_id AS source_url, strlen(text)::BIGINT AS bytes
    FROM (SELECT *, CASE k WHEN 0 THEN '2005_' ELSE '' END || lang || '_' || source AS slug FROM {_FILES}
      WHERE k < 2 AND NOT ({_KNOWN})) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY
      'VMMRdb/' || CASE k WHEN 0 THEN lang || '_' || source || '_2005' ELSE lang || '_' || source END || '/' ||
      lpad(doc_id::VARCHAR, 9, '0')) = 1""")
def _(spark, sf):
    return _underscore(spark, sf)["images"].select("image_id", "listing_id", "local_path", "source_url", "bytes")


@query("ingest_listings", f"""
    SELECT DISTINCT 'vmmrdb:' || image_id AS listing_id, 1::BIGINT AS n FROM {_FILES}
    WHERE k < 2 AND NOT ({_KNOWN})""")
def _(spark, sf):
    return _underscore(spark, sf)["listings"].groupBy("listing_id").agg(F.count("*").alias("n"))


@query("ingest_audit", f"""
    SELECT outcome, count(*) AS n FROM (SELECT CASE k WHEN 2 THEN 'empty make' WHEN 3 THEN 'no separator'
      WHEN 4 THEN 'empty model' ELSE CASE WHEN {_KNOWN} OR row_number() OVER (PARTITION BY image_id, k < 2
      ORDER BY doc_id) > 1 THEN 'existing' ELSE 'inserted' END END AS outcome FROM {_FILES}) GROUP BY 1""")
def _(spark, sf):
    return _underscore(spark, sf)["audit"]


@query("ingest_spaced_classes", f"""
    SELECT CASE doc_id % 6 WHEN 0 THEN 'SUV' WHEN 1 THEN 'Crew Cab' ELSE 'none' END AS body_style, count(DISTINCT
      image_id) AS n FROM {_FILES} WHERE doc_id % 6 IN (0, 1, 4) GROUP BY 1""")
def _(spark, sf):
    folder = _form(_SPACED_FORMS, F.col("doc_id") % 6, F.col("lang"), F.col("source"), F.lit(2005))
    # A text counts once per form, whatever its languages: at size short texts occur in several.
    files = _files(spark, sf, folder, F.concat("text", F.lit("-"), F.col("doc_id") % 6))
    makes = table(spark, sf, "documents").select(F.col("lang").alias("make_name")).distinct().union(
        table(spark, sf, "region").limit(1).select(F.lit("Am General")))
    done = ingest.ingest_labelled_images(
        ingest.label_spaced(files, makes), "stanford_cars", _known(spark, sf), "train", now())
    styled = done["listings"].select(
        F.coalesce("body_style", F.lit("none")).alias("body_style"), "url", "make")
    return styled.groupBy("body_style").agg(F.count("*").alias("n"))


@query("ingest_id_paths", """
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN y = '5008' THEN 'unusable year'
        WHEN n_nationkey IS NULL THEN 'id out of range' WHEN p_partkey IS NULL THEN 'id out of range'
        WHEN p_partkey % 10 = 5 THEN 'empty name' WHEN row_number() OVER (PARTITION BY text,
          y <> '5008' AND n_nationkey IS NOT NULL AND p_partkey IS NOT NULL AND p_partkey % 10 <> 5
          ORDER BY doc_id) > 1 THEN 'existing' ELSE 'inserted' END AS outcome
      FROM (SELECT *, doc_id % 30 + 1 AS mk, doc_id % 300 + 1 AS md,
          CASE WHEN doc_id % 9 = 0 THEN '5008' ELSE '2012' END AS y FROM documents)
      LEFT JOIN nation ON n_nationkey = mk LEFT JOIN part ON p_partkey = md) GROUP BY 1""")
def _(spark, sf):
    year = F.when(F.col("doc_id") % 9 == 0, "5008").otherwise("2012")
    path = F.concat(F.lit("CompCars/image/"), F.concat_ws(
        "/", F.col("doc_id") % 30 + 1, F.col("doc_id") % 300 + 1, year,
        F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".jpg"))))
    files = table(spark, sf, "documents").select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), path.alias("entry"),
        F.octet_length("text").cast("bigint").alias("length"), F.lit(".jpg").alias("ext"),
        F.encode("text", "UTF-8").alias("content"))
    nation, part = table(spark, sf, "nation"), table(spark, sf, "part")
    makes = nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    models = part.select(F.col("p_partkey").alias("id"), F.when(
        F.col("p_partkey") % 10 != 5, F.col("p_name")).otherwise("").alias("name"))
    types = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).cast("bigint").alias("type_id"))
    styles = table(spark, sf, "region").select(
        F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    labelled = ingest.label_id_path(files, makes, models, types, styles)
    none = table(spark, sf, "documents").where("doc_id < 0").select(F.col("text").alias("image_id"))
    return ingest.ingest_labelled_images(labelled, "compcars", none, "train", now())["audit"]


def _category_files(spark, sf):
    docs, k = table(spark, sf, "documents"), F.col("doc_id") % 7
    year = (1950 + F.col("doc_id") % 60).cast("string")
    return docs.select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("title"),
        F.when(k == 0, F.array(F.lit("Sedans"))).otherwise(F.array(
            F.concat(F.lit("Category:Cars introduced in "), year),
            F.concat(F.lit("Category:Chevrolet "), F.col("source")))).alias("categories"),
        F.when(k != 1, F.concat(F.lit("https://files/"), "doc_id")).alias("url"),
        F.when(k == 2, "image/tiff").otherwise("image/jpeg").alias("mime"),
        F.encode("text", "UTF-8").alias("content"))


_CATEGORY = """(SELECT *, CASE WHEN k = 0 OR y > 1999 THEN 'no label' WHEN k = 1 THEN 'download failure'
    WHEN k = 2 THEN 'unsupported type' END AS reason FROM (SELECT *, doc_id % 7 AS k, 1950 + doc_id % 60 AS y,
    sha256(text) AS image_id FROM documents))"""


@query("ingest_category_listings", f"""
    SELECT 'wikimedia_commons:' || image_id AS listing_id, 'https://files/' || doc_id AS url, 'Chevrolet' AS make,
      source AS model, upper(source[1]) || source[2:] AS canonical_model, y AS year,
      1980 + floor((y - 1980) / 4.0)::BIGINT * 4 AS generation_year FROM {_CATEGORY} WHERE reason IS NULL
      AND NOT ({_KNOWN}) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY doc_id) = 1""")
def _(spark, sf):
    done = ingest.ingest_category_files(
        _category_files(spark, sf), _known(spark, sf), now(), 1900, 1999)["listings"]
    return done.select("listing_id", "url", "make", "model", "canonical_model", big("year"), big("generation_year"))


@query("ingest_category_audit", f"""
    SELECT outcome, count(*) AS n FROM (SELECT coalesce(reason, CASE WHEN {_KNOWN} OR row_number() OVER (PARTITION BY
      image_id, reason IS NULL ORDER BY doc_id) > 1 THEN 'existing' ELSE 'inserted' END) AS outcome FROM {_CATEGORY})
    GROUP BY 1""")
def _(spark, sf):
    return ingest.ingest_category_files(
        _category_files(spark, sf), _known(spark, sf), now(), 1900, 1999)["audit"]


@query("content_clusters", """
    SELECT sha256(text) AS digest, min(doc_id) AS representative, count(*) AS cluster_size FROM documents GROUP BY 1""")
def _(spark, sf):
    return ingest.content_clusters(table(spark, sf, "documents"), "doc_id", "text")


# ---- labels, splits, manifests ------------------------------------------------


@query("canonicalize", over("v_canonical", """
    SELECT listing_id, CASE WHEN listing_id::BIGINT % 4 = 0 THEN 'Kept' ELSE canonical_make END AS canonical_make,
      CASE WHEN listing_id::BIGINT % 4 = 0 THEN 'Old' ELSE canonical_model END AS canonical_model,
      CASE WHEN listing_id::BIGINT % 4 = 0 THEN '1980' ELSE generation_year::VARCHAR END AS generation_year
    FROM v_canonical"""))
def _(spark, sf):
    held = F.col("listing_id").cast("bigint") % 4 == 0
    rows = listings(spark, sf).withColumns({
        "canonical_make": F.when(held, "Kept"), "canonical_model": F.when(held, "Old"),
        "generation_year": F.when(held, 1980)})
    return labelling.canonicalize(rows).select(
        "listing_id", "canonical_make", "canonical_model",
        F.col("generation_year").cast("string").alias("generation_year"))


@query("make_splits_images", over("v_canonical v_images", _COHERENT + """
    SELECT v_images.image_id, CASE WHEN v_images.split = 'val' THEN coalesce(a.split, 'none') ELSE v_images.split END
      AS split FROM v_images LEFT JOIN assigned a USING (image_id)"""))
def _(spark, sf):
    img = images(spark, sf).withColumn("split", F.nullif("split", F.lit("val")))
    done = labelling.make_splits(img, canonical(spark, sf), "ECONOMY")["images"]
    return done.select("image_id", F.coalesce("split", F.lit("none")).alias("split"))


@query("make_splits_report", over("v_canonical v_images", _SUMMARY + f"""
    UNION ALL SELECT 'excluded', NULL, NULL, count(*) FROM v_images JOIN v_canonical USING (listing_id)
      WHERE source = 'ECONOMY' AND NOT coalesce(view IN {_EXT}, false)"""))
def _(spark, sf):
    return labelling.make_splits(images(spark, sf), canonical(spark, sf), "ECONOMY")["report"]


@query("gate_manifest", over("v_images", f"""
    , c AS (SELECT r AS class_idx, count(image_id) AS n FROM range(6) t(r) LEFT JOIN v_images ON
      CASE WHEN view = 'interior' THEN 5 ELSE list_position({sql_list(K.EXTERIOR_VIEWS)}, view) - 1 END = r
      AND split = 'train' AND view_score >= 0.6 AND local_path <> '' GROUP BY r)
    SELECT class_idx, n, round(CASE WHEN n > 0 THEN 1 / sqrt(n) ELSE 0 END * 6 / sum(CASE WHEN n > 0 THEN 1 / sqrt(n)
      ELSE 0 END) OVER (), 6)::DOUBLE AS weight FROM c"""))
def _(spark, sf):
    done = retrieval.gate_manifest(images(spark, sf), "train", 0.6)["weights"]
    return done.select(big("class_idx"), "n", r6("weight").alias("weight"))


@query("train_prototypes", over("v_canonical v_images", """
    , q AS (SELECT generation_year || '|' || lower(canonical_make) || '|' || lower(canonical_model) AS class_id,
      embedding::DOUBLE[] AS e
    FROM v_images JOIN v_canonical USING (listing_id) JOIN embeddings ON vec_id = listing_id::BIGINT
    WHERE source = 'PROMO' AND split = 'train' AND local_path <> '' AND generation_year IS NOT NULL),
    m AS (SELECT class_id, list(a ORDER BY pos) AS mean, max(n) AS n FROM (
      SELECT class_id, pos, avg(e[pos]) AS a, count(*) AS n FROM q, range(1, 65) t(pos) GROUP BY ALL) GROUP BY class_id),
    tp AS (SELECT class_id, n, list_transform(mean, lambda x: x / sqrt(list_inner_product(mean, mean))) AS p FROM m)
    """ + _long_sql("tp", "class_id, n")))
def _(spark, sf):
    img = images(spark, sf)
    vecs = img.select("image_id", F.col("listing_id").cast("bigint").alias("vec_id")).join(
        table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").select(
        "image_id", "embedding").dropDuplicates(["image_id"])
    return _long(retrieval.train_prototypes(img, canonical(spark, sf), vecs, "PROMO"), "class_id", "n")


@query("evaluate_images", over("v_canonical v_images", """
    SELECT coalesce(view, 'unknown') AS key, count(*) AS n FROM v_images JOIN v_canonical USING (listing_id)
    JOIN embeddings ON vec_id = listing_id::BIGINT WHERE source = 'PROMO' AND split = 'test' AND local_path <> ''
      AND generation_year IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    img = images(spark, sf)
    vecs = img.select("image_id", F.col("listing_id").cast("bigint").alias("vec_id")).join(
        table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").select(
        "image_id", "embedding").dropDuplicates(["image_id"])
    args = (img, canonical(spark, sf), vecs, "PROMO")
    done = retrieval.evaluate(retrieval.test_queries(*args), retrieval.train_prototypes(*args))
    return done["breakdown"].where("facet = 'view'").select("key", "n")


# ---- scans and sinks ----------------------------------------------------------


@query("table_round_trip", over("v_images", """
    SELECT split, count(*) AS n, count(view) AS labelled FROM v_images GROUP BY split"""))
def _(spark, sf):
    folder = _scratch(spark, "tables")
    tables.write_table(images(spark, sf), f"{folder}/images")
    return tables.read_table(spark, folder, "images").groupBy("split").agg(
        F.count("*").alias("n"), F.count("view").alias("labelled"))


@query("tables_round_trip", over("v_listings v_queue", """
    SELECT 'listings' AS name, source AS key, count(*) AS n FROM v_listings GROUP BY source
    UNION ALL SELECT 'crawl_queue', status, count(*) FROM v_queue GROUP BY status"""))
def _(spark, sf):
    folder = _scratch(spark, "tables")
    for name, rows in (("listings", listings(spark, sf)), ("crawl_queue", queue(spark, sf))):
        tables.write_table(rows, f"{folder}/{name}")
    read = {n: tables.read_table(spark, folder, n) for n in ("listings", "crawl_queue")}
    return read["listings"].groupBy(F.lit("listings").alias("name"), F.col("source").alias("key")).agg(
        F.count("*").alias("n")).unionByName(
        read["crawl_queue"].groupBy(F.lit("crawl_queue").alias("name"), F.col("status").alias("key")).agg(
            F.count("*").alias("n")))


# Texts as image files: one folder per source, some entries hidden or of another kind.
@query("scan_image_tree", """
    SELECT source AS class_dir, '.jpg' AS ext, count(*) AS n, sum(strlen(text))::BIGINT AS length,
      count(DISTINCT sha256(text)) AS contents FROM documents WHERE doc_id % 4 < 2 GROUP BY source""")
def _(spark, sf):
    k = F.col("doc_id") % 4
    name = F.concat(F.when(k == 3, ".").otherwise(""), F.col("doc_id"),
                    F.when(k == 2, ".txt").otherwise(F.when(k == 1, ".JPG").otherwise(".jpg")))
    folder = _scratch(spark, "tree")
    write_files(table(spark, sf, "documents").select(
        F.concat_ws("/", F.lit("set"), "source", name).alias("path"),
        F.col("text").cast("binary").alias("content")), folder)
    return scan_image_tree(spark, folder).groupBy("class_dir", "ext").agg(
        F.count("*").alias("n"), F.sum("length").alias("length"),
        F.count_distinct(F.sha2("content", 256)).alias("contents"))


# One sitemap file per supplier; every third is cut off and gives nothing.
@query("scan_sitemap_xml", """
    SELECT 's' || s_suppkey || '.xml' AS document, 'urlset' AS root, i AS position,
      'http://p/' || s_suppkey || '?a=1&b=' || i AS loc
    FROM supplier, range(3) t(i) WHERE s_suppkey % 3 <> 2""")
def _(spark, sf):
    key = F.col("s_suppkey").cast("string")
    urls = [F.concat(F.lit("<url><loc>http://p/"), key, F.lit(f"?a=1&amp;b={i}</loc></url>")) for i in range(3)]
    body = F.concat(F.lit('<?xml version="1.0"?><urlset>'), *urls,
                    F.when(F.col("s_suppkey") % 3 == 2, "").otherwise("</urlset>"))
    folder = _scratch(spark, "sitemaps")
    write_files(table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), key, F.lit(".xml")).alias("path"), body.cast("binary").alias("content")), folder)
    return scan_sitemap_xml(spark, folder).select(
        F.regexp_extract("document", "([^/]+)$", 1).alias("document"), "root", big("position"), "loc")


@query("read_pages", "SELECT page_id, url, length(html) AS n, 'none' AS source FROM pages")
def _(spark, sf):
    return tables.read_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("bigint").alias("n"), F.coalesce("source", F.lit("none")).alias("source"))


@query("prototypes_sink", over("v_view_protos", "SELECT class_id, view, n FROM v_view_protos"))
def _(spark, sf):
    path = _scratch(spark, "prototypes")
    tables.write_prototypes(view_protos(spark, sf), path)
    return spark.read.parquet(path).select("class_id", "view", "n")


@query("report_sink", over("v_protos", """
    SELECT class_id, '2012-2015 Make' || class_id[10:10] || ' Model' || class_id[-1:] AS display_name FROM v_protos"""))
def _(spark, sf):
    path = _scratch(spark, "report")
    tables.write_report(protos(spark, sf).select("class_id", "display_name"), path)
    return spark.read.json(path).select("class_id", "display_name")


@query("catalog_round_trip", over("v_canonical", """
    SELECT DISTINCT CASE canonical_make WHEN 'BMW' THEN 'Bmw' ELSE canonical_make END AS make_name,
      canonical_model AS model_name, year::BIGINT AS year FROM v_canonical WHERE year IS NOT NULL"""))
def _(spark, sf):
    path = _scratch(spark, "catalog")
    doc = catalog.build_catalog(_catalog_rows(spark, sf), "parts", "2026-01-01", (1990, 2030))
    catalog_source.write_catalog(doc, path)
    return catalog_source.read_catalog(spark, path, lines=True).select("make_name", "model_name", big("year"))


@query("model_responses", """
    SELECT c_custkey AS make_id, c_custkey % 10 AS model_id, 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') AS
      make_name, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS model_name FROM customer WHERE c_custkey % 5 <> 4""")
def _(spark, sf):
    cust = table(spark, sf, "customer")

    def row(name):
        return F.struct(
            F.lit(None).cast("bigint").alias("Make_ID"), F.col("c_name").alias("Make_Name"),
            F.when(F.col("c_custkey") % 5 != 4, F.col("c_custkey") % 10).alias("Model_ID"), name.alias("Model_Name"))

    payloads = cust.select(
        F.col("c_custkey").alias("request_make_id"), F.lit(2010).alias("year"),
        F.array(row(F.lit("")), row(F.col("c_mktsegment")), row(F.lit("later"))).alias("Results"))
    return catalog_source.first_models(payloads).select("make_id", "model_id", "make_name", "model_name")


@query("make_responses", """
    SELECT c_nationkey::BIGINT AS make_id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS make_name FROM customer
    WHERE c_mktsegment <> 'MACHINERY' QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) = 1""")
def _(spark, sf):
    payloads = table(spark, sf, "customer").select(F.array(F.struct(
        F.col("c_nationkey").cast("bigint").alias("MakeId"), F.nullif("c_mktsegment", F.lit("MACHINERY"))
        .alias("MakeName"))).alias("Results"))
    return catalog_source.first_makes(payloads)
