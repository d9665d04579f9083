"""Selections, look-ups, aggregates, sets and queue transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    HASH_SPLIT_SQL, NOW, big, canonical, images, listings, now, over, pick, query, queue, r6,
    sql_list, stamp, table,
)
from motorgrid import constants as K
from motorgrid.operators import crawlqueue, filters, lookups, splits, summaries, training
from motorgrid.plans.batches import cap_per_group
from motorgrid.sources.tables import union_sources

_SRC = "'ECONOMY', 'PROMO'"
_EXT = "(" + ", ".join(f"'{v}'" for v in K.EXTERIOR_VIEWS) + ")"


@query("list_by_class", over("v_listings", """
    SELECT listing_id, source, year::BIGINT AS year, model FROM v_listings
    WHERE source = 'PROMO' AND year = 2012
    ORDER BY scraped_at DESC, listing_id LIMIT 50"""))
def _(spark, sf):
    found = filters.list_by_class(
        listings(spark, sf), year=2012, source="PROMO", limit=50)
    return found.select("listing_id", "source", big("year"), "model")


@query("get_by_key", over("v_images", """
    SELECT image_id, listing_id, view FROM v_images
    WHERE listing_id = (SELECT min(listing_id) FROM v_images)"""))
def _(spark, sf):
    img = images(spark, sf)
    key = img.agg(F.min("listing_id")).first()[0]
    return filters.get_by_key(img, "listing_id", key).select("image_id", "listing_id", "view")


@query("images_for_listing", over("v_images", """
    SELECT image_id, listing_id FROM v_images WHERE listing_id = '7'"""))
def _(spark, sf):
    return filters.images_for_listing(images(spark, sf), "7").select("image_id", "listing_id")


@query("multi_source_filter", over("v_listings", f"""
    SELECT source, count(*) AS n FROM v_listings WHERE source IN ({_SRC}) GROUP BY source"""))
def _(spark, sf):
    return filters.from_sources(listings(spark, sf), " ECONOMY, PROMO,").groupBy("source").agg(
        F.count("*").alias("n"))


_LABELLED = f"""
    SELECT image_id, generation_year || '|' || lower(canonical_make) || '|' ||
      lower(canonical_model) AS class_id, view, local_path
    FROM v_images JOIN v_canonical USING (listing_id)
    WHERE source IN ({_SRC}) AND split = 'test' AND local_path <> '' AND generation_year IS NOT NULL
"""


@query("select_labelled_rows", over("v_canonical v_images", _LABELLED))
def _(spark, sf):
    return filters.select_labelled_rows(
        images(spark, sf), canonical(spark, sf), ["ECONOMY", "PROMO"], "test")


@query("select_unlabelled", over("v_listings v_images", """
    SELECT image_id, listing_id FROM v_images JOIN v_listings USING (listing_id)
    WHERE view IS NULL AND source = 'SMALL'"""))
def _(spark, sf):
    return filters.select_unlabelled(
        images(spark, sf), listings(spark, sf), source="SMALL").select("image_id", "listing_id")


@query("select_uncanonical", over("v_canonical", """
    SELECT listing_id, source FROM v_canonical WHERE canonical_make IS NULL
      OR generation_year IS NULL"""))
def _(spark, sf):
    return filters.select_uncanonical(canonical(spark, sf)).select("listing_id", "source")


@query("sample_paths", over("v_listings v_images", """
    SELECT * FROM (SELECT image_id, local_path FROM v_images JOIN v_listings USING (listing_id)
      WHERE source = 'LARGE' AND split = 'test' ORDER BY image_id LIMIT 40)
    WHERE local_path <> ''"""))
def _(spark, sf):
    return filters.sample_paths(images(spark, sf), listings(spark, sf), "LARGE", "test", 40)


@query("update_listings", over("v_listings", """
    SELECT listing_id, trim, (CASE WHEN o_custkey IS NOT NULL THEN o_custkey ELSE mileage END)
      ::BIGINT AS mileage FROM v_listings LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders
      WHERE o_orderkey % 3 = 0) ON o_orderkey = listing_id::BIGINT"""))
def _(spark, sf):
    patch = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").cast("string").alias("listing_id"),
        F.col("o_custkey").cast("int").alias("mileage"))
    return filters.update_listings(listings(spark, sf), patch).select(
        "listing_id", "trim", big("mileage"))


@query("eligible_for_split", over("v_canonical v_images", f"""
    SELECT coalesce(view IN {_EXT}, false) AS eligible, count(*) AS n
    FROM v_images JOIN v_canonical USING (listing_id) WHERE source = 'STANDARD' GROUP BY 1"""))
def _(spark, sf):
    return filters.eligible_for_split(
        images(spark, sf), canonical(spark, sf), "STANDARD").groupBy("eligible").agg(
        F.count("*").alias("n"))


@query("domain_violations", over("v_queue", """
    SELECT url, 'source' AS violations FROM v_queue WHERE source NOT IN ('bat', 'hemmings')"""))
def _(spark, sf):
    domains = {"source": ("bat", "hemmings"), "kind": K.QUEUE_KINDS, "status": K.QUEUE_STATUSES}
    return filters.domain_violations(queue(spark, sf), domains).select(
        "url", F.array_join("violations", ",").alias("violations"))


@query("duplicate_keys", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return filters.duplicate_keys(
        table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").select(
        "l_orderkey", big("l_linenumber"), "n")


@query("orphan_images", """
    SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (
      SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def _(spark, sf):
    parents = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return filters.orphans(
        table(spark, sf, "lineitem"), parents, "l_orderkey", "o_orderkey").agg(
        F.count("*").alias("n"))


@query("resolution_filter", over("v_images", """
    SELECT image_id FROM v_images WHERE least(width, height) >= 400
      AND greatest(width, height) <= least(width, height) * 1.5"""))
def _(spark, sf):
    return filters.resolution_filter(images(spark, sf), 400, 1.5).select("image_id")


@query("images_join_listings", over("v_listings v_images", """
    SELECT source, count(*) AS n, sum(width)::BIGINT AS width
    FROM v_images JOIN v_listings USING (listing_id) GROUP BY source"""))
def _(spark, sf):
    return filters.join_listings(images(spark, sf), listings(spark, sf)).groupBy("source").agg(
        F.count("*").alias("n"), F.sum("width").alias("width"))


@query("resolve_names", """
    SELECT coalesce(reason, 'resolved') AS outcome, count(*) AS n, count(DISTINCT p_name) AS names
    FROM (SELECT CASE WHEN p_partkey IS NULL OR l_partkey <= 0 THEN 'id out of range'
      WHEN p_partkey % 10 = 5 THEN 'empty name' END AS reason,
      CASE WHEN l_partkey > 0 AND p_partkey % 10 <> 5 THEN p_name END AS p_name
      FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0)
      ON p_partkey = l_partkey) GROUP BY 1""")
def _(spark, sf):
    names = table(spark, sf, "part").where("p_partkey % 7 <> 0").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 10 != 5, F.col("p_name")).otherwise(" ").alias("name"))
    done = lookups.resolve_names(table(spark, sf, "lineitem"), names, "l_partkey", "p_name")
    return done.groupBy(F.coalesce("p_name_reason", F.lit("resolved")).alias("outcome")).agg(
        F.count("*").alias("n"), F.countDistinct("p_name").alias("names"))


@query("resolve_two_hop", """
    SELECT s_suppkey, r_name AS region FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey AND n_regionkey > 0""")
def _(spark, sf):
    hop = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("type_id"))
    names = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return lookups.resolve_two_hop(
        table(spark, sf, "supplier"), hop, names, "s_nationkey", "region").select(
        "s_suppkey", "region")


@query("decode_class_index", """
    SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'direct' ELSE r_name END AS class_name
    FROM embeddings LEFT JOIN region ON r_regionkey = label""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn(
        "text", F.when(F.col("vec_id") % 4 == 0, " direct ").otherwise(" "))
    names = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return lookups.decode_class_index(rows, names, "text", "label", "class_name").select(
        "vec_id", "class_name")


@query("insert_new", """
    SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents
    WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src3')
    GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    held = docs.where("source = 'src3'").dropDuplicates(["digest"])
    return lookups.insert_new(held, docs.drop("source"), "digest", ["doc_id"])


_KEEP = """
    SELECT image_id, coalesce({}) AS split FROM (
      SELECT image_id, CASE WHEN split = 'val' THEN NULL ELSE split END AS old,
        CASE WHEN view = 'front' THEN 'new' END AS new FROM v_images)"""


def _kept(spark, sf, rebuild):
    img = images(spark, sf).withColumn("split", F.nullif("split", F.lit("val")))
    values = img.where("view = 'front'").select("image_id", F.lit("new").alias("split"))
    return lookups.keep_existing(img, values, "image_id", "split", rebuild).select(
        "image_id", "split")


@query("keep_existing", over("v_images", _KEEP.format("old, new")))
def _(spark, sf):
    return _kept(spark, sf, False)


@query("keep_existing_rebuild", over("v_images", _KEEP.format("new, old")))
def _(spark, sf):
    return _kept(spark, sf, True)


@query("attach_context", """
    SELECT vec_id, coalesce(p_brand, 'unknown') AS make, coalesce(p_type, 'unknown') AS view
    FROM embeddings LEFT JOIN (SELECT * FROM part WHERE p_size % 3 = 0) ON p_partkey = vec_id""")
def _(spark, sf):
    context = table(spark, sf, "part").where("p_size % 3 = 0").select(
        F.col("p_partkey").alias("vec_id"), F.col("p_brand").alias("make"),
        F.col("p_type").alias("view"))
    return lookups.attach_context(
        table(spark, sf, "embeddings").select("vec_id"), context, "vec_id", ["make", "view"])


@query("queue_status_counts", over("v_queue", """
    SELECT source, count(*) FILTER (status = 'pending') AS pending,
      count(*) FILTER (status = 'in_progress') AS in_progress,
      count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'dead') AS dead FROM v_queue GROUP BY source"""))
def _(spark, sf):
    return summaries.status_counts(queue(spark, sf), by=("source",))


@query("class_train_counts", over("v_canonical v_images", """
    SELECT generation_year || '|' || lower(canonical_make) || '|' || lower(canonical_model)
      AS class_id, count(*) AS n_train
    FROM v_images JOIN v_canonical USING (listing_id)
    WHERE split = 'train' AND generation_year IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return summaries.class_train_counts(images(spark, sf), canonical(spark, sf))


@query("split_image_count", over("v_listings v_images", """
    SELECT count(*) AS n FROM v_images JOIN v_listings USING (listing_id)
    WHERE source = 'MEDIUM' AND split = 'train'"""))
def _(spark, sf):
    return summaries.split_count(images(spark, sf), listings(spark, sf), "MEDIUM", "train")


@query("make_distribution", over("v_canonical", """
    SELECT canonical_make, count(*) AS n FROM v_canonical GROUP BY 1"""))
def _(spark, sf):
    return summaries.make_distribution(canonical(spark, sf))


@query("make_coverage", over("v_canonical", """
    SELECT count(*) AS n_rows, count(DISTINCT canonical_make) AS n_makes,
      count(*) FILTER (canonical_make IS NULL) AS n_null FROM v_canonical"""))
def _(spark, sf):
    return summaries.make_coverage(canonical(spark, sf))


@query("view_distribution", over("v_images", """
    SELECT view, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE
      AS percent FROM v_images GROUP BY view"""))
def _(spark, sf):
    return summaries.view_distribution(images(spark, sf)).withColumn("percent", r6("percent"))


@query("small_cells", over("v_canonical v_images", f"""
    SELECT canonical_make, canonical_model, generation_year::VARCHAR AS generation_year, view,
      count(*) AS n, count(*) < 10 AS small_cell
    FROM v_images JOIN v_canonical USING (listing_id)
    WHERE view IN {_EXT} GROUP BY ALL"""))
def _(spark, sf):
    rows = filters.join_listings(images(spark, sf), canonical(spark, sf)).where(
        filters.is_split_eligible())
    return splits.cell_sizes(rows).withColumn(
        "generation_year", F.col("generation_year").cast("string"))


_CELL_SQL = "canonical_make, canonical_model, generation_year, view"
_ELIGIBLE = f"""
    elig AS (SELECT image_id, listing_id, {_CELL_SQL} FROM v_images
      JOIN v_canonical USING (listing_id) WHERE source = 'ECONOMY' AND view IN {_EXT})"""
_COHERENT = f"""
    , {_ELIGIBLE},
    l AS (SELECT {_CELL_SQL}, listing_id, count(*) AS n, sha1('42|' || listing_id) AS h
      FROM elig GROUP BY ALL),
    c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {_CELL_SQL} ORDER BY h, listing_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
      sum(n) OVER (PARTITION BY {_CELL_SQL}) AS total FROM l),
    t AS (SELECT *, min(CASE WHEN c >= round_even(total * 0.8, 0) THEN c END)
      OVER (PARTITION BY {_CELL_SQL}) AS t FROM c),
    s AS (SELECT *, CASE WHEN total < 10 OR c < round_even(total * 0.8, 0) THEN 'train'
      WHEN c - t < round_even(total * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM t),
    assigned AS (SELECT image_id, elig.{_CELL_SQL.replace(', ', ', elig.')}, split, total < 10 AS small_cell
      FROM elig JOIN s ON elig.listing_id = s.listing_id AND elig.canonical_make = s.canonical_make
      AND elig.canonical_model = s.canonical_model AND elig.view = s.view
      AND elig.generation_year IS NOT DISTINCT FROM s.generation_year)"""


def _economy(spark, sf):
    return filters.eligible_for_split(
        images(spark, sf), canonical(spark, sf), "ECONOMY").where("eligible")


@query("split_by_listing", over("v_canonical v_images", _COHERENT + """
    SELECT image_id, split, small_cell FROM assigned"""))
def _(spark, sf):
    return splits.assign_by_listing(_economy(spark, sf)).select("image_id", "split", "small_cell")


@query("split_by_image", over("v_canonical v_images", f"""
    , {_ELIGIBLE},
    r AS (SELECT image_id, row_number() OVER (PARTITION BY {_CELL_SQL}
        ORDER BY sha1('42|' || image_id), image_id) - 1 AS i,
      count(*) OVER (PARTITION BY {_CELL_SQL}) AS total FROM elig)
    SELECT image_id, CASE WHEN total < 10 OR i < round_even(total * 0.8, 0) THEN 'train'
      WHEN i < round_even(total * 0.8, 0) + round_even(total * 0.1, 0) THEN 'val' ELSE 'test' END
      AS split FROM r"""))
def _(spark, sf):
    return splits.assign_by_image(_economy(spark, sf)).select("image_id", "split")


@query("split_by_hash", f"""
    SELECT doc_id, {HASH_SPLIT_SQL.format('doc_id::VARCHAR')} AS split FROM documents""")
def _(spark, sf):
    return splits.split_by_hash(table(spark, sf, "documents").select("doc_id"), "doc_id")


_SUMMARY = _COHERENT + f"""
    , grid AS (SELECT v.view, s.split, count(a.image_id) AS n
      FROM (SELECT unnest({sql_list(K.EXTERIOR_VIEWS)}) AS view) v
      CROSS JOIN (SELECT unnest({sql_list(K.SPLITS)}) AS split) s
      LEFT JOIN assigned a ON a.view = v.view AND a.split = s.split GROUP BY ALL)
    SELECT 'view_split' AS metric, view, split, n FROM grid
    UNION ALL SELECT 'eligible', NULL, NULL, count(*) FROM assigned
    UNION ALL SELECT s.split, NULL, NULL, count(a.image_id) FROM (SELECT unnest({sql_list(K.SPLITS)})
      AS split) s LEFT JOIN assigned a USING (split) GROUP BY ALL
    UNION ALL SELECT 'small_group', NULL, NULL, count(*) FROM assigned WHERE small_cell
    UNION ALL SELECT 'class_p10', NULL, NULL, quantile_disc(n, 0.1) FROM (SELECT count(*) AS n
      FROM assigned GROUP BY canonical_make, canonical_model, generation_year)"""


@query("split_summary", over("v_canonical v_images", _SUMMARY))
def _(spark, sf):
    return splits.split_summary(splits.assign_by_listing(_economy(spark, sf)))


@query("class_coverage_p10", over("v_canonical v_images", f"""
    SELECT quantile_disc(n, 0.1)::BIGINT AS p10 FROM (SELECT count(*) AS n FROM v_images
      JOIN v_canonical USING (listing_id) GROUP BY canonical_make, canonical_model,
      generation_year)"""))
def _(spark, sf):
    return splits.class_coverage(filters.join_listings(images(spark, sf), canonical(spark, sf)))


@query("confusion_matrix", """
    SELECT quality AS true_idx, count(*) FILTER (toxic = 0) AS pred_0,
      count(*) FILTER (toxic = 1) AS pred_1 FROM labels GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "labels").withColumnRenamed("quality", "true_idx")
    return summaries.confusion_matrix(rows, "true_idx", "toxic", [0, 1])


@query("head_accuracy", """
    SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS n_correct,
      round(count(*) FILTER (quality = toxic) / count(*), 6)::DOUBLE AS accuracy FROM labels""")
def _(spark, sf):
    return summaries.accuracy(table(spark, sf, "labels"), "quality", "toxic").withColumn(
        "accuracy", r6("accuracy"))


_COUNTS = """SELECT r AS class_idx, count(vec_id) AS n FROM range(0, 12) t(r)
      LEFT JOIN embeddings ON label = r GROUP BY r"""


@query("count_by_class", f"SELECT class_idx, n FROM ({_COUNTS})")
def _(spark, sf):
    return summaries.count_by_class(table(spark, sf, "embeddings"), "label", 12).select(
        big("class_idx"), "n")


@query("inverse_sqrt_weights", f"""
    SELECT class_idx, n, round(w * count(*) OVER () / sum(w) OVER (), 6)::DOUBLE AS weight
    FROM (SELECT *, CASE WHEN n > 0 THEN 1 / sqrt(n) ELSE 0 END AS w FROM ({_COUNTS}))""")
def _(spark, sf):
    counts = summaries.count_by_class(table(spark, sf, "embeddings"), "label", 12)
    return summaries.inverse_sqrt_weights(counts).select(
        big("class_idx"), "n", r6("weight").alias("weight"))


@query("reason_audit", """
    SELECT CASE WHEN n_chars < 500 THEN 'parse failure' WHEN lang = 'de' THEN 'no year'
      ELSE 'inserted' END AS outcome, count(*) AS n FROM documents GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "documents").withColumn(
        "reason", F.when(F.col("n_chars") < 500, "parse failure").when(
            F.col("lang") == "de", "no year"))
    return summaries.reason_audit(rows)


@query("seed_stats", over("v_queue", """
    , seeds AS (SELECT 'http://q/' || l_orderkey AS url,
        (['a', 'b', 'c'])[l_suppkey % 3 + 1] AS source FROM lineitem),
    firsts AS (SELECT url, min(source) AS source FROM seeds GROUP BY url),
    s AS (SELECT seeds.source, count(*) AS yielded FROM seeds GROUP BY 1),
    i AS (SELECT source, count(*) AS inserted FROM firsts
      WHERE url NOT IN (SELECT url FROM v_queue WHERE status <> 'dead') GROUP BY 1)
    SELECT source, yielded, coalesce(inserted, 0) AS inserted,
      yielded - coalesce(inserted, 0) AS duplicates FROM s LEFT JOIN i USING (source)
    UNION ALL SELECT NULL, (SELECT sum(yielded)::BIGINT FROM s), (SELECT sum(inserted)::BIGINT FROM i),
      (SELECT sum(yielded)::BIGINT FROM s) - (SELECT sum(inserted)::BIGINT FROM i)"""))
def _(spark, sf):
    seeds = table(spark, sf, "lineitem").select(
        F.concat(F.lit("http://q/"), "l_orderkey").alias("url"),
        pick("abc", F.col("l_suppkey") % 3).alias("source"))
    return crawlqueue.seed_stats(queue(spark, sf).where("status <> 'dead'"), seeds)


@query("source_report", over("v_queue v_listings", """
    , q AS (SELECT *, row_number() OVER (PARTITION BY source, status IN ('failed', 'dead')
        ORDER BY enqueued_at, url) AS rn FROM v_queue)
    SELECT source, count(*) FILTER (kind = 'listing') AS listing_urls,
      count(*) FILTER (kind = 'listing' AND status = 'done') AS listing_done,
      count(*) FILTER (kind = 'image') AS image_urls,
      count(*) FILTER (kind = 'search' AND status = 'done') AS search_done,
      count(*) FILTER (kind = 'search' AND last_error IS NOT NULL) AS search_errors,
      any_value(n) AS listing_rows,
      string_agg(url, ',' ORDER BY rn) FILTER (status IN ('failed', 'dead') AND rn <= 3)
        AS failed_examples
    FROM q LEFT JOIN (SELECT (['bat', 'craigslist', 'cars_com', 'hemmings', 'autotrader',
        'carsandbids'])[listing_id::BIGINT % 6 + 1] AS source, count(*) AS n FROM v_listings
      GROUP BY 1) USING (source) GROUP BY source"""))
def _(spark, sf):
    rows = listings(spark, sf).withColumn("source", pick(
        K.SOURCE_MAX_ITEMS, F.col("listing_id").cast("bigint") % 6))
    return crawlqueue.source_report(queue(spark, sf), rows).select(
        "source", "listing_urls", "listing_done", "image_urls", "search_done", "search_errors",
        "listing_rows", F.array_join("failed_examples", ",").alias("failed_examples"))


_DUE = f"status = 'pending' AND next_try_at <= TIMESTAMP '{NOW}'"
_ORDER = ("CASE kind WHEN 'image' THEN 0 WHEN 'listing' THEN 1 WHEN 'search' THEN 2 ELSE 3 END, "
          "next_try_at, enqueued_at, url")


@query("claim_order_batch", over("v_queue", f"""
    SELECT url, kind, source FROM v_queue WHERE {_DUE} AND source = 'bat'
    ORDER BY {_ORDER} LIMIT 100"""))
def _(spark, sf):
    return crawlqueue.next_batch(queue(spark, sf), 100, now(), "bat").select("url", "kind", "source")


@query("claim_batch", over("v_queue", f"""
    , b AS (SELECT url AS u FROM v_queue WHERE {_DUE} ORDER BY {_ORDER} LIMIT 200)
    SELECT url, CASE WHEN u IS NOT NULL THEN 'in_progress' ELSE status END AS status,
      strftime(CASE WHEN u IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE claimed_at END,
        '%Y-%m-%d %H:%M:%S') AS claimed_at FROM v_queue LEFT JOIN b ON u = url"""))
def _(spark, sf):
    return crawlqueue.claim_batch(queue(spark, sf), 200, now()).select(
        "url", "status", stamp("claimed_at").alias("claimed_at"))


_BUDGETS = " ".join(f"WHEN '{s}' THEN {n}" for s, n in K.SOURCE_MAX_ITEMS.items())


@query("budgeted_batch", over("v_queue", f"""
    SELECT url, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER})
      AS rn FROM v_queue WHERE {_DUE}) WHERE rn <= CASE source {_BUDGETS} END"""))
def _(spark, sf):
    budgets = spark.createDataFrame(list(K.SOURCE_MAX_ITEMS.items()), "source string, max_items int")
    return crawlqueue.budgeted_batch(queue(spark, sf), budgets, now()).select("url", "source")


@query("queue_enqueue", over("v_queue", f"""
    SELECT url, status, attempts::BIGINT AS attempts FROM v_queue UNION ALL
    SELECT DISTINCT 'http://q/' || (c_custkey * 20), 'pending', 0 FROM customer
    WHERE 'http://q/' || (c_custkey * 20) NOT IN (SELECT url FROM v_queue)"""))
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("http://q/"), F.col("c_custkey") * 20).alias("url"),
        F.lit("bat").alias("source"), F.lit("listing").alias("kind"))
    return crawlqueue.enqueue(queue(spark, sf), rows, now()).select("url", "status", big("attempts"))


def _transition(name, action, sql, **cols):
    """One outcome for every third customer's URL and for URLs the queue does not know."""
    body = f"""
    , o AS (SELECT 'http://q/' || (c_custkey * 3) AS u,
        CASE WHEN c_custkey % 2 = 0 THEN 'err' || c_custkey END AS e FROM customer)
    SELECT url, {sql['status']} AS status, ({sql['attempts']})::BIGINT AS attempts,
      {sql['last_error']} AS last_error,
      strftime({sql['next_try_at']}, '%Y-%m-%d %H:%M:%S') AS next_try_at
    FROM v_queue LEFT JOIN o ON u = url"""

    @query(name, over("v_queue", body))
    def _(spark, sf):
        outcomes = table(spark, sf, "customer").select(
            F.concat(F.lit("http://q/"), F.col("c_custkey") * 3).alias("url"),
            F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("err"), "c_custkey")).alias("error"))
        done = getattr(crawlqueue, action)(queue(spark, sf), outcomes, now())
        return done.select("url", "status", big("attempts"), "last_error",
                           stamp("next_try_at").alias("next_try_at"))


_SAME = {"status": "status", "attempts": "attempts", "last_error": "last_error",
         "next_try_at": "next_try_at"}
_HIT = "CASE WHEN u IS NOT NULL THEN {} ELSE {} END"
_transition("queue_mark_done", "mark_done", {
    **_SAME, "status": _HIT.format("'done'", "status"), "last_error": _HIT.format("NULL", "last_error")})
_transition("queue_mark_failed", "mark_failed", {
    "status": _HIT.format("CASE WHEN attempts + 1 >= 5 THEN 'dead' ELSE 'failed' END", "status"),
    "attempts": _HIT.format("attempts + 1", "attempts"), "last_error": _HIT.format("e", "last_error"),
    "next_try_at": _HIT.format(
        f"TIMESTAMP '{NOW}' + to_seconds(least(2 ** (attempts + 1), 3600)::INT)", "next_try_at")})
_transition("queue_mark_dead", "mark_dead", {
    **_SAME, "status": _HIT.format("'dead'", "status"),
    "last_error": _HIT.format("coalesce(e, last_error)", "last_error")})
_transition("queue_requeue", "requeue", {
    "status": _HIT.format("'pending'", "status"), "attempts": _HIT.format("0", "attempts"),
    "last_error": _HIT.format("NULL", "last_error"),
    "next_try_at": _HIT.format(f"TIMESTAMP '{NOW}'", "next_try_at")})


@query("class_space", over("v_canonical v_images", f"""
    , l AS ({_LABELLED.replace("split = 'test'", "split IN ('val', 'test')")})
    SELECT class_id, row_number() OVER (ORDER BY class_id) - 1 AS class_idx
    FROM (SELECT DISTINCT class_id FROM l)"""))
def _(spark, sf):
    args = (images(spark, sf), canonical(spark, sf), ["ECONOMY", "PROMO"])
    return training.class_space(
        filters.select_labelled_rows(*args, "val"), filters.select_labelled_rows(*args, "test"))


@query("val_only_classes", """
    SELECT DISTINCT p_brand AS class_id FROM part WHERE p_type = 'SMALL' AND p_brand NOT IN (
      SELECT p_brand FROM part WHERE p_type = 'LARGE' AND p_size < 10)""")
def _(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_brand", "class_id")
    return training.val_only(
        part.where("p_type = 'LARGE' and p_size < 10"), part.where("p_type = 'SMALL'"))


_VIEW_IDX = "list_position({}, view) - 1".format(sql_list(K.EXTERIOR_VIEWS))


@query("six_way_gate_dataset", over("v_images", f"""
    SELECT image_id, (CASE WHEN view = 'interior' THEN 5 ELSE {_VIEW_IDX} END)::BIGINT AS class_idx
    FROM v_images WHERE view IS NOT NULL AND split = 'val' AND view_score >= 0.7
      AND local_path <> ''"""))
def _(spark, sf):
    return training.six_way_dataset(images(spark, sf), "val", 0.7).select(
        "image_id", big("class_idx"))


@query("unknown_label_count", over("v_images", """
    SELECT count(*) AS n, count(*) FILTER (view = 'side') AS n_unknown FROM v_images
    WHERE view IS NOT NULL AND split = 'val' AND view_score >= 0.7 AND local_path <> ''"""))
def _(spark, sf):
    img = images(spark, sf).replace("side", "sideways", "view")
    return training.unknown_label_count(img, "val", 0.7)


@query("binary_gate_dataset", over("v_images", f"""
    SELECT image_id, (CASE WHEN view = 'interior' THEN 1 ELSE 0 END)::BIGINT AS class_idx
    FROM v_images WHERE view_score >= 0.6 AND local_path <> '' AND view IS NOT NULL
      AND (CASE WHEN view = 'interior' THEN {HASH_SPLIT_SQL.format('image_id')}
        ELSE split END) = 'train'"""))
def _(spark, sf):
    # Interior images have no split of their own, as after a stratified split.
    img = images(spark, sf).withColumn(
        "split", F.when(F.col("view") != "interior", F.col("split")))
    return training.binary_dataset(img, "train", 0.6).select("image_id", big("class_idx"))


@query("hard_class_weights", """
    SELECT c::VARCHAR AS class_id, CASE WHEN c IN (SELECT l_suppkey % 40 FROM lineitem
        ) OR c IN (SELECT l_partkey % 40 FROM lineitem) THEN 2.5::DOUBLE ELSE 1::DOUBLE END AS weight
    FROM (SELECT DISTINCT o_custkey % 50 AS c FROM orders)""")
def _(spark, sf):
    classes = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).cast("string").alias("class_id")).distinct()
    pairs = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 40).cast("string").alias("true_class"),
        (F.col("l_partkey") % 40).cast("string").alias("pred_class"))
    return training.hard_class_weights(classes, pairs, 2.5)


@query("hard_classes", """
    SELECT DISTINCT unnest([l_suppkey % 40, l_partkey % 40])::VARCHAR AS class_id FROM lineitem""")
def _(spark, sf):
    pairs = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 40).cast("string").alias("true_class"),
        (F.col("l_partkey") % 40).cast("string").alias("pred_class"))
    return lookups.hard_classes(pairs)


@query("union_sources", """
    SELECT doc_id::VARCHAR AS listing_id, source, NULL AS make FROM documents UNION ALL
    SELECT p_partkey::VARCHAR, NULL, p_brand FROM part""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("listing_id"), "source")
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("listing_id"), F.col("p_brand").alias("make"))
    return union_sources(docs, parts)


@query("cap_per_group", """
    SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id)
      AS rn FROM documents) WHERE rn <= 5""")
def _(spark, sf):
    return cap_per_group(table(spark, sf, "documents"), "source", ["doc_id"], 5).select(
        "source", "doc_id")
