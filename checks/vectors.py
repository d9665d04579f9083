"""Prototypes, retrieval, evaluation, recognition and parity over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import NOW, big, now, over, pick, query, r6, sql_list, table, vectors
from motorgrid import constants as K
from motorgrid.operators import evaluation, prototypes, training
from motorgrid.operators.similarity import score_top_k, score_vector_argmax, top_k_rows
from motorgrid.plans import labelling, retrieval

SCALE = 20.0
_DIM = "range(1, 65) t(pos)"


def train(spark, sf):
    return vectors(spark, sf).where("split = 'train'")


def test(spark, sf):
    return vectors(spark, sf).where("split = 'test'").withColumnRenamed("class_id", "true_class")


def protos(spark, sf):
    return prototypes.build_prototypes(train(spark, sf))


def view_protos(spark, sf):
    return prototypes.build_prototypes_by_view(train(spark, sf))


def marked(spark, sf):
    return retrieval.score_queries(test(spark, sf), protos(spark, sf))


def _long(df, *keys):
    """One row per vector position."""
    return df.select(*keys, F.posexplode("prototype").alias("pos", "value")).select(
        *keys, big("pos"), r6("value").alias("value"))


def _long_sql(view, keys):
    return (f"SELECT {keys}, unnest(range(64)) AS pos, round(unnest(p), 6) + 0.0::DOUBLE AS value "
            f"FROM {view}")


@query("class_prototypes", over("v_protos", _long_sql("v_protos", "class_id, n")))
def _(spark, sf):
    return _long(protos(spark, sf), "class_id", "n")


@query("view_prototypes", over("v_view_protos", _long_sql("v_view_protos", "class_id, view, n")))
def _(spark, sf):
    return _long(view_protos(spark, sf), "class_id", "view", "n")


_PROMPTS = f"""
    , unit AS (SELECT label % 4 AS k, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))
        AS u FROM v_vec),
    m AS (SELECT k, list(a ORDER BY pos) AS mean FROM (SELECT k, pos, avg(u[pos]) AS a
        FROM unit, {_DIM} GROUP BY k, pos) GROUP BY k),
    lv AS (SELECT ({sql_list(K.ALL_VIEWS)})[k + 1] AS label, list_transform(mean, lambda x:
        x / sqrt(list_inner_product(mean, mean))) AS p FROM m)"""


def label_table(spark, sf):
    prompts = vectors(spark, sf).withColumn("label", pick(K.ALL_VIEWS, F.col("label") % 4))
    return prototypes.label_vectors(prompts.select("label", "embedding"))


@query("label_prompt_vectors", over("v_vec", _PROMPTS + _long_sql("lv", "label")))
def _(spark, sf):
    return _long(label_table(spark, sf), "label")


@query("prototype_coverage", over("v_view_protos", f"""
    SELECT v.view, count(p.class_id) AS populated FROM (SELECT unnest({sql_list(K.EXTERIOR_VIEWS)})
      AS view) v LEFT JOIN v_view_protos p USING (view) GROUP BY 1"""))
def _(spark, sf):
    return prototypes.view_coverage(view_protos(spark, sf))


@query("prototype_checks", over("v_view_protos", """
    SELECT count(*) AS n_rows, count(*) AS n_keys, 64::BIGINT AS min_dim, 64::BIGINT AS max_dim,
      0::BIGINT AS n_null, 2::BIGINT AS version, true AS valid FROM v_view_protos"""))
def _(spark, sf):
    return prototypes.prototype_checks(view_protos(spark, sf)).select(
        "n_rows", "n_keys", big("min_dim"), big("max_dim"), "n_null", big("version"), "valid")


@query("top_k_predictions", over("v_ranked", """
    SELECT query_id, class_id, round(score, 6) + 0.0::DOUBLE AS score, rank FROM v_ranked
    WHERE rank <= 5"""))
def _(spark, sf):
    rows = top_k_rows(score_top_k(test(spark, sf), protos(spark, sf), 5))
    return rows.select("query_id", "class_id", r6("score").alias("score"), big("rank"))


@query("top_k_blocked", over("v_ranked", """
    SELECT query_id, class_id, round(score, 6) + 0.0::DOUBLE AS score, rank,
      round(exp(20 * score) / sum(exp(20 * score)) OVER (PARTITION BY query_id), 6) + 0.0::DOUBLE
        AS confidence FROM v_ranked QUALIFY rank <= 5"""))
def _(spark, sf):
    # Blocks of three prototypes.
    scored = score_top_k(test(spark, sf), protos(spark, sf), 5, scale=SCALE, block_bytes=3 * 64 * 8)
    return top_k_rows(scored, scale=SCALE).select(
        "query_id", "class_id", r6("score").alias("score"), big("rank"),
        r6("confidence").alias("confidence"))


@query("view_retrieval", over("v_view_protos", """
    SELECT query_id, p.class_id, round(list_inner_product(q.e, p.p), 6) + 0.0::DOUBLE AS score
    FROM v_vec q JOIN v_view_protos p USING (view) WHERE split = 'test'
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(q.e, p.p) DESC,
      p.class_id) <= 3"""))
def _(spark, sf):
    rows = top_k_rows(score_top_k(test(spark, sf), view_protos(spark, sf), 3, by="view"))
    return rows.select("query_id", "class_id", r6("score").alias("score"))


@query("softmax_all_classes", over("v_ranked", """
    SELECT query_id, class_id, rank, round(exp(20 * score) / sum(exp(20 * score)) OVER
      (PARTITION BY query_id), 6) + 0.0::DOUBLE AS confidence FROM v_ranked QUALIFY rank <= 3"""))
def _(spark, sf):
    scored = score_top_k(test(spark, sf), protos(spark, sf), 3, scale=SCALE)
    return top_k_rows(scored, scale=SCALE).select(
        "query_id", "class_id", big("rank"), r6("confidence").alias("confidence"))


@query("softmax_top_k", over("v_ranked", """
    SELECT query_id, class_id, rank, round(exp(7 * score) / sum(exp(7 * score)) OVER
      (PARTITION BY query_id), 6) + 0.0::DOUBLE AS confidence FROM v_ranked WHERE rank <= 5"""))
def _(spark, sf):
    rows = top_k_rows(score_top_k(test(spark, sf), protos(spark, sf), 5), temperature=7.0)
    return rows.select("query_id", "class_id", big("rank"), r6("confidence").alias("confidence"))


@query("score_vector_argmax", """
    SELECT vec_id, 'c' || (list_position(s, list_max(s)) - 1) AS label,
      round(exp(list_max(s)) / list_sum(list_transform(s, lambda x: exp(x))), 6) + 0.0::DOUBLE
        AS probability FROM (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings)""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("s"))
    best = score_vector_argmax(rows, "s", [f"c{i}" for i in range(64)])
    return best.select("vec_id", "label", r6("probability").alias("probability"))


_HITS = ", ".join(
    f"count(*) FILTER (coalesce(true_rank <= {k}, false)) AS top_{k}" for k in K.TOP_KS)


@query("evaluation_overall", over("v_marked", f"""
    SELECT *, {', '.join(f'round(top_{k} / n, 6)::DOUBLE AS acc_{k}' for k in K.TOP_KS)}
    FROM (SELECT count(*) AS n, {_HITS} FROM v_marked)"""))
def _(spark, sf):
    done = evaluation.overall(marked(spark, sf))
    return done.select("n", *[f"top_{k}" for k in K.TOP_KS],
                       *[r6(f"acc_{k}").alias(f"acc_{k}") for k in K.TOP_KS])


_BREAKDOWN = f"""
    SELECT 'overall' AS facet, '' AS key, count(*) AS n, {_HITS} FROM v_marked
    UNION ALL SELECT 'make', make, count(*), {_HITS} FROM v_marked GROUP BY make
    UNION ALL SELECT 'view', view, count(*), {_HITS} FROM v_marked GROUP BY view
    UNION ALL SELECT 'era', era, count(*), {_HITS} FROM v_marked GROUP BY era"""


@query("evaluation_breakdown", over("v_marked", _BREAKDOWN))
def _(spark, sf):
    return evaluation.breakdown(marked(spark, sf))


@query("worst_cells", over("v_marked", f"""
    SELECT key, n, top_1 FROM ({_BREAKDOWN}) WHERE facet = 'make' ORDER BY top_1 / n, n DESC, key LIMIT 6"""))
def _(spark, sf):
    cells = evaluation.worst_cells(evaluation.breakdown(marked(spark, sf)), "make", limit=6)
    return cells.select("key", "n", "top_1")


_PAIRS = """(SELECT true_class, pred_class, count(*) AS n FROM v_marked
    WHERE true_class <> pred_class GROUP BY ALL)"""


def _shown(col):
    return f"'2012-2015 Make' || {col}[10:10] || ' Model' || {col}[-1:]"


@query("confusion_pairs", over("v_marked", f"""
    SELECT true_class, pred_class, n, round(n / (SELECT count(*) FROM v_marked WHERE
        coalesce(true_rank, 99) > 1), 6)::DOUBLE AS rate, {_shown('true_class')} AS true_name,
      {_shown('pred_class')} AS pred_name
    FROM {_PAIRS} ORDER BY n DESC, true_class, pred_class LIMIT 50"""))
def _(spark, sf):
    return evaluation.confusions(marked(spark, sf), K.CONFUSION_LIMIT).withColumn("rate", r6("rate"))


@query("make_confusions", over("v_marked", """
    , p AS (SELECT make, true_class, pred_class, count(*) AS n FROM v_marked
      WHERE true_class <> pred_class GROUP BY ALL)
    SELECT make, true_class, pred_class, n, rank, round(n / wrong, 6)::DOUBLE AS rate FROM (
      SELECT *, row_number() OVER (PARTITION BY make ORDER BY n DESC, true_class, pred_class) AS rank,
        sum(n) OVER (PARTITION BY make) AS wrong FROM p)
    WHERE rank <= 3 AND make IN (SELECT make FROM v_marked GROUP BY make HAVING count(*) >= 2)"""))
def _(spark, sf):
    done = evaluation.make_confusions(marked(spark, sf), 2, K.PER_MAKE_LIMIT)
    return done.withColumn("rate", r6("rate")).withColumn("rank", big("rank"))


_PER_CLASS = f"""
    SELECT true_class AS class_id, coalesce(any_value(p.n), 0) AS n_train, count(*) AS n_test,
      round(avg(coalesce(true_rank <= 1, false)::INT), 6) AS top_1,
      round(avg(coalesce(true_rank <= 5, false)::INT), 6) AS top_5
    FROM v_marked LEFT JOIN v_protos p ON p.class_id = true_class GROUP BY true_class"""


def _metrics(spark, sf):
    counts = train(spark, sf).groupBy("class_id").agg(F.count("*").alias("n_train"))
    return evaluation.per_class(marked(spark, sf), counts).withColumn(
        "top_1", r6("top_1")).withColumn("top_5", r6("top_5"))


@query("per_class_metrics", over("v_marked", _PER_CLASS))
def _(spark, sf):
    return _metrics(spark, sf)


@query("worst_and_best_classes", over("v_marked", f"""
    , m AS ({_PER_CLASS}), r AS (SELECT *, row_number() OVER (ORDER BY top_1, class_id) AS a,
      row_number() OVER (ORDER BY top_1 DESC, class_id DESC) AS b FROM m)
    SELECT class_id, n_train, n_test, top_1, top_5, CASE WHEN a <= 3 THEN 'worst' ELSE 'best' END AS "end",
      CASE WHEN a <= 3 THEN a ELSE b END AS rank FROM r WHERE a <= 3 OR b <= 3"""))
def _(spark, sf):
    return evaluation.worst_and_best(_metrics(spark, sf), 3).withColumn("rank", big("rank"))


@query("frequent_pairs", over("v_marked", f"""
    SELECT * FROM {_PAIRS} ORDER BY n DESC, true_class, pred_class LIMIT 5"""))
def _(spark, sf):
    return evaluation.top_pairs(evaluation.pair_counts(marked(spark, sf)), 5)


@query("evaluate_baseline", over("v_marked", f"""
    , m AS ({_PER_CLASS})
    SELECT class_id, n_train, n_test, top_1, top_5, 'worst' AS "end",
      row_number() OVER (ORDER BY top_1, class_id) AS rank FROM m"""))
def _(spark, sf):
    counts = train(spark, sf).groupBy("class_id").agg(F.count("*").alias("n_train"))
    done = retrieval.evaluate_baseline(test(spark, sf), protos(spark, sf), counts, 20)["per_class"]
    return done.withColumns({"top_1": r6("top_1"), "top_5": r6("top_5"), "rank": big("rank")})


@query("evaluate_missing_class", over("v_ranked", f"""
    , kept AS (SELECT query_id, true_class, class_id, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, class_id) AS rank FROM v_ranked WHERE class_id NOT LIKE '%model3'),
    mk AS (SELECT query_id, max(CASE WHEN class_id = true_class THEN rank END) AS true_rank
      FROM kept GROUP BY query_id)
    SELECT count(*) AS n, {_HITS} FROM mk"""))
def _(spark, sf):
    some = protos(spark, sf).where("class_id not like '%model3'")
    return retrieval.evaluate(test(spark, sf), some)["overall"].select(
        "n", *[f"top_{k}" for k in K.TOP_KS])


_GATE = """(SELECT *, CASE WHEN query_id::BIGINT % 3 = 0 THEN 'non-exterior'
    ELSE coalesce(view, 'side') END AS gate_view, (query_id::BIGINT % 10) / 10.0::DOUBLE AS gate_score
    FROM v_vec WHERE split = 'test')"""


def _gated(spark, sf):
    k = F.col("query_id").cast("bigint")
    return test(spark, sf).withColumn(
        "gate_view", F.when(k % 3 == 0, K.NON_EXTERIOR).otherwise(F.coalesce("view", F.lit("side")))
    ).withColumn("gate_score", (k % 10) / 10.0)


@query("recognize_binary_gate", over("v_protos", f"""
    , s AS (SELECT query_id, p.class_id, list_inner_product(q.e, p.p) AS score, gate_view, gate_score
      FROM {_GATE} q, v_protos p)
    SELECT query_id, CASE WHEN bad THEN 'rejected' ELSE 'ok' END AS status,
      CASE WHEN bad THEN 'none' ELSE class_id END AS class_id,
      CASE WHEN bad THEN 0 ELSE round(conf, 6) + 0.0::DOUBLE END AS confidence FROM (
      SELECT *, gate_view = 'non-exterior' AND gate_score >= 0.5 AS bad,
        exp(20 * score) / sum(exp(20 * score)) OVER (PARTITION BY query_id) AS conf,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, class_id) AS rank FROM s)
    WHERE rank <= CASE WHEN bad THEN 1 ELSE 5 END"""))
def _(spark, sf):
    done = retrieval.recognize_batch(
        _gated(spark, sf), protos(spark, sf), SCALE, 5, gate="binary", threshold=0.5)
    return done.select("query_id", "status", F.coalesce("class_id", F.lit("none")).alias("class_id"),
                       F.coalesce(r6("confidence"), F.lit(0.0)).alias("confidence"))


@query("recognize_six_way_gate", over("v_view_protos", f"""
    , g AS (SELECT *, gate_view = 'non-exterior' OR gate_score < 0.3 AS bad FROM {_GATE}),
    s AS (SELECT query_id, p.class_id, list_inner_product(q.e, p.p) AS score
      FROM g q JOIN v_view_protos p ON p.view = q.gate_view WHERE NOT bad AND p.view <> 'rear')
    SELECT query_id, CASE WHEN bad THEN 'rejected' ELSE 'no prototypes' END AS status,
      'none' AS class_id, 0::DOUBLE AS confidence FROM g WHERE bad OR gate_view = 'rear'
    UNION ALL SELECT query_id, 'ok', class_id, round(conf, 6) + 0.0::DOUBLE FROM (
      SELECT *, exp(20 * score) / sum(exp(20 * score)) OVER (PARTITION BY query_id) AS conf,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, class_id) AS rank FROM s)
    WHERE rank <= 4"""))
def _(spark, sf):
    # One view has no prototypes, and blocks hold two of any view.
    some = view_protos(spark, sf).where("view <> 'rear'")
    done = retrieval.recognize_batch(_gated(spark, sf), some, SCALE, 4, gate="six-way",
                                     threshold=0.3, block_bytes=2 * 64 * 8)
    return done.select("query_id", "status", F.coalesce("class_id", F.lit("none")).alias("class_id"),
                       F.coalesce(r6("confidence"), F.lit(0.0)).alias("confidence"))


_CONF = """, c AS (SELECT *, exp(20 * score) / sum(exp(20 * score)) OVER (PARTITION BY query_id) AS conf
    FROM v_ranked QUALIFY rank <= 5)"""


@query("apply_rerank", over("v_ranked", _CONF + """
    , d AS (SELECT c.*, query_id::BIGINT % 7 - 1 AS choice, max(conf) OVER (PARTITION BY query_id) AS top
      FROM c), f AS (SELECT *, top < 0.6 AND choice >= 0 AND choice < 5 AS applied FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN applied AND
      rank = choice + 1 THEN 0 ELSE 1 END, rank) AS new_rank FROM f)
    SELECT query_id, class_id, new_rank AS rank, applied AS rerank_applied,
      round(CASE WHEN applied AND new_rank = 1 THEN greatest(conf, 0.6) ELSE conf END, 6)
        + 0.0::DOUBLE AS confidence FROM r"""))
def _(spark, sf):
    scored = score_top_k(test(spark, sf), protos(spark, sf), 5, scale=SCALE)
    choices = test(spark, sf).select(
        "query_id", (F.col("query_id").cast("bigint") % 7 - 1).cast("int").alias("choice"))
    done = retrieval.apply_rerank(top_k_rows(scored, scale=SCALE), choices, 0.6)
    return done.select("query_id", "class_id", big("rank"), "rerank_applied",
                       r6("confidence").alias("confidence"))


@query("confidence_floor", over("v_ranked", _CONF + """
    SELECT query_id, rank, round(CASE WHEN rank = 1 AND query_id::BIGINT % 2 = 0
      THEN greatest(conf, 0.9) ELSE conf END, 6) + 0.0::DOUBLE AS confidence FROM c"""))
def _(spark, sf):
    scored = score_top_k(test(spark, sf), protos(spark, sf), 5, scale=SCALE)
    # Choice 0 confirms the first candidate of the even queries, whatever its confidence.
    choices = test(spark, sf).select("query_id", F.when(
        F.col("query_id").cast("bigint") % 2 == 0, 0).otherwise(-1).alias("choice"))
    done = retrieval.apply_rerank(top_k_rows(scored, scale=SCALE), choices, 0.9)
    return done.select("query_id", big("rank"), r6("confidence").alias("confidence"))


@query("label_views", over("v_vec", _PROMPTS + f"""
    , s AS (SELECT q.query_id, q.view, lv.label, list_inner_product(q.e, lv.p) AS score
        FROM v_vec q, lv),
    b AS (SELECT query_id, view, label, exp(20 * score) / sum(exp(20 * score)) OVER
        (PARTITION BY query_id) AS conf FROM s QUALIFY row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, label) = 1)
    SELECT query_id, CASE WHEN view IS NULL THEN label ELSE view END AS view,
      CASE WHEN view IS NULL THEN round(conf, 6) + 0.0::DOUBLE ELSE 0 END AS view_score,
      CASE WHEN view IS NULL THEN '{NOW}' ELSE 'never' END AS labeled_at FROM b"""))
def _(spark, sf):
    vec = vectors(spark, sf)
    img = vec.select(
        F.col("query_id").alias("image_id"), "view", F.lit(None).cast("double").alias("view_score"),
        F.lit(None).cast("timestamp").alias("view_labeled_at"))
    done = labelling.label_views(
        img, vec.select(F.col("query_id").alias("image_id"), "embedding"), label_table(spark, sf),
        SCALE, now())
    return done.select(
        F.col("image_id").alias("query_id"), "view",
        F.coalesce(r6("view_score"), F.lit(0.0)).alias("view_score"),
        F.coalesce(F.date_format("view_labeled_at", "yyyy-MM-dd HH:mm:ss"), F.lit("never"))
        .alias("labeled_at"))


_NOISY = "list_transform(e, lambda x, i: x + CASE WHEN i % 9 = 0 THEN 0.05 ELSE 0 END)"


@query("compare_embeddings", over("v_protos", f"""
    , n AS (SELECT query_id, e AS a, {_NOISY} AS b FROM v_vec),
    ra AS (SELECT query_id, class_id, row_number() OVER (PARTITION BY query_id ORDER BY
      list_inner_product(a, p) DESC, class_id) AS r FROM n, v_protos),
    rb AS (SELECT query_id, class_id, row_number() OVER (PARTITION BY query_id ORDER BY
      list_inner_product(b, p) DESC, class_id) AS r FROM n, v_protos),
    sa AS (SELECT query_id, max(CASE WHEN r = 1 THEN class_id END) AS t1, string_agg(class_id, ','
      ORDER BY class_id) AS t5 FROM ra WHERE r <= 5 GROUP BY 1),
    sb AS (SELECT query_id, max(CASE WHEN r = 1 THEN class_id END) AS t1, string_agg(class_id, ','
      ORDER BY class_id) AS t5 FROM rb WHERE r <= 5 GROUP BY 1),
    c AS (SELECT query_id, list_cosine_similarity(a, b) AS c FROM n)
    SELECT count(*) AS n, round(avg(c), 6) AS cosine_mean, round(min(c), 6) AS cosine_min,
      round(avg((sa.t1 = sb.t1)::INT), 6) AS top1_identity,
      round(avg((sa.t5 = sb.t5)::INT), 6) AS top5_identity,
      avg(c) >= 0.998 AND min(c) >= 0.99 AND avg((sa.t1 = sb.t1)::INT) >= 0.95
        AND avg((sa.t5 = sb.t5)::INT) >= 0.98 AS passed
    FROM c JOIN sa USING (query_id) JOIN sb USING (query_id)"""))
def _(spark, sf):
    a = vectors(spark, sf).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    b = a.select("query_id", F.transform("embedding", lambda x, i: x + F.when(
        (i + 1) % 9 == 0, 0.05).otherwise(0.0)).alias("embedding"))
    done = retrieval.compare_embeddings(a, b, protos(spark, sf))
    rounded = ("cosine_mean", "cosine_min", "top1_identity", "top5_identity")
    return done.select("n", *[r6(c).alias(c) for c in rounded], "passed")


@query("training_manifest", over("v_marked", f"""
    , r AS (SELECT query_id, class_id, split FROM v_vec WHERE split IN ('train', 'val')),
    cls AS (SELECT class_id, row_number() OVER (ORDER BY class_id) - 1 AS class_idx FROM (SELECT
      DISTINCT class_id FROM r)), top AS (SELECT * FROM {_PAIRS} ORDER BY n DESC, true_class,
      pred_class LIMIT 3)
    SELECT query_id, split, class_idx, CASE WHEN class_id IN (SELECT true_class FROM top) OR class_id
      IN (SELECT pred_class FROM top) THEN 3::DOUBLE ELSE 1::DOUBLE END AS weight
    FROM r JOIN cls USING (class_id)"""))
def _(spark, sf):
    rows = vectors(spark, sf).select("query_id", "class_id", "split")
    pairs = evaluation.top_pairs(evaluation.pair_counts(marked(spark, sf)), 3)
    done = retrieval.training_manifest(
        rows.where("split = 'train'").drop("split"), rows.where("split = 'val'").drop("split"),
        pairs, 3.0)["rows"]
    return done.select("query_id", "split", "class_idx", "weight")


@query("hash_split_classes", over("v_vec", """
    SELECT DISTINCT class_id FROM v_vec WHERE split = 'val' AND class_id NOT IN (
      SELECT class_id FROM v_vec WHERE split = 'train' AND label < 5)"""))
def _(spark, sf):
    rows = vectors(spark, sf)
    return training.val_only(
        rows.where("split = 'train' and label < 5"), rows.where("split = 'val'"))
