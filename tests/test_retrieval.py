import numpy as np
import pytest
from pyspark.sql import functions as F

from motorgrid.operators import evaluation, prototypes, summaries
from motorgrid.operators.similarity import _top, score_top_k, top_k_rows
from motorgrid.plans import retrieval

CLASSES = [f"2012|make{i % 3}|m{i}" for i in range(6)]


def _basis(i):
    return [5.0 if j == i else 0.1 for j in range(8)]


@pytest.fixture(scope="module")
def protos(spark):
    rows = [(c, _basis(i)) for i, c in enumerate(CLASSES)]
    return prototypes.build_prototypes(spark.createDataFrame(rows, "class_id string, embedding array<float>"))


def test_prototypes(spark, protos):
    got = {r.class_id: r for r in protos.collect()}
    for i, c in enumerate(CLASSES):
        v = np.array(_basis(i), dtype=np.float32).astype(float)
        assert np.allclose(got[c].prototype, v / np.linalg.norm(v))
    assert got[CLASSES[0]].display_name == "2012-2015 Make0 M0"
    zero = prototypes.build_prototypes(spark.createDataFrame(
        [("z", [1.0, 0.0]), ("z", [-1.0, 0.0])], "class_id string, embedding array<double>")).first()
    assert zero.prototype == [0.0, 0.0] and zero.n == 2


def test_top_breaks_ties_by_column():
    scores = np.array([[1.0, 3.0, 3.0, 3.0, 0.0], [2.0, 2.0, 2.0, 2.0, 2.0]])
    assert _top(scores, 2).tolist() == [[1, 2], [0, 1]]
    assert _top(scores, 9).tolist() == [[1, 2, 3, 0, 4], [0, 1, 2, 3, 4]]


@pytest.mark.parametrize("by", [None, "view"])
def test_results_do_not_depend_on_blocks(spark, by):
    rng = np.random.default_rng(3)
    protos = spark.createDataFrame(
        # One class alone has the view "side"; most blocks lack it.
        [(f"c{i:03d}", "side" if i == 31 else "front" if i % 2 else "rear", rng.normal(size=6).tolist())
         for i in range(50)],
        "class_id string, view string, prototype array<double>")
    queries = spark.createDataFrame(
        [(f"q{i}", ["front", "rear", "none", "side", None][i % 5], rng.normal(size=6).tolist()) for i in range(40)],
        "query_id string, view string, embedding array<double>")
    table = protos if by else protos.drop("view")
    a = score_top_k(queries, table, 4, by=by, scale=3.0)

    vectors = {r.query_id: r for r in queries.collect()}
    expected = {}
    for q in vectors.values():
        mine = [(r.class_id, float(np.dot(r.prototype, q.embedding))) for r in protos.collect()
                if by is None or r.view == q.view]
        total = sum(np.exp(3.0 * s) for _, s in mine)
        for n, (c, s) in enumerate(sorted(mine, key=lambda x: (-x[1], x[0]))[:4]):
            expected[q.query_id, n + 1] = (c, round(s, 9), round(float(np.exp(3.0 * s) / total), 9))

    def rows(df):
        return {(r.query_id, r["rank"]): (r.class_id, round(r.score, 9), round(r.confidence, 9))
                for r in top_k_rows(df, scale=3.0).collect()}

    assert rows(a) == expected
    for block in (1, 7 * 6 * 8, 10**9):
        b = score_top_k(queries, table, 4, by=by, scale=3.0, block_bytes=block)
        assert rows(b) == expected and b.count() == 40


def test_no_query_is_lost(spark, protos):
    rows = [("q1", _basis(0), "front", 0.9), ("q2", _basis(1), "rear", 0.9), ("q3", _basis(2), "non-exterior", 0.9)]
    queries = spark.createDataFrame(rows, "query_id string, embedding array<float>, gate_view string, gate_score double")
    views = protos.withColumn("view", F.lit("front"))
    done = retrieval.recognize_batch(queries, views, 20.0, 2, gate="six-way")
    got = {}
    for r in done.collect():
        got.setdefault((r.query_id, r.status), []).append(r.confidence)
    assert set(got) == {("q1", "ok"), ("q2", "no prototypes"), ("q3", "rejected")}
    assert len(got["q1", "ok"]) == 2 and got["q2", "no prototypes"] == [None]


def test_no_prototypes(spark, protos):
    queries = spark.createDataFrame([("q", _basis(0))], "query_id string, embedding array<float>")
    scored = score_top_k(queries, protos.where("false"), 3)
    assert scored.first().top_classes == []


@pytest.fixture(scope="module")
def marked(spark, protos):
    # Queries of class 1 look like class 2; class "gone" has no prototype.
    rows = [(f"q{i}", _basis(i), CLASSES[i], "front", "2010s", f"Make{i % 3}") for i in (0, 3, 4)]
    rows += [(f"w{i}", _basis(2), CLASSES[1], None, "2000s", "Make1") for i in range(3)]
    rows += [("g", _basis(5), "gone", "rear", "unknown", "Make2")]
    queries = spark.createDataFrame(
        rows, "query_id string, embedding array<float>, true_class string, view string, era string, make string")
    return retrieval.score_queries(queries, protos).cache()


def test_overall_and_breakdown(marked):
    total = evaluation.overall(marked).first()
    assert (total.n, total.top_1, total.top_10) == (7, 3, 6)
    cells = {(r.facet, r.key): (r.n, r.top_1) for r in evaluation.breakdown(marked).collect()}
    assert cells[("overall", "")] == (7, 3)
    assert cells[("view", "unknown")] == (3, 0) and cells[("view", "front")] == (3, 3)
    assert cells[("era", "unknown")] == (1, 0)
    worst = evaluation.worst_cells(evaluation.breakdown(marked), "make").collect()
    assert worst[0].key == "Make2"


def test_confusions(marked):
    pairs = evaluation.confusions(marked, 50).collect()
    assert (pairs[0].true_class, pairs[0].pred_class, pairs[0].n, pairs[0].rate) == (
        CLASSES[1], CLASSES[2], 3, 0.75)
    per_make = evaluation.make_confusions(marked, 3, 3).collect()
    assert [(r.make, r.n, r.rate) for r in per_make] == [("Make1", 3, 1.0)]


def test_per_class_and_ends(spark, marked):
    counts = spark.createDataFrame([(CLASSES[0], 9)], "class_id string, n_train bigint")
    metrics = evaluation.per_class(marked, counts)
    got = {r.class_id: (r.n_train, r.n_test, r.top_1) for r in metrics.collect()}
    assert got[CLASSES[0]] == (9, 1, 1.0) and got["gone"] == (0, 1, 0.0)
    assert {r.class_id for r in evaluation.worst_and_best(metrics, 1).collect()} == {CLASSES[1], CLASSES[4]}
    assert evaluation.worst_and_best(metrics, 40).count() == metrics.count()
    with pytest.raises(ValueError):
        evaluation.worst_and_best(metrics, -1)


def test_per_view_prototypes_are_refused(protos):
    with pytest.raises(ValueError):
        retrieval.score_queries(None, protos.withColumn("view", F.lit("front")))
    with pytest.raises(ValueError):
        prototypes.require_prototypes(protos, "six-way")
    with pytest.raises(ValueError):
        prototypes.require_prototypes(protos.union(protos))


@pytest.mark.parametrize("mode, view, score, status", [
    ("binary", "non-exterior", 0.5, "rejected"), ("binary", "non-exterior", 0.49, "ok"),
    ("binary", "front", 0.01, "ok"), ("six-way", "non-exterior", 0.01, "rejected"),
    ("six-way", "front", 0.49, "rejected"), ("six-way", "front", 0.5, "ok")])
def test_gate(spark, mode, view, score, status):
    row = spark.range(1).select(
        retrieval.gate_status(F.lit(view), F.lit(score), mode, 0.5).alias("s")).first()
    assert row.s == status


@pytest.mark.parametrize("choice, order, applied, top", [
    (0, "abcd", True, 0.6), (3, "dabc", True, 0.6), (-1, "abcd", False, 0.4), (4, "abcd", False, 0.4),
    (None, "abcd", False, 0.4)])
def test_rerank(spark, choice, order, applied, top):
    preds = spark.createDataFrame(
        [("q", c, conf, r) for r, (c, conf) in enumerate(zip("abcd", (0.4, 0.3, 0.2, 0.1)), 1)],
        "query_id string, class_id string, confidence double, rank int")
    choices = spark.createDataFrame([("q", choice)], "query_id string, choice int")
    got = retrieval.apply_rerank(preds, choices, 0.6).orderBy("rank").collect()
    assert "".join(r.class_id for r in got) == order
    assert got[0].rerank_applied is applied and got[0].confidence == pytest.approx(top)
    sure = retrieval.apply_rerank(preds, choices, 0.4).orderBy("rank").collect()
    assert "".join(r.class_id for r in sure) == "abcd"


def test_parity_thresholds(spark, protos):
    a = spark.createDataFrame([(f"q{i}", _basis(i)) for i in range(5)], "query_id string, embedding array<float>")
    same = retrieval.compare_embeddings(a, a, protos).first()
    assert same.passed and same.failed == [] and same.top5_identity == 1.0
    b = spark.createDataFrame([(f"q{i}", _basis((i + 1) % 5)) for i in range(5)],
                              "query_id string, embedding array<float>")
    other = retrieval.compare_embeddings(a, b, protos).first()
    assert not other.passed and other.failed[:3] == ["cosine_mean", "cosine_min", "top1_identity"]


def test_weights(spark):
    def weights(counts):
        df = spark.createDataFrame(list(enumerate(counts)), "class_idx int, n bigint")
        return [r.weight for r in summaries.inverse_sqrt_weights(df).orderBy("class_idx").collect()]

    got = weights([4, 16, 0])
    assert got == pytest.approx([2.0, 1.0, 0.0]) and weights([0, 0]) == [1.0, 1.0]
