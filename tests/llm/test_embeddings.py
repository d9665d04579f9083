"""Embedding operators against brute force."""

import numpy as np
import pytest
from motorgrid.llm import lattice, negatives
from pyspark.sql import functions as F


def _frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label int{extra}")


def _random_copies(rng, groups, size, dim=64, noise=0.03):
    """Groups of near copies of random directions, the noise relative to the length."""
    out = []
    for _ in range(groups):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        for _ in range(size):
            out.append(base + rng.normal(size=dim) * noise)
    return out


def _near_by_brute_force(ids, vectors, similarity):
    """n_links and component per vector (those without a direction excluded by the caller)."""
    units = np.array(vectors, np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    close = units @ units.T >= similarity
    np.fill_diagonal(close, False)
    component = np.array(ids)
    while True:
        low = np.where(close, component[None, :], component[:, None]).min(axis=1)
        low = np.minimum(low, component)
        if (low == component).all():
            return close.sum(axis=1), component
        component = low


def test_e8_points_are_the_nearest():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(400, 8)) * 2
    found = lattice.nearest_points(points)
    doubled = np.rint(2 * found).astype(int)
    assert np.allclose(2 * found, doubled)
    parity = doubled % 2
    assert (parity == parity[:, :1]).all()
    assert (np.rint(found.sum(axis=1)).astype(int) % 2 == 0).all()
    roots = lattice.shortest()
    assert len(np.unique(roots, axis=0)) == 240 and np.allclose((roots ** 2).sum(axis=1), 2)
    own = ((points - found) ** 2).sum(axis=1)
    around = ((points[:, None] - found[:, None] - roots) ** 2).sum(axis=2).min(axis=1)
    assert (own <= around + 1e-9).all() and own.max() <= 1 + 1e-9


@pytest.mark.parametrize("task_rows", [32_768, 16])
def test_lattice_links_equal_brute_force(spark, task_rows):
    rng = np.random.default_rng(7)
    vectors = _random_copies(rng, 12, 9) + _random_copies(rng, 200, 1) + _random_copies(rng, 1, 60)
    vectors += vectors[:20]  # exact copies
    ids = rng.permutation(len(vectors) * 3)[:len(vectors)]
    kept = [np.float32(v).tolist() for v in vectors]
    df = _frame(spark, [(int(i), v, 0) for i, v in zip(ids, kept)]).repartition(7)
    got = {r.vec_id: r for r in lattice.near_vectors(df, task_rows=task_rows).collect()}
    links, component = _near_by_brute_force(ids, kept, lattice.SIMILARITY)
    found = sum(r.n_links for r in got.values())
    assert found <= links.sum() and found >= 0.99 * links.sum()
    for i, n, c in zip(ids, links, component):
        assert got[i].n_links <= n
        assert got[i].component_id == c and got[i].kept == (c == i)


def test_pairs_at_the_threshold_are_found(spark):
    """Recall of pairs at a cosine just over 0.95, the hardest ones; pairs just under are not linked."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1000):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cosine = 0.9501 if i < 500 else 0.9499
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (cosine * a + np.sqrt(1 - cosine**2) * b).tolist(), 0)]
    got = lattice.near_vectors(spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, label int")).collect()
    linked = {r.vec_id for r in got if r.n_links}
    assert len([i for i in linked if i < 1000]) >= 0.98 * 1000
    assert not [i for i in linked if i >= 1000]


def test_lattice_odd_rows(spark):
    one = [1.0] + [0.0] * 7
    rows = [
        (1, one, 0, "a"), (2, [2.0] + [0.0] * 7, 0, "b"), (3, None, 0, "c"), (4, [0.0] * 8, None, "d"),
        (5, [float("nan")] * 8, 0, "e"), (6, [None] * 8, 0, "f"), (7, [], 0, "g"), (None, one, 0, "h"),
        (8, [1.0, 0.0], 0, "i"), (9, one, 0, "j"), (9, one, 0, "j"), (10, [-1.0] + [-0.0] * 7, 0, "k"),
        (11, [float("inf")] + [0.0] * 7, 0, "l")]
    df = _frame(spark, rows, ", node string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept)
                  for r in lattice.near_vectors(df).collect()), key=lambda r: (r[0] or 0, r))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)]
    assert got == sorted(
        [(None, 0, None, False), (1, 3, 1, True), (2, 3, 1, False), *alone, (9, 3, 1, False),
         (9, 3, 1, False), (10, 0, 10, True), (11, 0, 11, True)], key=lambda r: (r[0] or 0, r))
    assert lattice.near_vectors(df.limit(0)).collect() == []


def _mined_by_brute_force(rows, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, label, whole); anchors have a vec_id divisible by 100."""
    out = []
    for anchor, label, own in (r for r in rows if r[0] % 100 == 0):
        scored = sorted((-sum(x * y for x, y in zip(own, w)), i, other) for i, other, w in rows)
        near = [(-s, i) for s, i, other in scored if other == label and i != anchor][:positives]
        far = [(-s, i) for s, i, other in scored if other != label]
        for p, positive in near:
            fits = [(s, i) for s, i in far if low * p <= 100 * s <= high * p][:negatives]
            out += [(anchor, positive, n, i, p, s) for n, (s, i) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("clusters, group, cells", [(4, 1024, 1 << 20), (1, 3, 64), (7, 2, 200)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, clusters, group, cells):
    """Few small numbers: many ties, zero vectors, windows of negative scores, copies of one vector."""
    monkeypatch.setattr(negatives, "_CELLS", cells)
    rng = np.random.default_rng(clusters)
    rows = [(int(i) * 20, int(rng.integers(0, 3)), rng.integers(-4, 5, 3).tolist()) for i in range(300)]
    rows += [(20 * i + 1, 1, [3, 3, 3]) for i in range(150)] + [(7, 2, [0, 0, 0]), (300_000, 1, [0, 0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, label long, whole array<int>").repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, clusters=clusters, group=group)
    assert sorted(tuple(r) for r in got.collect()) == _mined_by_brute_force(rows)


def test_walks_end_early(spark, tmp_path):
    """Clustered vectors: the bound ends a walk after a small part of the list, with the same result."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 32)) * 200
    rows = [(i, i % 2, np.rint(centres[i % 4] + rng.normal(size=32) * 20).astype(int).tolist())
            for i in range(4000)]
    seen = []
    real = negatives._list_batches

    def counted(path, cluster, size):
        for batch in real(path, cluster, 50):
            seen.append(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "vec_id long, label long, whole array<int>")
    whole = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, low=-100, high=100)
    expected = _mined_by_brute_force(rows, low=-100, high=100)
    assert sorted(tuple(r) for r in whole.collect()) == expected
    # The same walk in this process, to count what it reads.
    path = str(tmp_path / "lists")
    matrix = np.array([r[2] for r in rows], float)
    centre = negatives.fit_centres(matrix[::100], 4)
    norms = np.linalg.norm(matrix, axis=1)
    angles = np.arccos(negatives._cosines(matrix, norms, centre))
    mine = angles.argmin(axis=1)
    anchors = [i for i in range(0, 4000, 100) if mine[i] == mine[0]]
    bound = norms * np.cos(np.maximum(0, angles[:, mine[0]] - angles[anchors, mine[0]].max() - 1e-7))
    spark.createDataFrame([(*r, float(b)) for r, b in zip(rows, bound)],
                          "vec_id long, label long, whole array<int>, bound double").orderBy(
        F.desc("bound")).coalesce(1).write.parquet(f"{path}/cluster=0")
    import pyarrow as pa
    from unittest import mock
    with mock.patch.object(negatives, "_list_batches", counted):
        table = pa.table({"vec_id": anchors, "label": [rows[i][1] for i in anchors],
                          "whole": pa.array([rows[i][2] for i in anchors], pa.list_(pa.int32()))})
        found = negatives._miner(path, 32, 5, 10, -100, 100)((pa.scalar(0),), table)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = sorted(zip(*(found.column(n).to_pylist() for n in names)))
    assert got == [r for r in expected if r[0] in anchors]
    assert sum(seen) < 2 * 4000 * 0.6


def test_mined_odd_rows(spark):
    rows = [
        (100, [1.0, 0.5], 1, 9), (1, [0.9, 0.4], 1, 9), (2, [0.5, 0.2], 2, 9), (3, [0.5, 0.2], 2, 9),
        (7, [0.6, 0.1], 0, 9), (200, None, 1, 9), (300, [float("nan"), 1.0], 1, 9),
        (400, [None, 1.0], 1, 9), (500, [1.0, 1.0], None, 9), (None, [1.0, 1.0], 1, 9),
        (4, [float("inf"), 0.0], 2, 9), (5, [0.4], 2, 9), (6, [], 2, 9), (600, [], 3, 9)]
    df = _frame(spark, rows, ", rank int")
    got = sorted(tuple(r) for r in negatives.mined(df).collect())
    whole = []
    for i, v, label, _ in rows:
        if i is None or v is None or label is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        whole.append((i, (label + 1) % 10 if i % 7 == 0 else label, w + [0] * (2 - len(w))))
    assert got == _mined_by_brute_force(whole) and len(got) == 4
    assert negatives.mined(df.limit(0)).collect() == []
    assert negatives.mined(df.where("vec_id = 1")).collect() == []
