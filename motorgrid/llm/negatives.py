"""Hard-negative mining over shared candidate lists, one per cluster of anchors.

Anchors are clustered by direction. For a cluster with centre c whose members lie within the angle w of
c, no member u has an inner product with a candidate x above |u| |x| cos(max(0, angle(x, c) - w)), by
the triangle inequality of angles. Each cluster sorts all candidates by that bound once, into files in
the shared folder. A task holds a bounded group of a cluster's anchors and streams the cluster's list
past them; an anchor leaves as soon as the next bound shows that nothing further down can enter its
result. The first walk finds the positives, the second the negatives in the positives' score windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid.llm.common import shared_path
from motorgrid.llm.vectors import by_dimension

# Lists, each with all candidates: the disk that they take is this many times the vectors' own.
CLUSTERS = 4
# Anchors that the centres are fitted on; the centres decide only how early a walk ends.
SAMPLE = 4096
# Anchors that one pass over a list serves, and scores held at once.
GROUP = 512
_CELLS = 1 << 20
# Components are held as 32-bit integers; larger ones count as the largest.
_LARGEST = 2**31 - 1
_ROUNDS = 12
# Scores below this are exact in double precision.
_EXACT = 2.0**53

_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
           "negative_score long")


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) per component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * F.greatest(F.least(
        x.cast("double"), F.lit(float(_LARGEST // scale))), F.lit(-float(_LARGEST // scale)))
        ).cast("int"))


def usable(vector: Column) -> Column:
    """Neither null nor with null, NaN or infinite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < F.lit(float("inf"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) float64; shorter vectors end in zeros."""
    out = np.zeros((len(column), width))
    for rows, matrix in by_dimension(column):
        out[rows, :matrix.shape[1]] = matrix
    return out


def _cosines(matrix: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cosine to every centre; 1 for a vector of zeros, whose products are zero anyhow."""
    some = matrix @ centres.T / np.where(norms > 0, norms, 1)[:, None]
    some[norms == 0] = 1
    return np.clip(some, -1, 1)


def fit_centres(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Unit centres of spherical k-means over the sample's rows, the first ones far apart."""
    norms = np.linalg.norm(sample, axis=1)
    units = np.unique(sample[norms > 0] / norms[norms > 0, None], axis=0)
    if not len(units):
        centre = np.zeros((1, sample.shape[1]))
        centre[:, :1] = 1
        return centre
    chosen = [units[0]]
    while len(chosen) < min(clusters, len(units)):
        chosen.append(units[(units @ np.array(chosen).T).max(axis=1).argmin()])
    centres = np.array(chosen)
    for _ in range(_ROUNDS):
        own = (units @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            mean = units[own == k].sum(axis=0)
            if np.linalg.norm(mean) > 0:
                centres[k] = mean / np.linalg.norm(mean)
    return centres


def _assigner(centres: np.ndarray) -> Callable:
    """Anchors with their cluster and their angle to its centre."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("whole"), centres.shape[1])
            norms = np.linalg.norm(matrix, axis=1)
            cosines = _cosines(matrix, norms, centres)
            own = cosines.argmax(axis=1)
            angle = np.arccos(cosines[np.arange(len(own)), own])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle)],
                names=[*batch.schema.names, "cluster", "angle"])

    return run


def _bounder(centres: np.ndarray, wide: dict[int, float]) -> Callable:
    """Every candidate once per cluster, with its bound for an anchor of length one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("whole"), centres.shape[1])
            norms = np.linalg.norm(matrix, axis=1)
            angles = np.arccos(_cosines(matrix, norms, centres))
            for cluster, width in wide.items():
                bound = norms * np.cos(np.maximum(0, angles[:, cluster] - width))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(bound), cluster, np.int32)),
                     pa.array(bound)], names=[*batch.schema.names, "cluster", "bound"])

    return run


def _list_batches(path: str, cluster: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The candidates of a cluster's list, best bound first."""
    store, base = fs.FileSystem.from_uri(path)
    folder = fs.FileSelector(f"{base}/cluster={cluster}", allow_not_found=True)
    # Files are numbered along the order that they were sorted in.
    for name in sorted(f.path for f in store.get_file_info(folder) if f.path.endswith(".parquet")):
        with store.open_input_file(name) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=rows)


class _Best:
    """The first ``size`` (score, then smaller id) per slot."""

    def __init__(self, slots: int, size: int) -> None:
        self.size = size
        self.slot, self.score, self.name = (np.zeros(0, np.int64) for _ in range(3))
        self.count = np.zeros(slots, np.int64)
        self.last = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        slot, score, name = (np.concatenate(x) for x in (
            (self.slot, slot), (self.score, score), (self.name, name)))
        order = np.lexsort((name, -score, slot))
        slot, score, name = slot[order], score[order], name[order]
        starts = np.searchsorted(slot, np.arange(len(self.count)))
        kept = np.arange(len(slot)) - starts[slot] < self.size
        self.slot, self.score, self.name = slot[kept], score[kept], name[kept]
        self.count = np.bincount(self.slot, minlength=len(self.count))
        full = np.flatnonzero(self.count == self.size)
        ends = np.searchsorted(self.slot, full, side="right") - 1
        self.last[full] = self.score[ends]


def _scores(anchors: np.ndarray, norms: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = norms.max(initial=0) * np.sqrt((block ** 2).sum(axis=1).max(initial=0))
    if most < _EXACT:
        return (anchors @ block.T).astype(np.int64)
    return anchors.astype(np.int64) @ block.astype(np.int64).T


def _walk(path: str, cluster: int, names: np.ndarray, labels: np.ndarray, anchors: np.ndarray,
          visit: Callable, done: Callable) -> None:
    """Stream the list past the anchors that are not ``done`` for the next bound."""
    norms = np.linalg.norm(anchors, axis=1)
    active = np.arange(len(anchors))
    for batch in _list_batches(path, cluster, max(1, _CELLS // max(1, len(anchors)))):
        bounds = batch.column("bound").to_numpy()
        # A hair above, for the rounding of angles.
        active = active[~done(active, norms[active] * (bounds[0] + 1e-9 * abs(bounds[0])) + 1e-3)]
        if not len(active):
            return
        block = _matrix(batch.column("whole"), anchors.shape[1])
        scores = _scores(anchors[active], norms[active], block)
        visit(active, scores, batch.column("vec_id").to_numpy(),
              labels[active][:, None] == batch.column("label").to_numpy()[None, :])


def _miner(path: str, width: int, positives: int, negatives: int, low: int, high: int) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cluster = key[0].as_py()
        names, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        anchors = _matrix(rows.column("whole").combine_chunks(), width)
        best = _Best(len(names), positives)

        def see_positives(active, scores, ids, same):
            fits = same & (ids[None, :] != names[active][:, None])
            fits &= scores >= best.last[active][:, None]
            a, b = np.nonzero(fits)
            best.add(active[a], scores[a, b], ids[b])

        def positives_done(active, most):
            return (best.count[active] == positives) & (best.last[active] > most)

        _walk(path, cluster, names, labels, anchors, see_positives, positives_done)
        # Windows of whole scores: low * p <= 100 * n <= high * p. A slot per anchor and positive.
        floor, ceiling = -(-low * best.score // 100), high * best.score // 100
        found = _Best(len(best.slot), negatives)
        first = np.searchsorted(best.slot, np.arange(len(names)))
        held = np.bincount(best.slot, minlength=len(names))

        def see_negatives(active, scores, ids, same):
            for j in range(positives):
                has = np.flatnonzero(held[active] > j)
                slot = first[active[has]] + j
                some = scores[has]
                fits = ~same[has] & (some >= np.maximum(floor[slot], found.last[slot])[:, None])
                fits &= some <= ceiling[slot][:, None]
                a, b = np.nonzero(fits)
                found.add(slot[a], some[a, b], ids[b])

        def negatives_done(active, most):
            done = np.ones(len(active), bool)
            for j in range(positives):
                has = held[active] > j
                slot = first[active[has]] + j
                full = (found.count[slot] == negatives) & (found.last[slot] > most[has])
                done[has] &= full | (floor[slot] > most[has]) | (floor[slot] > ceiling[slot])
            return done

        _walk(path, cluster, names, labels, anchors, see_negatives, negatives_done)
        rank = np.arange(len(found.slot)) - np.searchsorted(found.slot, found.slot) + 1
        return pa.table({
            "anchor_id": names[best.slot[found.slot]], "positive_id": best.name[found.slot],
            "rank": pa.array(rank.astype(np.int32)), "negative_id": found.name,
            "positive_score": best.score[found.slot], "negative_score": found.score})

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, clusters: int = CLUSTERS, group: int = GROUP,
                   sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and whole (array<int>); the score of a row is its inner product with
    the anchor, missing components counting as zero. Higher scores come first, ties by smaller vec_id.
    An anchor's positives are the first ``positives`` rows of its label and of another vec_id; for
    each come the first ``negatives`` rows of other labels with
    ``low`` * positive_score <= 100 * score <= ``high`` * positive_score. Fewer where there are fewer,
    no row where there are none. Rows that repeat a vec_id count as rows of their own. Rows with a
    null vec_id, label or vector take no part; an empty table, or one without anchors, gives no rows.
    Components are whole numbers of 32 bits and scores must fit a long.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("label").cast("long").alias("label"), "whole").where(
        "vec_id is not null and label is not null and whole is not null")
    anchors = rows.where(is_anchor)
    width = rows.agg(F.max(F.size("whole"))).first()[0]
    # Thinned by a hash order over bounded partial tops, so the driver gets ``sample`` rows at most.
    picked = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("whole").toArrow()
    if not width or not picked.num_rows:
        return spark.createDataFrame([], _RESULT)
    centres = fit_centres(_matrix(picked.column("whole").combine_chunks(), width), clusters)
    assigned = anchors.mapInArrow(
        _assigner(centres), "vec_id long, label long, whole array<int>, cluster int, angle double")
    # One row per cluster: its widest angle and how many groups of anchors it is cut into.
    sizes = assigned.groupBy("cluster").agg(
        F.max("angle").alias("wide"), F.ceil(F.count("*") / F.lit(group)).alias("n")).collect()
    wide = {r["cluster"]: r["wide"] + 1e-7 for r in sizes}
    path = shared_path(spark, "lists")
    rows.mapInArrow(
        _bounder(centres, wide), "vec_id long, label long, whole array<int>, cluster int, bound double"
    ).orderBy("cluster", F.desc("bound"), "vec_id").write.partitionBy("cluster").parquet(path)
    groups = F.lit(1)
    for r in sizes:
        groups = F.when(F.col("cluster") == r["cluster"], F.lit(int(r["n"]))).otherwise(groups)
    # A partition per group: groups are small in bytes, so Spark would merge them, but each of them
    # walks a whole list.
    grouped = assigned.withColumn("_group", F.pmod(F.xxhash64("vec_id"), groups)).repartitionByRange(
        int(sum(r["n"] for r in sizes)), "cluster", "_group")
    return grouped.groupBy("cluster", "_group").applyInArrow(
        _miner(_uri(path), width, positives, negatives, low, high), _RESULT)


def _uri(path: str) -> str:
    return f"file://{path}" if path.startswith("/") else path


def mined(embeddings: DataFrame, scale: int = 256, every: int = 100, moved: int = 7, labels: int = 10
          ) -> DataFrame:
    """``hard_negatives`` of ``embeddings`` (vec_id, embedding, label) with whole components.

    Components become floor(``scale`` * x). Where vec_id is divisible by ``moved`` the label first
    becomes (label + 1) % ``labels``; rows whose vec_id is divisible by ``every`` are anchors. Rows
    with a null vec_id, label or vector, or a null or non-finite component, take no part. Components
    beyond 32 bits count as the largest that fits.
    """
    label = F.col("label").cast("long")
    rows = embeddings.where(usable(F.col("embedding")) & F.col("label").isNotNull()).select(
        "vec_id", F.when(F.col("vec_id") % moved == 0, (label + 1) % labels).otherwise(label).alias(
            "label"), whole_components(F.col("embedding"), scale).alias("whole"))
    return hard_negatives(rows, F.col("vec_id") % every == 0)


SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
        list_inner_product(a.w, b.w)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
    (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER
        AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
