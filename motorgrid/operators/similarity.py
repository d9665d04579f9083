"""Top-k retrieval of query vectors against prototypes.

Prototypes are written once to the shared folder, in class order. Every task keeps its queries where
they are and streams the prototypes past them in blocks of bounded bytes, with a running top-k and a
running log-sum-exp per query. Queries are never shuffled, nothing is broadcast, and the result does
not depend on the block size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorgrid.session import shared_path

# Prototypes multiplied at once, and queries that one pass over the prototypes serves, in bytes of
# their float64 vectors.
BLOCK_BYTES = 32 * 2**20
QUERY_BYTES = 64 * 2**20
# Blocks of one table are kept between passes while all of them fit.
CACHE_BYTES = 256 * 2**20
# Scores held at once per task, as float64.
_SCORE_CELLS = 4_000_000


def _matrix(column) -> np.ndarray:
    """List column → (rows, dim) float64."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(array.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = len(array)
    if rows and flat.size % rows:
        raise ValueError("vectors of one table must have one dimension and no nulls")
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Column order of the k best per row; ties go to the lower column (= class order)."""
    width = scores.shape[1]
    if k >= width:
        return np.argsort(-scores, axis=1, kind="stable")
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    part.sort(axis=1)
    rows = np.arange(scores.shape[0])[:, None]
    picked = scores[rows, part]
    order = np.argsort(-picked, axis=1, kind="stable")
    best = part[rows, order]
    tied = np.count_nonzero(scores >= picked.min(axis=1)[:, None], axis=1) > k
    if tied.any():
        best[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    return best


_RESULT = T.StructType([
    T.StructField("top_classes", T.ArrayType(T.StringType())),
    T.StructField("top_scores", T.ArrayType(T.DoubleType())),
    T.StructField("lse", T.DoubleType()),
])


@dataclass(frozen=True)
class StoredPrototypes:
    """Prototypes in the shared folder: class_id, prototype and, if they are per view, view."""

    path: str
    by: str | None
    rows: int


def store_prototypes(prototypes: DataFrame, by: str | None = None) -> StoredPrototypes:
    """Write the table once, sorted by class, for any number of scorings."""
    spark = prototypes.sparkSession
    path = shared_path(spark, "prototypes")
    prototypes.where("class_id is not null and prototype is not null").select(
        "class_id", F.col("prototype").cast("array<double>").alias("prototype"),
        *([by] if by else [])).orderBy("class_id").write.parquet(path)
    return StoredPrototypes(path, by, spark.read.parquet(path).count())


@dataclass(frozen=True)
class _Block:
    names: np.ndarray
    matrix: np.ndarray
    views: dict  # view (None without views) → rows of the block


def _read_blocks(stored: StoredPrototypes, block_bytes: int) -> Iterator[_Block]:
    """The stored table in class order, each block of at most ``block_bytes`` (one row at least)."""
    store, base = fs.FileSystem.from_uri(stored.path)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base))
                   if f.path.endswith(".parquet"))
    for name in files:
        with store.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1024):
                matrix = _matrix(batch.column("prototype"))
                step = max(1, block_bytes // max(8, 8 * matrix.shape[1]))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    views: dict = {None: np.arange(part.num_rows)}
                    if stored.by:
                        codes = part.column(stored.by).dictionary_encode()
                        index = codes.indices.to_numpy(zero_copy_only=False)
                        views = {v: np.flatnonzero(index == i)
                                 for i, v in enumerate(codes.dictionary.to_pylist())}
                    yield _Block(
                        np.asarray(part.column("class_id").to_pylist(), dtype=object),
                        matrix[start:start + step], views)


_CACHE: dict[tuple[str, int], list[_Block]] = {}


def _blocks(stored: StoredPrototypes, block_bytes: int) -> Iterator[_Block]:
    key = (stored.path, block_bytes)
    if key in _CACHE:
        yield from _CACHE[key]
        return
    held: list[_Block] | None = []
    size = 0
    for block in _read_blocks(stored, block_bytes):
        size += block.matrix.nbytes
        if held is not None:
            held = [*held, block] if size <= CACHE_BYTES else None
        yield block
    if held is not None:
        _CACHE.clear()
        _CACHE[key] = held


class _Running:
    """Best k classes, their scores and the log-sum-exp of all scaled scores, per query."""

    def __init__(self, queries: int, k: int, scale: float | None) -> None:
        self.k, self.scale = k, scale
        self.scores = np.full((queries, k), -np.inf)
        self.names = np.full((queries, k), None, dtype=object)
        self.seen = np.zeros(queries, np.int64)
        self.high = np.full(queries, -np.inf)
        self.total = np.zeros(queries)

    def add(self, rows: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        """Scores (rows, classes) of a block; blocks come in class order, so ties keep the first."""
        best = _top(scores, self.k)
        both = np.concatenate((self.scores[rows], np.take_along_axis(scores, best, axis=1)), axis=1)
        labels = np.concatenate((self.names[rows], names[best]), axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :self.k]
        self.scores[rows] = np.take_along_axis(both, order, axis=1)
        self.names[rows] = np.take_along_axis(labels, order, axis=1)
        self.seen[rows] += scores.shape[1]
        if self.scale is not None:
            scaled = scores * self.scale
            high = np.maximum(self.high[rows], scaled.max(axis=1))
            self.total[rows] = self.total[rows] * np.exp(self.high[rows] - high) + np.exp(
                scaled - high[:, None]).sum(axis=1)
            self.high[rows] = high

    def columns(self) -> list[pa.Array]:
        counts = np.minimum(self.seen, self.k)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        filled = np.arange(self.k)[None, :] < counts[:, None]
        known = self.seen > 0 if self.scale is not None else np.zeros(len(counts), bool)
        lse = self.high + np.log(np.where(known, self.total, 1.0))
        return [
            pa.ListArray.from_arrays(offsets, pa.array(self.names[filled].tolist(), pa.string())),
            pa.ListArray.from_arrays(offsets, pa.array(self.scores[filled], pa.float64())),
            pa.array(np.where(known, lse, 0.0), pa.float64(), mask=~known)]


def _score(batch: pa.RecordBatch, stored: StoredPrototypes, k: int, vector: str,
           scale: float | None, block_bytes: int) -> _Running:
    vectors = _matrix(batch.column(vector))
    out = _Running(batch.num_rows, k, scale)
    wanted: dict = {None: np.arange(batch.num_rows)}
    if stored.by:
        codes = batch.column(stored.by).dictionary_encode()
        index = codes.indices.to_numpy(zero_copy_only=False)
        wanted = {v: np.flatnonzero(index == i) for i, v in enumerate(codes.dictionary.to_pylist())}
    for block in _blocks(stored, block_bytes):
        if vectors.shape[1] != block.matrix.shape[1]:
            raise ValueError(f"query dimension {vectors.shape[1]} != {block.matrix.shape[1]}")
        for view, classes in block.views.items():
            rows = wanted.get(view, ())
            step = max(1, _SCORE_CELLS // max(1, len(classes)))
            for start in range(0, len(rows), step):
                some = rows[start:start + step]
                out.add(some, vectors[some] @ block.matrix[classes].T, block.names[classes])
    return out


def _joined(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[pa.RecordBatch]:
    """Batches of up to QUERY_BYTES of vectors: one pass over the prototypes serves each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += 8 * len(batch.column(vector).flatten())
        if size >= QUERY_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def score_top_k(queries: DataFrame, prototypes: DataFrame | StoredPrototypes, k: int,
                vector: str = "embedding", by: str | None = None, scale: float | None = None,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Query columns without the vector, plus ``top_classes``, ``top_scores`` and ``lse``.

    Scores are dot products in double precision, best first, ties by class id. ``by`` limits a
    query to prototypes of the same view; a query without any gets empty lists. ``scale`` fills
    ``lse``, the log-sum-exp over all its classes that a softmax needs. Give stored prototypes to
    score more than once; a frame is written first.
    """
    stored = prototypes if isinstance(prototypes, StoredPrototypes) else store_prototypes(
        prototypes, by)
    if stored.by != by:
        raise ValueError(f"prototypes are stored by {stored.by!r}, not by {by!r}")
    queries = queries.where(F.col(vector).isNotNull())
    keep = [c for c in queries.columns if c != vector]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, vector):
            found = _score(batch, stored, k, vector, scale, block_bytes)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(keep).columns, *found.columns()], names=[*keep, *_RESULT.names])

    schema = T.StructType([queries.schema[c] for c in keep] + _RESULT.fields)
    return queries.mapInArrow(score, schema)


def top_k_rows(scored: DataFrame, scale: float | None = None,
               temperature: float | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per prediction: class_id, score, rank (1 = best) and, if asked, confidence.

    A query without predictions has no row, or one of nulls with ``keep_empty``.
    ``scale`` is the softmax over all classes; ``temperature`` the softmax over the kept ones.
    """
    keep = [c for c in scored.columns if c not in ("top_classes", "top_scores", "lse")]
    if scale is not None:
        confidence = F.transform("top_scores", lambda s: F.exp(s * scale - F.col("lse")))
    elif temperature is not None:
        peak = F.array_max("top_scores")
        weights = F.transform("top_scores", lambda s: F.exp((s - peak) * temperature))
        whole = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
        confidence = F.transform(weights, lambda w: w / whole)
    else:
        confidence = None
    staged = scored if confidence is None else scored.withColumn("_conf", confidence)
    zipped = F.arrays_zip("top_classes", "top_scores", *([] if confidence is None else ["_conf"]))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    rows = staged.select(*keep, explode(zipped).alias("_pos", "_p"))
    return rows.select(
        *keep, F.col("_p.top_classes").alias("class_id"), F.col("_p.top_scores").alias("score"),
        (F.col("_pos") + 1).alias("rank"),
        *([] if confidence is None else [F.col("_p._conf").alias("confidence")]))


def score_vector_argmax(df: DataFrame, scores: str, labels: Iterable[str]) -> DataFrame:
    """Softmax over a row's own score vector: the best label and its probability."""
    names = F.array(*[F.lit(x) for x in labels])
    peak = F.array_max(scores)
    total = F.aggregate(F.col(scores), F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))
    return df.withColumn("label", F.element_at(
        names, F.array_position(scores, peak).cast("int"))).withColumn("probability", 1.0 / total)
