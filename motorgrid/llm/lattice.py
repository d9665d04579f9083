"""Embedding near-dedup by lattice hashing: random projections decoded to points of the E8 lattice.

A table projects a unit vector to eight random directions, divides by a cell width, shifts by a random
offset and takes the nearest E8 point as the home cell; the nearest of that point's 240 neighbours are
probed as well. A pair is a candidate where the home of one is the home or a probe of the other in some
table. Every candidate is verified by its cosine in double precision.

Every vector carries the cells of all tables, so a task can tell where else a pair meets and counts it
in the first such place only: no pair is written. A task returns one row per linked vector: its number
of links and the smallest vector that it is joined to there.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorgrid.llm.common import settle
from motorgrid.llm.components import components
from motorgrid.llm.vectors import by_dimension, unit_rows
from motorgrid.llm.vptree import Classes

SEED = 42
SIMILARITY = 0.95
# At a cosine of just 0.95 a pair meets in 68 % of the tables, at 0.97 in 85 %, so five tables find
# 99.7 % and 99.99 %; a random pair shares a cell about once in 20,000.
TABLES = 5
PROBES = 4
WIDTH = 1.2
# Rows of one task; a fuller cell is cut into slices and every two slices meet in a task.
TASK_ROWS = 32_768
_GRAM = 1 << 21


@functools.cache
def shortest() -> np.ndarray:
    """The 240 shortest E8 vectors: two coordinates of ±1, or eight of ±1/2 with even minus signs."""
    signs = np.array(list(itertools.product((1.0, -1.0), repeat=8)))
    halves = signs[(signs < 0).sum(axis=1) % 2 == 0] / 2
    pairs = [(i, j) for i in range(8) for j in range(i)]
    ones = np.zeros((4 * len(pairs), 8))
    for at, ((i, j), a, b) in enumerate(itertools.product(pairs, (1, -1), (1, -1))):
        ones[at, i], ones[at, j] = a, b
    return np.concatenate([ones, halves])


def _even_sum(points: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(points)
    wrong = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    error = points[wrong] - near[wrong]
    # An odd sum is mended where the rounding was closest to going the other way.
    worst = np.abs(error).argmax(axis=1)
    near[wrong, worst] += np.where(error[np.arange(len(wrong)), worst] < 0, -1.0, 1.0)
    return near


def nearest_points(points: np.ndarray) -> np.ndarray:
    """The nearest E8 point of every row: whole coordinates of even sum, or the same plus 1/2."""
    whole, half = _even_sum(points), _even_sum(points - 0.5) + 0.5
    closer = ((points - half) ** 2).sum(axis=1) < ((points - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def _names(points: np.ndarray) -> np.ndarray:
    """32-bit cell names of lattice points (..., 8); points that share a name share a cell."""
    doubled = np.rint(2 * points).astype(np.int64).astype(np.uint64)
    name = np.full(points.shape[:-1], SEED, np.uint64)
    for axis in range(8):
        name = (name ^ doubled[..., axis]) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return (name >> np.uint64(32)).astype(np.uint32).view(np.int32)


def cells_of(units: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH
             ) -> np.ndarray:
    """(rows, tables, 1 + probes) cell names, the home cell first."""
    out = np.empty((len(units), tables, 1 + probes), np.int32)
    for t in range(tables):
        rng = np.random.default_rng([SEED, t, units.shape[1]])
        points = units @ rng.normal(size=(units.shape[1], 8)) / width + rng.uniform(0, 2, 8)
        home = nearest_points(points)
        closeness = (points - home) @ shortest().T
        order = np.argsort(-closeness, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _names(home)
        out[:, t, 1:] = _names(home[:, None, :] + shortest()[order])
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and a digest of the numbers of its vector; null where there is no direction."""
    for batch in batches:
        found: list = [None] * batch.num_rows
        for rows, matrix in by_dimension(batch.column("_vector")):
            good, _ = unit_rows(matrix)
            for i in good:
                numbers = (matrix[i] + 0.0).tobytes()
                found[rows[i]] = hashlib.blake2b(numbers, digest_size=16).digest()
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(found, pa.binary()), batch.column("_vector")],
            names=["vec_id", "digest", "_vector"])


def _hasher(tables: int, probes: int, width: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list = [None] * batch.num_rows
            for rows, matrix in by_dimension(batch.column("_vector")):
                names = cells_of(unit_rows(matrix)[1], tables, probes, width)
                for row, own in zip(rows, names):
                    cells[row] = own.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"), batch.column("_vector"),
                 pa.array(cells, pa.binary())], names=["node", "copies", "_vector", "cells"])

    return run


def _visitor(tables: int, probes: int) -> Callable:
    """One slim row per vector, table and cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = tables * (1 + probes)
        for batch in batches:
            n = batch.num_rows
            cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.int32)
            place = np.tile(np.arange(each), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(np.repeat(np.arange(n), each))),
                 batch.column("dim").take(pa.array(np.repeat(np.arange(n), each))),
                 pa.array((place // (1 + probes)).astype(np.int32)), pa.array(cells),
                 pa.array(place % (1 + probes) == 0)], names=["node", "dim", "tab", "cell", "home"])

    return run


def first_meeting(left: np.ndarray, right: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether pairs with cells ``left`` and ``right`` (pairs, tables, cells) meet first in this cell."""
    home_l, home_r = left[:, :, 0], right[:, :, 0]
    at_right = (left == home_r[:, :, None]).any(axis=2)  # the left one comes to the right one's home
    at_left = (right == home_l[:, :, None]).any(axis=2)
    earlier = (at_left[:, :table] | at_right[:, :table]).any(axis=1)
    # In one table they may meet in both homes: the smaller one counts.
    a, b = home_l[:, table], home_r[:, table]
    both = at_left[:, table] & at_right[:, table]
    own = np.where(both, np.minimum(a, b), np.where(at_left[:, table], a, b))
    return ~earlier & (own == cell)


def _linker(tables: int, probes: int, similarity: float) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        table, cell, low, high = (x.as_py() for x in key[1:])
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        home = rows.column("home").to_numpy(zero_copy_only=False)
        slice_ = rows.column("slice").to_numpy()
        cells = np.frombuffer(
            b"".join(rows.column("cells").to_pylist()), np.int32).reshape(len(node), tables, 1 + probes)
        units = next(unit_rows(m)[1] for _, m in by_dimension(rows.column("_vector")))
        links, classes = np.zeros(len(node), np.int64), Classes(len(node))
        # Rows of one slice meet in the task (slice, slice), those of two slices in theirs.
        a, b = np.flatnonzero(slice_ == low), np.flatnonzero(slice_ == high)
        step = max(1, _GRAM // max(1, len(b)))
        for start in range(0, len(a), step):
            some = a[start:start + step]
            x, y = np.divmod(np.flatnonzero(units[some] @ units[b].T >= similarity), max(1, len(b)))
            x, y = some[x], b[y]
            open_ = (home[x] | home[y]) & ((x < y) | (low != high))
            x, y = x[open_], y[open_]
            for at in range(0, len(x), _GRAM // 16):
                p, q = x[at:at + _GRAM // 16], y[at:at + _GRAM // 16]
                own = first_meeting(cells[p], cells[q], table, cell)
                p, q = p[own], q[own]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                classes.link(p, q)
        linked = np.flatnonzero(links)
        return pa.table({"node": node[linked], "links": links[linked],
                         "up": _smallest(node, classes.label)[linked]})

    return run


def _smallest(node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest node of each row's class."""
    low = node.copy()
    np.minimum.at(low, label, node)
    return low[label]


def linked_nodes(nodes: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES,
                 probes: int = PROBES, width: float = WIDTH, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, links, up), some rows per node of ``nodes`` (node, copies, _vector; vectors distinct).

    The sum of links is the number of copies behind the nodes that are linked directly; (node, up)
    are edges that connect just what the links connect.
    """
    hashed = settle(nodes.mapInArrow(
        _hasher(tables, probes, width),
        f"node long, copies long, _vector {nodes.schema['_vector'].dataType.simpleString()}, "
        "cells binary"), "lattice-cells")
    visits = settle(hashed.select("node", F.size("_vector").alias("dim"), "cells").mapInArrow(
        _visitor(tables, probes), "node long, dim int, tab int, cell int, home boolean"),
        "lattice-visits")
    # A cell without a member, or with one row, holds no pair.
    filled = visits.groupBy("dim", "tab", "cell").agg(
        F.count("*").alias("_rows"), F.max("home").alias("_has")).where("_has and _rows > 1").select(
        "dim", "tab", "cell", F.ceil(F.col("_rows") / F.lit(task_rows // 2)).cast("int").alias("_n"))
    met = visits.join(filled.hint("merge"), ["dim", "tab", "cell"])
    met = met.withColumn("_n", F.when(F.col("_n") <= 2, 1).otherwise(F.col("_n"))).withColumn(
        "slice", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    # Slice s meets every slice t in the task (min, max).
    met = met.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        "node", "dim", "tab", "cell", F.least("slice", "_t").alias("_low"),
        F.greatest("slice", "_t").alias("_high"), "home", "slice")
    return met.join(hashed.hint("merge"), "node").groupBy(
        "dim", "tab", "cell", "_low", "_high").applyInArrow(
        _linker(tables, probes, similarity), "node long, links long, up long")


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, vector: str = "embedding",
                 tables: int = TABLES, probes: int = PROBES, width: float = WIDTH,
                 task_rows: int = TASK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept per row of ``vectors`` (vec_id, ``vector``).

    Two vectors of one length are linked if their cosine is ``similarity`` or more and they share a
    cell; n_links counts the other rows that a row is linked to, component_id is the smallest vec_id
    that links reach, kept tells whether it is the row's own. Rows of equal numbers are one node:
    they are linked to each other and to what any of them is linked to. Vectors that are null, empty,
    zero, or hold null or a non-finite number are linked with nothing, and so are rows without a
    vec_id, whose component is null and which are not kept. Rows that repeat a vec_id count as rows
    of their own. An empty table gives no rows; other columns are not looked at.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("_vector"))
    keyed = settle(rows.mapInArrow(
        _digests, f"vec_id long, digest binary, _vector {kind}"), "lattice-rows")
    usable = keyed.where("digest is not null and vec_id is not null")
    # Nodes have names of their own, as rows may repeat a vec_id; written, so that the names stay.
    nodes = settle(usable.groupBy("digest").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("copies"),
        F.first("_vector").alias("_vector")).withColumn("node", F.monotonically_increasing_id()),
        "lattice-nodes")
    found = settle(linked_nodes(nodes.select("node", "copies", "_vector"), similarity, tables, probes,
                                width, task_rows), "lattice-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("src"), F.col("up").alias("dst")))
    named = settle(nodes.select("digest", "node", "low", "copies").join(
        links.hint("merge"), "node", "left").join(joined.hint("merge"), "node", "left").select(
        "digest", "low", F.coalesce("component", "node").alias("component"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links")), "lattice-named")
    lowest = named.groupBy("component").agg(F.min("low").alias("_low"))
    named = named.join(lowest.hint("merge"), "component").select("digest", "_links", "_low")
    own = F.when(F.col("vec_id").isNotNull(), F.col("digest"))
    component = F.coalesce("_low", "vec_id")
    return keyed.select("vec_id", own.alias("digest")).join(
        named.hint("merge"), "digest", "left").select(
        "vec_id", F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
