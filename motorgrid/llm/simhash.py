"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through vantage-point trees.

The top of the tree is built from a bounded sample and sends fingerprints to shards; a shard is
searched by one task with a tree of its own. Fingerprints near a boundary visit the neighbour shard as
guests, so no pair is lost. A task returns one link per fingerprint that it can join to another, not
all pairs; contraction then gives the components over all shards.

Near copies (fingerprints within a wide reach and similar shingle sets) meet in other shards, as a wide reach
visits nearly all of the tree: a shard is a shingle, and a set visits those of its rarest shingles that are so
many that two similar sets have one in common.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorgrid.llm.common import drop_rows, regroup, settle
from motorgrid.llm.components import components
from motorgrid.llm.vptree import Classes, Nearest, build_tree, route, search

SEED = 42
HASHES = 1 << 30
WORDS = 4
REACH = 4
# Fingerprints that the top tree is fitted on; it decides only how evenly the shards are filled.
SAMPLE = 65_536
# Levels of the top tree, the same at every size: each level sends boundary fingerprints both ways, so
# a deeper tree would make more visits per fingerprint.
LEVELS = 6
# Visits to one task; a fuller shard is cut into slices and every two slices meet in a task.
TASK_ROWS = 2_000_000
# Shingles of the sets that one task compares, cut in the same way.
TASK_ITEMS = 8_000_000
_PAIRS = 4096
ROUTED_ROWS = 1 << 16
# Documents whose shingles are counted, and the most shingles that are taken from them as frequent ones.
COUNTED = 8_192
FREQUENT = 65_536
# Rows of a shard of near copies that are compared without a tree, and rows of the shards in one task.
SHORT = 64
BUCKET_ROWS = 1 << 12
_HASHES = 1 << 16


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of ``text``, A-Z lowered; none without words."""
    # bytes.lower() changes A-Z only and bytes.split() cuts at the six ASCII spaces.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    count = max(1, len(parts) - words + 1)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:count].tolist()
    stops = ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, count)


def majority(hashes: np.ndarray) -> int:
    """SimHash of ``hashes``: the bits that more than half of them have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES):
        ones += np.unpackbits(hashes[at:at + _HASHES].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the shingles of ``text``, A-Z lowered; 0 without words."""
    return majority(shingle_hashes(text, words))


def _printer(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(
                (fingerprint(t.as_py(), words) for t in batch.column("_text")), np.uint64,
                batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) per row of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")
                       ).mapInArrow(_printer(words), "doc_id long, fp long")


def _router(splits: list, depth: int, reach: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches, ROUTED_ROWS):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            rows, leaf, guest = route(fp, splits, depth, reach)
            picked = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [*[c.take(picked) for c in batch.columns], pa.array(leaf.astype(np.int32)),
                 pa.array(guest)], names=[*batch.schema.names, "leaf", "guest"])

    return run


def _linker(reach: int) -> Callable:
    def run(shard: pa.Table) -> pa.Table:
        fp = shard.column("fp").to_numpy().view(np.uint64)
        node = shard.column("node").to_numpy()
        classes = Classes(len(fp))
        search(fp, shard.column("guest").to_numpy(zero_copy_only=False), reach, classes)
        joined = np.flatnonzero(classes.label != np.arange(len(fp)))
        return pa.table({"src": node[joined], "dst": node[classes.label[joined]]})

    return run


def _nearest(reach: int) -> Callable:
    def run(shard: pa.Table) -> pa.Table:
        fp = shard.column("fp").to_numpy().view(np.uint64)
        node = shard.column("node").to_numpy()
        best = Nearest(fp, node)
        search(fp, shard.column("guest").to_numpy(zero_copy_only=False), reach, best)
        has = np.flatnonzero(best.bits <= reach)
        return pa.table({"node": node[has], "near": best.near[has], "bits": best.bits[has]})

    return run


class _Open:
    """Rows that have a linked row of another group, of a size that allows ``similarity``; links are of rows from
    ``base`` on."""

    def __init__(self, group: np.ndarray, size: np.ndarray, similarity: float) -> None:
        self.group, self.size, self.similarity = group, size, similarity
        self.classes, self.base = Classes(len(group)), 0
        self.open = np.zeros(len(group), bool)

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small = np.minimum(self.size[left], self.size[right])
        large = np.maximum(self.size[left], self.size[right])
        fits = (self.group[left] != self.group[right]) & (small >= self.similarity * large)
        return left[fits], right[fits]

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        left, right = self._fitting(left + self.base, right + self.base)
        self.open[left] = self.open[right] = True
        self.classes.link(left, right)


class _Similar(_Open):
    """Joins linked rows whose shingle sets are ``similarity`` alike; ``group`` is the class so far."""

    def __init__(self, group: np.ndarray, size: np.ndarray, similarity: float,
                 sets: pa.ListArray) -> None:
        first, own = np.unique(group, return_index=True)[1], np.unique(group, return_inverse=True)[1]
        super().__init__(first[own], size, similarity)
        self.classes.label = self.group
        # Numbers in place of hashes, so that a set can be marked in a table.
        self.starts = sets.offsets.to_numpy()
        self.items = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        self.starts = self.starts - self.starts[0]
        self.marks = np.zeros(int(self.items.max(initial=0)) + 1, bool)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        left, right = self._fitting(left, right)
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        cuts = np.flatnonzero(np.diff(left)) + 1
        for row, others in zip(left[np.concatenate(([0], cuts))] if len(left) else (),
                               np.split(right, cuts)):
            # Pairs that an earlier link has joined meanwhile add nothing.
            others = others[self.group[others] != self.group[row]]
            if not len(others):
                continue
            own = self.items[self.starts[row]:self.starts[row + 1]]
            self.marks[own] = True
            for at in range(0, len(others), _PAIRS):
                some = others[at:at + _PAIRS]
                sizes = self.size[some]
                spots = np.repeat(self.starts[some] - np.cumsum(sizes) + sizes, sizes)
                hits = self.marks[self.items[spots + np.arange(len(spots))]]
                both = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
                alike = some[both >= self.similarity * (len(own) + sizes - both)]
                self.classes.link(np.full(len(alike), row), alike)
            self.marks[own] = False


def _opener(reach: int, similarity: float) -> Callable:
    """Rows with a pair left to compare; ``leaf`` is the smallest node that such pairs of a shard lead to."""
    def run(shards: pa.Table) -> pa.Table:
        shards = shards.sort_by([("leaf", "ascending"), ("node", "ascending")])
        leaf, node, group, size = (shards.column(c).to_numpy() for c in ("leaf", "node", "group", "size"))
        fp = shards.column("fp").to_numpy().view(np.uint64)
        found = _Open(group, size, similarity)
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(leaf)]))
        for found.base, end in zip(*(x[ends - starts > SHORT].tolist() for x in (starts, ends))):
            part = fp[found.base:end]
            search(part, np.zeros(len(part), bool), reach, found)
        found.base = 0
        last = np.repeat(np.where(ends - starts > SHORT, 0, ends), ends - starts)
        left, step = np.flatnonzero(last), 1
        while len(left := left[left + step < last[left]]):
            near = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= reach]
            found.link(near, near + step)
            step += 1
        kept = shards.filter(pa.array(found.open)).select(["fp", "node", "group", "size"])
        return kept.append_column("leaf", pa.array(node[found.classes.label[found.open]]))

    return run


def _joiner(reach: int, similarity: float) -> Callable:
    """Links that join rows of a shard by comparing their sets, at most one per row."""
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        node = shard.column("node").to_numpy()
        sets = shard.column("shingles").combine_chunks()
        joined = _Similar(shard.column("group").to_numpy(), np.diff(sets.offsets.to_numpy()),
                          similarity, sets)
        before = joined.group.copy()
        search(shard.column("fp").to_numpy().view(np.uint64), np.zeros(len(node), bool), reach, joined)
        moved = np.flatnonzero(joined.group != before)
        return pa.table({"src": node[moved], "dst": node[joined.group[moved]]})

    return run


def similar_links(visits: DataFrame, sets: Callable[[DataFrame], DataFrame], reach: int, similarity: float,
                  task_rows: int = TASK_ROWS, task_items: int = TASK_ITEMS) -> DataFrame:
    """Links (src, dst) that join, beyond their groups, all nodes of a shard within ``reach`` bits whose shingle
    sets are ``similarity`` alike; ``visits`` has leaf (the shard), fp, node, group and size, all long.

    A first search finds the nodes that have a pair of unlike groups whose sizes allow it. Shards that
    find the same nodes become one by the smallest of these. Only they get their sets (``sets`` makes them
    for given nodes) and are searched again; pairs are compared inside the task, which returns links that
    join classes and never a pair.
    """
    full = visits.groupBy("leaf").count().where(F.col("count") > task_rows).collect()
    met = _in_slices(visits, {r["leaf"]: -(-r["count"] // (task_rows // 2)) for r in full})
    buckets = 1 + visits.count() // BUCKET_ROWS
    met = met.withColumn("_bucket", F.pmod(F.xxhash64("leaf"), F.lit(buckets)))
    left = settle(met.groupBy("_bucket", "_low", "_high").applyInArrow(
        _opener(reach, similarity), "fp long, node long, group long, size long, leaf long").distinct(), "near-open")
    whole = sets(left.select("node").distinct())
    full = left.groupBy("leaf").agg(F.sum("size").alias("n")).where(F.col("n") > task_items).collect()
    met = _in_slices(left, {r["leaf"]: -(-r["n"] // (task_items // 2)) for r in full})
    return met.join(whole.hint("merge"), "node").groupBy("leaf", "_low", "_high").applyInArrow(
        _joiner(reach, similarity), "src long, dst long")


def links(prints: DataFrame, reach: int = REACH, sample: int = SAMPLE,
          depth: int = LEVELS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (src, dst) that join all ``prints`` (fp, node; fp distinct) within ``reach`` bits.

    The links connect just the fingerprints that a chain of pairs within ``reach`` connects; pairs
    that add nothing to that are left out.
    """
    return _in_shards(prints, reach, sample, depth, task_rows, _linker(reach), "src long, dst long")


def nearest_smaller(prints: DataFrame, reach: int, sample: int = SAMPLE, depth: int = LEVELS,
                    task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, near) for each of ``prints`` (fp, node) that has a smaller node within ``reach`` bits: the one of
    fewest differing bits, then the smallest."""
    found = _in_shards(prints, reach, sample, depth, task_rows, _nearest(reach),
                       "node long, near long, bits int")
    return found.groupBy("node").agg(F.min_by("near", F.struct("bits", "near")).alias("near"))


def _in_shards(prints: DataFrame, reach: int, sample: int, depth: int, task_rows: int,
               work: Callable, schema: str) -> DataFrame:
    """``work`` over every shard (guest and the columns of ``prints``) of ``prints`` (fp, node and
    others, all long)."""
    # Thinned by a hash first, so that no task sends more than its share of the sample.
    share = min(1.0, sample / max(1, prints.count()))
    thin = prints.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(HASHES)) < int(HASHES * share))
    chosen = thin.orderBy(F.xxhash64("fp"), "fp").limit(sample)
    picked = [r[0] for r in chosen.collect()]
    splits = build_tree(np.array(picked, np.int64).view(np.uint64), depth)
    carried = ", ".join(f"{c} long" for c in prints.columns)
    visits = settle(prints.mapInArrow(
        _router(splits, depth, reach), f"{carried}, leaf int, guest boolean"), "visits")
    full = visits.groupBy("leaf").count().where(F.col("count") > task_rows).collect()
    spread = _in_slices(visits, {r["leaf"]: -(-r["count"] // (task_rows // 2)) for r in full})
    return spread.select(*prints.columns, "guest", "leaf", "_low", "_high").groupBy(
        "leaf", "_low", "_high").applyInArrow(work, schema)


def _in_slices(visits: DataFrame, slices: dict[int, int]) -> DataFrame:
    """``visits`` with ``_low`` and ``_high``: the rows of slice s meet those of every slice t in task
    (min, max), and each other in (s, s). Shards without an entry are one slice."""
    counts = visits.sparkSession.createDataFrame(list(slices.items()), "leaf long, _slices long")
    spread = visits.join(counts, "leaf", "left").withColumn(
        "_slices", F.coalesce("_slices", F.lit(1).cast("long")))
    spread = spread.withColumn("_s", F.pmod(F.xxhash64("fp"), F.col("_slices"))).withColumn(
        "_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
    return spread.select(*visits.columns, F.least("_s", "_t").alias("_low"),
                         F.greatest("_s", "_t").alias("_high"))


def near_groups(docs: DataFrame, words: int = WORDS, reach: int = REACH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row of ``docs`` (doc_id, text).

    Fingerprints within ``reach`` bits are linked; component_id is the smallest doc_id reachable. A
    text without words (null, empty, only spaces) has fingerprint zero and is linked like any other.
    Rows of equal fingerprint are one node, so copies and repeated rows cost nothing more. A null
    doc_id is passed over as a name; if a component has no other, its component_id is null. An empty
    table gives no rows; other columns are not looked at.
    """
    prints = settle(fingerprints(docs, words), "prints")
    # A node is named by its smallest doc_id; those without any get names above all others.
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    top = (prints.agg(F.max("doc_id")).first()[0] or 0) + 1
    nodes = settle(nodes.select("fp", F.coalesce(
        "low", F.lit(top) + F.monotonically_increasing_id()).alias("node")), "nodes")
    found = components(links(nodes, reach))
    named = nodes.join(found, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component"))
    named = named.select("fp", F.when(F.col("component") < top, F.col("component")).alias(
        "component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rarest(shingles: np.ndarray, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rarest of ``shingles`` (a set, ascending), so many that two sets of ``similarity`` have one in common.

    Two such sets share at least similarity * size shingles of either. So in any order that holds for all
    sets, the first size - similarity * size + 1 of both have one in common. The order here: shingles that
    are not in ``frequent`` (ascending) by hash, then those of ``frequent`` by ``rank``.
    """
    count = len(shingles) + 1 - max(1, math.ceil(similarity * len(shingles) - 1e-6))
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    known = frequent[at] == shingles if len(frequent) else np.zeros(len(shingles), bool)
    late = at[known]
    return np.concatenate((shingles[~known], frequent[late[np.argsort(rank[late])]]))[:count]


def _set_prints(words: int, whole: bool, rare: Callable | None = None) -> Callable:
    """doc_id, sig (digest of the shingle set), and the set itself, or fp and size of the set and what ``rare``
    takes of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, prints, sizes, sets = [], [], [], []
            for text in batch.column("_text"):
                hashes = shingle_hashes(text.as_py(), words)
                found = np.unique(hashes)
                sigs.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                if not whole:
                    prints.append(majority(hashes))
                if whole or rare:
                    sets.append((found if whole else rare(found)).view(np.int64))
            columns = {"doc_id": batch.column("doc_id"), "sig": pa.array(sigs, pa.binary())}
            if not whole:
                columns |= {"fp": pa.array(np.array(prints, np.uint64).view(np.int64)),
                            "size": pa.array(sizes, pa.int64())}
            if whole or rare:
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                columns["shingles" if whole else "rare"] = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _by_rarity(texts: DataFrame, words: int, similarity: float) -> Callable:
    """``rarest`` with the frequent shingles of a bounded sample of ``texts``; the sample decides only how many rows
    meet in a shard."""
    share = min(1.0, COUNTED / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < int(HASHES * share))
    counts = some.mapInArrow(
        _set_prints(words, True), "doc_id long, sig binary, shingles array<long>").select(
        F.explode("shingles").alias("s")).groupBy("s").count().where("count > 2")
    often = [r["s"] for r in counts.orderBy(F.desc("count"), "s").limit(FREQUENT).collect()]
    frequent = np.array(often[::-1], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    return functools.partial(rarest, similarity=similarity, frequent=frequent[order], rank=order)


def near_copies(docs: DataFrame, words: int, reach: int, similarity: float, every_pair: bool = False,
                task_rows: int = TASK_ROWS, task_items: int = TASK_ITEMS) -> DataFrame:
    """(doc_id, keep_id) of documents to drop: each is linked to one that stays by similar texts.

    With ``every_pair`` all pairs of documents whose fingerprints differ in at most ``reach`` bits are
    linked if their shingle sets have a Jaccard similarity of ``similarity`` (above 0) or more; of each
    group that links connect the smallest doc_id stays. Equal sets are one node. Nodes meet in the shards
    of their rarest shingles (see ``rarest``), so no similar pair is lost. Each node is first compared with
    the smallest one of most of its shards; then all pairs that those links do not connect already are
    (see ``similar_links``), so a group of copies costs about a link each. Of several texts of one
    doc_id one decides. Without ``every_pair`` a node is compared with its nearest smaller one only, which
    misses similar pairs.
    """
    texts = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    schema = "doc_id long, sig binary, fp long, size long"
    if every_pair:
        rows = settle(texts.mapInArrow(_set_prints(words, False, _by_rarity(texts, words, similarity)),
                                       f"{schema}, rare array<long>"), "near-rows")
    else:
        rows = texts.mapInArrow(_set_prints(words, False), schema)
    prints = settle(rows.groupBy("doc_id").agg(
        F.max(F.struct("sig", "fp", "size")).alias("p")).select("doc_id", "p.*"), "near-prints")
    nodes = settle(prints.groupBy("sig").agg(
        F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("size").alias("size")),
        "near-nodes")
    equal = prints.join(nodes.select("sig", "node").hint("merge"), "sig").where("doc_id <> node").select(
        F.col("doc_id").alias("src"), F.col("node").alias("dst"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        # Only the sets that are needed are made and written.
        return settle(texts.join(wanted.hint("merge"), "doc_id").mapInArrow(
            _set_prints(words, True), "doc_id long, sig binary, shingles array<long>").groupBy(
            "doc_id").agg(F.max_by("shingles", "sig").alias("shingles")), "near-sets")

    def alike(pairs: DataFrame) -> DataFrame:
        sets = sets_of(settle(pairs.select("doc_id").unionByName(
            pairs.select(F.col("near").alias("doc_id"))).distinct(), "near-wanted"))
        theirs = sets.select(F.col("doc_id").alias("near"), F.col("shingles").alias("_theirs"))
        # Many copies may point at one document: AQE splits their side of this join.
        met = pairs.join(sets.hint("merge"), "doc_id").join(theirs.hint("merge"), "near")
        both = F.size(F.array_intersect("shingles", "_theirs"))
        either = F.size("shingles") + F.size("_theirs") - both
        return settle(met.where((either == 0) | (both >= similarity * either)).select(
            F.col("doc_id").alias("src"), F.col("near").alias("dst")), "near-alike")

    if every_pair:
        shard = Window.partitionBy("leaf")
        # Shards of a single document, nearly all of them, end here.
        shared = settle(rows.select(F.col("doc_id").alias("node"), F.explode("rare").alias("leaf")).select(
            "leaf", "node", F.min("node").over(shard).alias("low"), F.max("node").over(shard).alias("_high")).where(
            "low < _high").drop("_high"), "near-shared")
        votes = shared.where("low < node").groupBy("node", "low").count()
        near = votes.groupBy("node").agg(F.max_by("low", F.struct("count", -F.col("low"))).alias("near"))
        theirs = nodes.select(F.col("node").alias("near"), F.col("fp").alias("_fp"))
        found = alike(settle(near.join(nodes.hint("merge"), "node").join(theirs.hint("merge"), "near").where(
            F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp"))) <= reach).select(
            F.col("node").alias("doc_id"), "near"), "near-pairs"))
        groups = components(found).select("node", F.col("component").alias("group"))
        grouped = nodes.join(groups.hint("merge"), "node", "left").select(
            "fp", "node", F.coalesce("group", "node").alias("group"), "size")
        visits = settle(shared.select("leaf", "node").join(grouped.hint("merge"), "node").select(
            "leaf", "fp", "node", "group", "size", F.min("group").over(shard).alias("_low"),
            F.max("group").over(shard).alias("_high")).where("_low < _high").drop("_low", "_high"), "near-visits")
        rest = similar_links(
            visits, lambda wanted: sets_of(wanted.select(F.col("node").alias("doc_id"))).select(
                F.col("doc_id").alias("node"), "shingles"), reach, similarity, task_rows, task_items)
        found = found.unionByName(settle(rest, "near-rest"))
    else:
        found = alike(settle(nearest_smaller(nodes.select("fp", "node"), reach).select(
            F.col("node").alias("doc_id"), "near"), "near-pairs"))
    return components(found.unionByName(equal)).where("node <> component").select(
        F.col("node").alias("doc_id"), F.col("component").alias("keep_id"))


def drop_near_copies(docs: DataFrame, words: int, reach: int, similarity: float,
                     every_pair: bool = False) -> DataFrame:
    """``docs`` without the near copies of documents that stay, see ``near_copies``.

    Documents are told apart by doc_id; rows without a doc_id always stay. Two texts without words
    are equal.
    """
    return drop_rows(docs, near_copies(docs, words, reach, similarity, every_pair), ["doc_id"])
