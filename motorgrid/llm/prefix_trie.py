"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is laid out in blocks of eight turns: one row per block, whose columns t1 to t8 hold the
turns at these positions, keyed by the node that the blocks before lead to. ``GROUP BY node,
ROLLUP(t1 ... t8)`` then aggregates all prefixes of all blocks at once; grouping_id tells how deep a
row is. A node is named by its depth and 120 bits of a sum of hashes of its (position, turn) pairs.
Sums add up along the blocks, so the key of a block comes from running sums, not from the result of the
block before: long conversations take no further rounds.

What concerns subtrees is summed over members, too, so nothing has to climb the tree. A conversation
that is the smallest member of a node is so for all deeper nodes it belongs to. So its first such depth
tells which nodes it stands for, and with it the text that it adds to the trie; the ROLLUP sums that over
the members of every node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motorgrid.llm.common import settle
from motorgrid.operators.skew import cut_by_ranges

# Turns of a block: columns of the ROLLUP.
WIDTH = 8
# Blocks whose sums are windowed together; longer conversations are summed in two steps.
SPAN = 4096
# conv_ids that one piece of a list of ends covers, so a piece has at most as many.
ENDS = 65_536
# Three lanes of 40 bits name a node.
LANES = ("a", "b", "c")
_LANE = 1 << 40
_DIGITS = 10
_TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
NODE = ["depth", *LANES]
_SUMS = [*LANES, "chars"]


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest of (role, text) and code points of the text; null texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"))


def positions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``turns`` with ``pos`` from 1 in order of (turn, digest), null turns first; and (conv_id,
    own), the number of turns."""
    order = [F.col("turn").asc_nulls_first(), "digest"]
    ranged = cut_by_ranges(turns, ["conv_id"], order)
    pieces = ranged.groupBy("conv_id", "_piece").agg(F.count("*").alias("_n"))
    before = W.partitionBy("conv_id").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select("conv_id", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(W.partitionBy("conv_id", "_piece").orderBy(*order))
    placed = ranged.withColumn("_local", local).join(offsets.hint("merge"), ["conv_id", "_piece"])
    return (settle(placed.select("conv_id", "digest", "chars", (F.col("_off") + F.col("_local")).alias(
        "pos")), "trie-turns"), pieces.groupBy("conv_id").agg(F.sum("_n").alias("own")))


def rebuilt(placed: DataFrame, counts: DataFrame, every: int = 100, shares: int = 6
            ) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, chars) of the rebuilt conversations, and (conv_id, n) of all.

    Conversation c begins with the first h turns of conversation c - c % ``every``, all if it has
    fewer and none if there is none, and goes on with its own turns after its first h; h is the
    unsigned crc32 of the decimal c, modulo ``shares``.
    """
    heads = counts.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.col("own").alias("_of"))
    convs = counts.select(
        "conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % shares).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % every).alias("_base")).join(
        heads.hint("merge"), "_base", "left")
    convs = settle(convs.select(
        "conv_id", "_base", "h", F.least("h", F.coalesce("_of", F.lit(0))).alias("shared"),
        F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest")), "trie-conversations")
    # A head is shared by the few conversations of its hundred, and has fewer than ``shares`` turns.
    opening = placed.where((F.col("conv_id") % every == 0) & (F.col("pos") < shares)).withColumnRenamed(
        "conv_id", "_base")
    begun = convs.where("shared > 0").select("conv_id", "_base", "shared").join(
        opening.hint("merge"), "_base").where("pos <= shared")
    gone_on = placed.join(convs.select("conv_id", "h", "shared").hint("merge"), "conv_id").where("pos > h")
    turns = begun.select("conv_id", "pos", "digest", "chars").unionByName(gone_on.select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "digest", "chars"))
    return turns, convs.select("conv_id", (F.col("shared") + F.col("rest")).alias("n"))


def _lanes(pos: Column, digest: Column) -> list[Column]:
    mixed = F.sha2(F.concat(pos.cast("string"), F.lit(":"), digest), 256)
    return [F.conv(F.substring(mixed, 1 + _DIGITS * i, _DIGITS), 16, 10).cast("long").alias(lane)
            for i, lane in enumerate(LANES)]


def _wrapped(sums: dict[str, Column]) -> list[Column]:
    """Sums of lanes are taken modulo the lane's size, so they never overflow."""
    return [(v % _LANE if k in LANES else v).alias(k) for k, v in sums.items()]


def blocks(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, block, ka, kb, kc, kchars, t1 ..., n, total) for the ROLLUP, and (conv_id, n, a,
    b, c, total): the node that a conversation ends in and its code points.

    A conversation without turns has a row of block 0 and no turns.
    """
    spot = turns.select(
        "conv_id", F.floor((F.col("pos") - 1) / WIDTH).alias("block"), F.pmod(
            F.col("pos") - 1, F.lit(WIDTH)).cast("int").alias("at"), *_lanes(F.col("pos"), F.col("digest")),
        "chars").withColumn("span", F.floor(F.col("block") / SPAN))
    laid = settle(spot.groupBy("conv_id", "span", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", F.struct(*_SUMS).alias("t")))).alias("held"),
        *_wrapped({c: F.sum(c) for c in _SUMS})), "trie-blocks")
    spans = laid.groupBy("conv_id", "span").agg(*_wrapped({c: F.sum(c) for c in _SUMS}))
    whole = spans.groupBy("conv_id").agg(*_wrapped({c: F.sum(c) for c in _SUMS}))
    zero = F.lit(0).cast("long")
    ends = settle(sizes.join(whole.hint("merge"), "conv_id", "left").select(
        "conv_id", "n", *[F.coalesce(c, zero).alias(c) for c in LANES],
        F.coalesce("chars", zero).alias("total")), "trie-ends")

    def earlier(columns: list[str], by: list[str], order: str, out: str) -> list[Column]:
        over = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(over), zero).alias(f"{out}{c}") for c in columns]

    offsets = spans.select("conv_id", "span", *earlier(_SUMS, ["conv_id"], "span", "_o"))
    inside = laid.select("conv_id", "span", "block", "held", *earlier(
        _SUMS, ["conv_id", "span"], "block", "_i"))
    keys = _wrapped({c: F.col(f"_o{c}") + F.col(f"_i{c}") for c in _SUMS})
    rows = inside.join(offsets.hint("merge"), ["conv_id", "span"]).select(
        "conv_id", "block", *[k.alias(f"k{c}") for k, c in zip(keys, _SUMS)],
        *[F.get("held", F.lit(i))["t"].alias(t) for i, t in enumerate(_TURNS)])
    nothing = F.lit(None).cast(rows.schema["t1"].dataType)
    silent = ends.where("n = 0").select(
        "conv_id", zero.alias("block"), *[zero.alias(f"k{c}") for c in _SUMS],
        *[nothing.alias(t) for t in _TURNS])
    rows = rows.unionByName(silent).join(ends.select("conv_id", "n", "total").hint("merge"), "conv_id")
    return settle(rows, "trie-rows"), ends


def _prefixes(rows: DataFrame, measures: dict[str, str]) -> DataFrame:
    """One row per node: its name (depth, a, b, c), the name of its parent (pa, pb, pc; one less deep),
    the code points before its last text, that text's, and ``measures``."""
    turns = ", ".join(_TURNS)
    listed = ", ".join(f"{what} AS {name}" for name, what in measures.items())
    rolled = rows.sparkSession.sql(f"""
        SELECT block, ka, kb, kc, kchars, {turns},
            {WIDTH} - bit_count(grouping_id() & {2**WIDTH - 1}) AS level, {listed}
        FROM {{rows}} GROUP BY block, ka, kb, kc, kchars, ROLLUP ({turns})""", rows=rows)
    # A shorter conversation has no turn at the deeper levels; level 0 repeats the block before's last.
    last = F.get(F.array(*_TURNS), (F.col("level") - 1).cast("int"))
    real = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(F.col("last").isNotNull())
    zero = F.lit(0).cast("long")
    made = {c: F.col(f"k{c}") + sum((F.coalesce(F.col(t)[c], zero) for t in _TURNS), zero) for c in _SUMS}
    own = {c: F.coalesce(F.col("last")[c], zero) for c in _SUMS}
    return rolled.withColumn("last", F.when(F.col("level") > 0, last)).where(real).select(
        (F.col("block") * WIDTH + F.col("level")).alias("depth"), *_wrapped(
            {c: made[c] for c in LANES}),
        *[((made[c] - own[c]) % _LANE).alias(f"p{c}") for c in LANES],
        (made["chars"] - own["chars"]).alias("before"), *measures)


_MEMBERS = {"n_convs": "count(*)", "conv_id": "min(conv_id)", "deepest": "max(n)"}
_SUBTREES = {
    **_MEMBERS, "total": "sum(total)", "adds": "sum(adds)", "n_leaves": "sum(leaf)",
    "not_added": "min_by(total - adds, conv_id)"}


def nodes(rows: DataFrame) -> DataFrame:
    """Nodes with conv_id, n_convs, n_leaves and saved_tokens, and their parents' names."""
    first = settle(_prefixes(rows, _MEMBERS), "trie-first")
    # What a conversation adds: all text from the first depth on where it is the smallest member.
    stands = first.groupBy("conv_id").agg(
        F.min_by("before", "depth").alias("_known"),
        F.max((F.col("depth") == F.col("deepest")).cast("int")).alias("leaf"))
    marked = rows.join(stands.hint("merge"), "conv_id", "left").withColumns({
        "adds": F.coalesce(F.col("total") - F.col("_known"), F.lit(0)),
        "leaf": F.coalesce("leaf", F.lit(0))})
    # Of all the members' text from this depth on, less what stays in the trie: what members that are
    # not the smallest add further down, and the smallest member's text from this depth on.
    from_here = F.col("total") - F.col("n_convs") * F.col("before")
    stays = F.col("adds") + F.col("not_added") - F.col("before")
    return settle(_prefixes(marked, _SUBTREES).select(
        *NODE, *[f"p{c}" for c in LANES], "conv_id", "n_convs", "n_leaves",
        (from_here - stays).alias("saved_tokens")), "trie-nodes")


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order; one piece is held at a time."""
    name, state = None, None
    schema = pa.schema([*[(c, pa.int64()) for c in NODE], ("sha", pa.string())])

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**dict(zip(NODE, name)), "sha": state.hexdigest()}], schema)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*NODE, "ids")]
        for *own, ids in zip(*columns):
            if own != name:
                if name is not None:
                    yield row()
                name, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if name is not None:
        yield row()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, sha): SHA-256 of the conv_ids that end in a node, ascending and joined by commas.

    Lists are made in pieces of ENDS consecutive numbers. A node of one piece is hashed on the spot;
    the pieces of a larger one are streamed in order through one hash.
    """
    pieces = ends.select(F.col("n").alias("depth"), *LANES, "conv_id").withColumn(
        "piece", F.floor(F.col("conv_id") / ENDS)).groupBy(*NODE, "piece").agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    pieces = settle(pieces, "trie-pieces")
    count = pieces.groupBy(*NODE).agg(F.count("*").alias("_n"), F.first("ids").alias("_ids"))
    many = settle(count.select(*NODE, "_n", F.when(F.col("_n") == 1, F.sha2(
        F.col("_ids"), 256)).alias("sha")), "trie-single")
    long = pieces.join(many.where("_n > 1").select(*NODE).hint("merge"), NODE).repartition(
        *NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids").mapInArrow(
        _stream_hash, "depth long, a long, b long, c long, sha string")
    return many.where("_n = 1").select(*NODE, "sha").unionByName(long)


EMPTY = hashlib.sha256().hexdigest()


def prefix_trie(turns: DataFrame, rebuild: Callable = rebuilt) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turn, role, text).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256: the
    smallest member, the number of turns, the parent's smallest member, the members, the child nodes,
    the childless nodes of the subtree, the code points that sharing spares in the subtree, and the
    digest of the conv_ids that end here. Turns are ordered by number, null first, equal numbers by a
    digest of role and text. Null roles and texts are empty. Rows without a conv_id are passed over. An
    empty table gives no rows; other columns are not looked at. ``rebuild`` turns (turns, counts) into
    the conversations that the trie is made of.
    """
    made, sizes = rebuild(*positions(turn_digests(turns)))
    rows, ends = blocks(made, sizes)
    tree = nodes(rows)
    parent = [(F.col("depth") - 1).alias("depth"), *[F.col(f"p{c}").alias(c) for c in LANES]]
    children = tree.where("depth > 0").select(*parent).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    above = tree.select((F.col("depth") + 1).alias("depth"), *[F.col(c).alias(f"p{c}") for c in LANES],
                        F.col("conv_id").alias("parent_conv_id"))
    whole = tree.join(children.hint("merge"), NODE, "left").join(
        ends_digests(ends).hint("merge"), NODE, "left").join(
        above.hint("merge"), ["depth", *[f"p{c}" for c in LANES]], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


# crc32 step by step, as DuckDB has no such function: k counts the bits of the i-th character.
SQL = """
WITH RECURSIVE t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(
            length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id::VARCHAR AS s, conv_id - conv_id % 100 AS base, count(*) AS own
      FROM t GROUP BY conv_id),
crc AS (
    SELECT conv_id, s, 1 AS i, 0 AS k, xor(4294967295::BIGINT, ascii(s[1])::BIGINT) AS v FROM c
    UNION ALL
    SELECT conv_id, s, CASE WHEN k = 8 THEN i + 1 ELSE i END, CASE WHEN k = 8 THEN 0 ELSE k + 1 END,
        CASE WHEN k = 8 THEN xor(v, ascii(s[i + 1])::BIGINT)
            WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END
    FROM crc WHERE k < 8 OR i < length(s)),
h AS (
    SELECT c.conv_id, c.base, xor(crc.v, 4294967295::BIGINT) % 6 AS h,
        least(xor(crc.v, 4294967295::BIGINT) % 6, coalesce(b.own, 0)) AS shared
    FROM crc JOIN c USING (conv_id) LEFT JOIN c b ON b.conv_id = c.base
    WHERE crc.k = 8 AND crc.i = length(crc.s)),
r AS (
    SELECT h.conv_id, t.p AS pos, role, text FROM h JOIN t ON t.conv_id = h.base AND t.p <= h.h
    UNION ALL
    SELECT h.conv_id, t.p - h.h + h.shared, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.p > h.h),
q AS (
    SELECT h.conv_id, coalesce(any_value(l.seq), []) AS seq FROM h LEFT JOIN (
        SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS seq FROM r GROUP BY conv_id) l
    USING (conv_id) GROUP BY h.conv_id),
m AS (SELECT conv_id, seq, d AS depth, seq[1:d] AS path FROM (
        SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM q)),
n AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = depth), ''))
            AS ends_sha256
    FROM m GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (
    SELECT n.path, n.depth, k.path IS NULL AS leaf,
        (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE length(n.path[n.depth].text) END AS saved
    FROM n LEFT JOIN k USING (path)),
u AS (
    SELECT path[1:e] AS path, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM v) GROUP BY 1)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
    u.n_leaves, u.saved_tokens, n.ends_sha256
FROM n JOIN u USING (path) LEFT JOIN k USING (path)
LEFT JOIN n a ON n.depth > 0 AND a.path = n.path[1:n.depth - 1]
"""
