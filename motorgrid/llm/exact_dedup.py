"""Exact dedup by composable polynomial fingerprints.

A text (A-Z lowered, UTF-8) is read as 16-bit units. Its fingerprint is the polynomial of the units
at two bases modulo two primes. Chunks are hashed on their own and combined by shifting: the hash of
``x + y`` is ``hash(x) * base ** units(y) + hash(y)``. So chunks of a huge text are hashed by different
tasks, and a sum per document puts them together. Rows of equal fingerprint are then compared chunk by
chunk with the row that stays; a row that differs in any chunk leaves the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorgrid.llm.common import drop_rows, lower_ascii, settle

PRIMES = (2147483647, 2147483629)
BASES = (1664525013, 1103515245)
CHUNK_BYTES = 1 << 20
_RUN = 1 << 14  # units of one dot product: 2**16 * 2**31 * 2**14 stays below 2**63


@lru_cache(maxsize=8)
def _powers(base: int, prime: int) -> np.ndarray:
    """base ** (_RUN - 1) ... base ** 0."""
    out = np.empty(_RUN, np.uint64)
    value = 1
    for i in range(_RUN - 1, -1, -1):
        out[i] = value
        value = value * base % prime
    return out


def chunk_hash(data: bytes, base: int, prime: int) -> int:
    """Polynomial of the chunk's 16-bit units; an odd last byte is padded with zero."""
    units = np.frombuffer(data + b"\0" * (len(data) % 2), dtype="<u2").astype(np.uint64)
    powers = _powers(base, prime)
    value = 0
    for start in range(0, len(units), _RUN):
        part = units[start:start + _RUN]
        total = int((part * powers[_RUN - len(part):]).sum())
        value = (value * pow(base, len(part), prime) + total) % prime
    return value


def combine(left: int, right: int, right_units: int, base: int, prime: int) -> int:
    """Hash of a concatenation from the hashes of its parts (the left part has even length)."""
    return (left * pow(base, right_units, prime) + right) % prime


def _hasher(primes: tuple[int, int], bases: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            found: list[list[int]] = [[], []]
            for data, total, end in zip(rows["_chunk"], rows["_bytes"], rows["_end"]):
                after = max(0, (total + 1) // 2 - (end + 1) // 2)
                for i in (0, 1):
                    value = chunk_hash(data, bases[i], primes[i])
                    found[i].append(combine(value, 0, after, bases[i], primes[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_sha"), batch.column("_bytes"),
                 pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())],
                names=["doc_id", "_sha", "_bytes", "_a", "_b"])

    return run


def _chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows (doc_id, _sha, _bytes, _end, _no, _chunk); texts over one chunk are spread over tasks."""
    norm = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    staged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), norm.cast("binary").alias("_norm"))
    staged = staged.select(
        "doc_id", "_norm", F.unhex(F.sha2("_norm", 256)).alias("_sha"),
        F.octet_length("_norm").cast("long").alias("_bytes"))
    short = staged.where(F.col("_bytes") <= chunk_bytes).select(
        "doc_id", "_sha", "_bytes", F.col("_bytes").alias("_end"), F.lit(0).cast("long").alias("_no"),
        F.col("_norm").alias("_chunk"))
    last = F.floor((F.col("_bytes") - 1) / chunk_bytes).cast("long")
    long = (
        staged.where(F.col("_bytes") > chunk_bytes)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_no"))
        .select(
            "doc_id", "_sha", "_bytes",
            F.least("_bytes", (F.col("_no") + 1) * chunk_bytes).alias("_end"), "_no",
            F.expr(f"substring(_norm, cast(_no * {chunk_bytes} as int) + 1, {chunk_bytes})")
            .alias("_chunk"))
        .repartition("doc_id", "_no")
    )
    return short.unionByName(long)


def fingerprints(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES,
                 primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES) -> DataFrame:
    """One row per distinct (doc_id, text): _sha, _bytes, the fingerprint _a, _b and _copies.

    ``_copies`` counts the rows that share both doc_id and text.
    """
    hashed = _chunked(docs, chunk_bytes).select(
        "doc_id", "_sha", "_bytes", "_end", "_chunk").mapInArrow(
            _hasher(primes, bases), "doc_id long, _sha binary, _bytes long, _a long, _b long")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("_bytes") / chunk_bytes)).cast("long")
    # Copies of a row repeat each of its chunks, so sums are whole multiples of one row's sum.
    return (
        hashed.groupBy("doc_id", "_sha", "_bytes")
        .agg(F.count("*").alias("_n"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
        .withColumn("_copies", (F.col("_n") / chunks).cast("long"))
        .select(
            "doc_id", "_sha", "_bytes", "_copies",
            (F.expr("_a div _copies") % primes[0]).alias("_a"),
            (F.expr("_b div _copies") % primes[1]).alias("_b"))
    )


_PRINT = ["_bytes", "_a", "_b"]


def _differing(docs: DataFrame, prints: DataFrame, chunk_bytes: int) -> DataFrame:
    """(doc_id, _sha) of rows that differ in a chunk from the largest doc_id of equal fingerprint."""
    # Written first: a join of two plain tables is one whose hot keys AQE can split.
    groups = settle(prints.groupBy(*_PRINT).agg(
        F.max_by(F.struct("doc_id", "_sha"), F.struct("doc_id", "_sha")).alias("_rep"),
        F.count("*").alias("_rows")).where("_rows > 1"), "dedup-shared")
    members = prints.join(groups.hint("merge"), _PRINT).select("doc_id", "_sha", "_rep")
    wanted = members.select(
        F.col("doc_id").alias("_m_id"), F.col("_sha").alias("_m_sha"), "_rep")
    chunks = _chunked(docs, chunk_bytes)
    texts = settle(chunks.join(
        wanted.hint("merge"),
        chunks["doc_id"].eqNullSafe(wanted["_m_id"]) & (chunks["_sha"] == wanted["_m_sha"]),
    ).select("doc_id", "_sha", "_rep", "_no", "_chunk"), "dedup-chunks")
    is_rep = F.col("doc_id").eqNullSafe(F.col("_rep.doc_id")) & (F.col("_sha") == F.col("_rep._sha"))
    # _rep decides: its text's own key, so copies of a hot text meet one short row per chunk.
    kept = texts.where(is_rep).groupBy("_rep", "_no").agg(F.first("_chunk").alias("_kept_chunk"))
    other = texts.where(~is_rep)
    side = kept.select(F.col("_rep").alias("_k_rep"), F.col("_no").alias("_k_no"), "_kept_chunk")
    pairs = other.join(
        side.hint("merge"),
        other["_rep"]["_sha"].eqNullSafe(side["_k_rep"]["_sha"])
        & other["_rep"]["doc_id"].eqNullSafe(side["_k_rep"]["doc_id"])
        & (other["_no"] == side["_k_no"]), "left")
    return pairs.where(~F.col("_chunk").eqNullSafe(F.col("_kept_chunk"))).select(
        "doc_id", "_sha").distinct()


def exact_groups(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES,
                 primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which row of equal texts stays.

    Texts are equal when identical after lowering A-Z; null counts as empty. Of equal texts the row
    with the largest doc_id stays; a null doc_id stays only if no other is there. Rows that repeat
    both doc_id and text come back as often as they came, and one of them is kept. Other columns
    are not looked at; an empty table gives no rows.

    Returns doc_id, keep_id, group_size (rows), kept, text_sha256 (of the lowered text).
    """
    prints = settle(fingerprints(docs, chunk_bytes, primes, bases), "dedup-prints")
    odd = settle(_differing(docs, prints, chunk_bytes), "dedup-differing").select(
        F.col("doc_id").alias("_o_id"), F.col("_sha").alias("_o_sha"))
    # A differing row is grouped by its own digest beside the fingerprint.
    sorted_out = prints.join(
        odd.hint("merge"),
        prints["doc_id"].eqNullSafe(odd["_o_id"]) & (prints["_sha"] == odd["_o_sha"]), "left",
    ).withColumn("_variant", F.col("_o_sha")).select(*prints.columns, "_variant")
    sorted_out = settle(sorted_out, "dedup-sorted")
    groups = settle(sorted_out.groupBy(*_PRINT, "_variant").agg(
        F.max("doc_id").alias("keep_id"),
        F.sum("_copies").alias("group_size")), "dedup-groups")
    named = groups.select(
        *[F.col(c).alias(f"_g{c}") for c in (*_PRINT, "_variant")], "keep_id", "group_size")
    match = F.col("_variant").eqNullSafe(F.col("_g_variant"))
    for c in _PRINT:
        match = match & (F.col(c) == F.col(f"_g{c}"))
    rows = sorted_out.join(named.hint("merge"), match).select(
        "doc_id", "keep_id", "group_size", "_sha",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return rows.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they came.

    A null text counts as empty. The row with the largest doc_id stays, a null doc_id only where there
    is no other; of rows that repeat text and doc_id one stays. An empty table stays empty. The digest
    that rows are matched by gets a name that no column of ``docs`` has.
    """
    found = settle(exact_groups(docs), "dedup-groups")
    digest = F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    taken = {c.lower() for c in docs.columns}
    name = "_text_sha"
    while name in taken or f"_gone_{name}" in taken:
        name += "_"
    marked = docs.withColumn(name, digest)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        "doc_id", F.col("text_sha256").alias(name))
    left = drop_rows(marked, gone, ["doc_id", name])
    repeated = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept"))
    if repeated.take(1):
        left = left.dropDuplicates(["doc_id", name])
    return left.drop(name)
