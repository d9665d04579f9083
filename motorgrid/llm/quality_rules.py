"""Quality rules: base word rules and compression bands.

A text that compresses far better than prose repeats itself; one that hardly compresses is noise.
Both depend on length, so the limits are bands over the size: whole documents have one table of
limits, fixed chunks of a long document another, which finds bad stretches inside good text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\\x20\\x09-\\x0D]")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / plain bytes as (bytes from, lowest, highest), by size.

    ``chunk_bytes`` is the size of the fixed chunks; a text fails if more than ``bad_chunks`` of its
    full chunks leave their band. ``level`` is zstandard's.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0), (128, 0.35, 1.2), (256, 0.38, 1.0), (512, 0.32, 0.9), (1024, 0.28, 0.85),
        (4096, 0.24, 0.8), (32768, 0.20, 0.75))
    chunk: tuple[float, float] = (0.20, 0.85)
    chunk_bytes: int = 4096
    bad_chunks: float = 0.25
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        low, high = 0.0, 9.0
        for start, lowest, highest in self.whole:
            if size >= start:
                low, high = lowest, highest
        return low, high


BANDS = Bands()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur at least twice, first occurrence included.

    Windows are ranked exactly: ranks of w words and of the next w words give those of 2 w words.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ranks = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        pairs = ranks[:-size] * (int(ranks.max()) + 1) + ranks[size:]
        _, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        size *= 2
        if counts.max() < 2:
            return 0
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[ranks] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    # bytes.split() cuts at exactly the six ASCII spaces of the word rule.
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif WORD.search(line):
            seen.add(line)
    return (
        len(words), len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS), again, repeated_words(words))


def compression(data: bytes, bands: Bands, compressor: zstandard.ZstdCompressor
                ) -> tuple[float, float]:
    """Ratio of the whole text and share of full chunks outside their band."""
    if not data:
        return 0.0, 0.0
    ratio = len(compressor.compress(data)) / len(data)
    size = bands.chunk_bytes
    full = len(data) // size
    if full < 2:
        return ratio, 0.0
    low, high = bands.chunk
    view = memoryview(data)
    bad = sum(
        not low <= len(compressor.compress(view[i * size:(i + 1) * size])) / size <= high
        for i in range(full))
    return ratio, bad / full


def verdict(size: int, ratio: float, bad_chunks: float, bands: Bands) -> str:
    """'ok' or the rule that fails."""
    low, high = bands.limits(size)
    if size and ratio < low:
        return "repetitive"
    if size and ratio > high:
        return "incompressible"
    return "chunks" if bad_chunks > bands.bad_chunks else "ok"


def _scorer(bands: Bands) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for value in batch.column("_text"):
                text = value.as_py() or ""
                counts = base_counts(text)
                data = text.encode("utf-8", "surrogatepass")
                ratio, bad = compression(data, bands, compressor)
                rule = verdict(len(data), ratio, bad, bands)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                for column, item in zip(out, (
                        *counts, failed, not failed and rule == "ok", ratio, bad, rule)):
                    column.append(item)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in batch.schema.names if n != "_text"]
                + [pa.array(v, t) for v, t in zip(out, (
                    *[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64(),
                    pa.string()))],
                names=[n for n in batch.schema.names if n != "_text"] + [
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "zstd_ratio", "bad_chunks", "rule"])

    return run


_SCORES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, zstd_ratio double, bad_chunks double, rule string")


def quality_scores(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """Counts, compression figures and verdict per row of ``docs`` (doc_id, text).

    Words are runs of anything but the six ASCII spaces. A null text has no words and fails the base
    rules, as does an empty one. Every row is judged on its own, so repeated rows get equal results
    and an empty table gives none; other columns are not looked at.
    """
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(
        _scorer(bands), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCORES}")


def keep_good_texts(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they came; judged in place, no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(bands)
        for batch in batches:
            alone = pa.RecordBatch.from_arrays([batch.column("text")], names=["_text"])
            for scored in score(iter([alone])):
                yield batch.filter(scored.column("kept"))

    return docs.mapInArrow(keep, docs.schema)
