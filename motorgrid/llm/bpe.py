"""BPE encoding and decoding over a contiguous array of ranks.

A short word is held as its part boundaries, the part ids and the ranks of adjacent pairs. The smallest
rank is found by a scan, the boundary between its parts is deleted, and the ranks beside the merged part
are looked up again. Long words take a heap over linked parts, which merges in the same order without
scanning again for each merge. Results of chunks between white space are remembered per task process.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Words of more parts than this are merged with a heap.
SHORT_WORD = 48
# Chunks remembered per process: a full table becomes the older one, which is then forgotten.
MEMORY = 300_000
NONE = 1 << 30
# From here on letter classes are asked of the library.
KNOWN_LETTERS = "\u0530"
# The word pattern and white space of this tokenizer family.
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
_SPLIT = re.compile(f"[{SPACE}]+")
# str.split() also cuts at these four, which are ordinary characters here.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = array("l", (vocab[a + b] for a, b in pairs))
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.pieces = regex.compile(PIECES)
        self.cut = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.letter = {c: b for b, c in enumerate(letters)}
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def word(self, data: bytes) -> list[int]:
        """Ids of one word of the pattern, in UTF-8."""
        ids = list(map(self.inner.__getitem__, data))
        ids[-1] = self.last[data[-1]]
        return self._scan(ids) if len(ids) <= SHORT_WORD else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        rank, merged = self.rank.get, self.merged
        bounds = list(range(len(ids) + 1))
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = merged[low]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        rank, merged = self.rank.get, self.merged
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1)
                if (r := rank(ids[i] << 20 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank(ids[i] << 20 | ids[j], NONE) != low:
                continue
            ids[i], ids[j] = merged[low], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    found = rank(ids[left] << 20 | ids[right], NONE)
                    if found != NONE:
                        heapq.heappush(heap, (found, left))
        return [x for x in ids if x >= 0]

    def _words(self, part: str) -> list[bytes]:
        """Normalised words of a piece of text without special tokens."""
        if part.isascii():
            low = part.lower()
            return [low.encode()] if low.isalpha() else [
                w.encode() for w in self.pieces.findall(low)]
        if max(part) < KNOWN_LETTERS:
            # Letter by letter: a capital sigma is lowered alike at the end of a word.
            low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            return [w.encode() for w in self.pieces.findall(low)]
        # Letter classes of young scripts differ between Unicode versions; the library's count.
        low = self.library.normalizer.normalize_str(part)
        return [bytes(map(self.letter.__getitem__, w))
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a piece of raw text."""
        out: list[int] = []
        for part in self.cut.split(chunk) if "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self._words(part):
                    out += self.word(word)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text. White space is dropped and never joins with what stands beside it,
        so chunks between it are encoded on their own."""
        chunks = _SPLIT.split(text) if _SEPARATORS.search(text) else text.split()
        known = self.known
        out: list[int] = []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = self.older.get(chunk) or self._chunk(chunk)
                if len(chunk) <= 4 * SHORT_WORD:
                    if len(known) >= MEMORY:
                        self.older, self.known = known, {}
                        known = self.known
                    known[chunk] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    return out.tobytes()


def _encoder(path: str, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, digests, decoded, kept = [], [], [], []
            for value in batch.column("_text"):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(id_bytes(ids)).hexdigest())
                decoded.append(hashlib.sha256(
                    bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                if keep_ids:
                    kept.append(array("i", ids))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests),
                      pa.array(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, ids_sha256, decoded_sha256 [, token_ids].

    Encodes the whole text with the vocabulary file at ``path`` and decodes the ids again. A null or
    empty text has no tokens. Rows are encoded on their own: repeated rows give equal results, an
    empty table gives none, other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", token_ids array<int>"
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(
        _encoder(path, keep_ids), schema)
