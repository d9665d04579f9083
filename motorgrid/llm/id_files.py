"""Token-id files: an adaptive context-mixing range coder over independently reset blocks.

An id is coded as its slot, the number of the ids that came up before it in the block. Three models
give its share: order 0 counts slots, order 1 tells what followed the id before, order 2 what followed
the two before. They are mixed with weights that follow how well each has predicted so far, and the
mixture drives a range coder. An id new to the block is a class by size in the mixture; its low bits
are kept as they are. The models learn after rounds of a fifth of what they know, so that tables can be
made for all of a round; the ids of a round are not lost to them, only later. Every block starts from
empty models and carries a checksum of its ids, so a block can be read without the others and a damaged
one does not spread. Many blocks are coded side by side, one numpy lane each.

File: magic; blocks of (ids, words, checksum) and their 16-bit words; a packed table of documents;
and a trailer that says where the table starts.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motorgrid.llm.common import BATCH_BYTES, BATCH_ROWS, settle, shared_path

MAGIC = b"IDRANGE2"
BLOCK_IDS = 2048
LANES = 2048
FILE_IDS = 4 * LANES * BLOCK_IDS
END_ID = 1
# Pieces of text whose ids a task process remembers before it begins anew.
MEMORY = 1_000_000

_BITS = 20  # of the coder's frequencies
_FIELD = (1 << _BITS) - 1
_CLASSES = 64  # symbols for ids new to the block, by size; the block's own ids follow as slots
_USED = 60  # classes in use
_MOST = (1 << 12) - _CLASSES  # ids of a block
_NONE = 1 << 14  # entry of a context that predicts nothing: a slot that never is, confidence 0
_PAIRS = 2048  # entries of the order-2 table
_SURE = int(0.97 * (1 << _BITS))  # what orders 1 and 2 may weigh together
# Confidence after a hit (4 to 7) or a miss (0 to 3); below 2 a miss replaces the prediction.
_CHANGE = np.array([0, 0, -1, -2, 1, 1, 1, 0])
# Ids below 8 have a class each; above, four classes an octave and the low bits as they are.
_OCTAVES = [(4 + m << e, e) for e in range(1, 14) for m in range(4)]
_BASE = np.array([*range(8), *(b for b, _ in _OCTAVES), *[0] * (_CLASSES - _USED)])
_LOW_BITS = np.array([0] * 8 + [e for _, e in _OCTAVES] + [0] * (_CLASSES - _USED))
_CLASS = (np.searchsorted(_BASE[:_USED], np.arange(1 << 16), side="right") - 1).astype(np.int16)
_WORD = np.uint64(16)
_HALF = np.uint64(32)
_LEAST = np.uint64(1 << 32)
_LOW_MASK = np.uint64((1 << 32) - 1)
_PART = np.uint64(_BITS)
_LAST = np.uint64(_FIELD)


def _first_weights() -> np.ndarray:
    """Tries, hits of order 2 and hits of order 1 (20 bits each) that every context begins with."""
    sure2, sure1, differ = np.indices((4, 4, 2))
    share = np.array([0, 0.35, 0.6, 0.8])
    low = share[sure1] * differ * (1 - share[sure2]) * np.where(sure2 > 0, 0.3, 1)
    hits2, hits1 = (1024 * share[sure2]).astype(np.int64), (1024 * low).astype(np.int64)
    return (1024 << 40 | hits2 << 20 | hits1).ravel()


_FIRST = _first_weights()
_TRY = 128  # weight of one id beside these


def _rounds(longest: int) -> list[tuple[int, int]]:
    """The stretches of a block after which its models learn."""
    out, start = [], 0
    while start < longest:
        out.append((start, min(longest, start + max(16, start // 5))))
        start = out[-1][1]
    return out


class _Models:
    """Order-0 to order-2 models of ``lanes`` blocks of up to ``longest`` ids, and their mixture."""

    def __init__(self, lanes: int, longest: int) -> None:
        if longest > _MOST:
            raise ValueError(f"a block has at most {_MOST} ids")
        self.slots = _CLASSES + longest
        lane = np.arange(lanes)
        self.slot0, self.pair0, self.weight0 = lane * self.slots, lane * _PAIRS, lane * 32
        self.lane = lane
        # Order 0: counts, in the high half.
        self.counts = np.zeros((lanes, self.slots), np.uint32)
        self.counts[:, :_USED] = 1 << 16
        self.filled = np.full(lanes, _CLASSES)
        # The same in the low half, and the sum of those before in the high half.
        self.shares = np.zeros((lanes, self.slots), np.uint32)
        self.flat = self.shares.reshape(-1)
        # Orders 1 and 2: the slot that followed, with a confidence; order 2 checks its context.
        self.one = np.full(lanes * self.slots, _NONE, np.uint16)
        self.two = np.full(lanes * _PAIRS, -1, np.int32)
        # Hits of both by their confidences and whether they differ.
        self.hits = np.tile(_FIRST, lanes)

    def begin(self, n: int, t: int) -> None:
        """Mix what the first ``n`` lanes have learnt in ``t`` ids each."""
        self.total = _USED + 2 * t
        self.used = used = int(self.filled[:n].max(initial=_CLASSES))
        counts, shares = self.counts[:n, :used], self.shares[:n, :used]
        np.cumsum(counts, axis=1, dtype=np.uint32, out=shares)
        shares -= counts
        shares |= counts >> 16
        hits = self.hits[:n * 32]
        tries = hits >> 40
        weight2 = (hits >> 20 & _FIELD) * _SURE // tries
        weight1 = (hits & _FIELD) * _SURE // tries
        each = ((1 << _BITS) - weight2 - weight1) // self.total
        self.weights = weight2 << 40 | weight1 << 20 | each

    def look(self, lane: slice | tuple, last: np.ndarray, before: np.ndarray) -> None:
        """What orders 1 and 2 predict after the two symbols given."""
        self.at1 = self.slot0[lane] + last
        self.at2 = self.pair0[lane] + (last + before * 0x9E5 & _PAIRS - 1)
        self.context = before << 15
        self.entry1 = self.one.take(self.at1).astype(np.int64)
        # Of another context, something above _NONE is left; unused entries are negative.
        self.entry2 = np.minimum((self.two.take(self.at2) ^ self.context).view(np.uint64),
                                 np.uint64(_NONE)).view(np.int64)
        self.next1, self.next2 = self.entry1 >> 2, self.entry2 >> 2
        self.at_w = (self.entry2 & 3) << 3
        self.at_w += (self.entry1 & 3) << 1
        self.at_w += self.next1 != self.next2
        self.at_w += self.weight0[lane]

    def mix(self) -> None:
        """The weights of the predictions, and of one count of order 0."""
        weight = self.weights.take(self.at_w)
        self.weight2, self.weight1 = weight >> 40, weight >> 20 & _FIELD
        self.each = weight & _FIELD

    def interval(self, lane: slice | tuple, symbol: np.ndarray) -> tuple:
        """Start and size of the symbols' shares in the mixture."""
        share = self.flat.take(self.slot0[lane] + symbol).astype(np.int64)
        start, size = (share >> 16) * self.each, (share & 0xFFFF) * self.each
        for follows, weight in ((self.next1, self.weight1), (self.next2, self.weight2)):
            gap = follows - symbol
            start += gap >> 63 & weight
            size += (gap == 0) * weight
        return start, size

    def invert(self, n: int) -> None:
        """For ``find``: the slot of every count of order 0."""
        slots = np.tile(np.arange(self.used, dtype=np.uint16), n)
        self.owners = np.repeat(slots, (self.counts[:n, :self.used] >> 16).reshape(-1))
        self.owner0 = self.lane * self.total

    def find(self, n: int, spot: np.ndarray) -> np.ndarray:
        """The symbol whose share holds ``spot``."""
        first = self.next1 < self.next2
        low = np.where(first, self.weight1, self.weight2)
        # Take out what the predicted slots have beyond order 0, the smaller slot first.
        for slot, weight in ((np.minimum(self.next1, self.next2), low),
                             (np.maximum(self.next1, self.next2),
                              self.weight1 + self.weight2 - low)):
            below = self.flat.take(self.slot0[:n] + slot, mode="clip") >> 16
            spot = np.minimum(spot, np.maximum(spot - weight, below * self.each))
        spot = np.minimum(spot // self.each, self.total - 1)
        return self.owners.take(self.owner0[:n] + spot).astype(np.int64)

    def admit(self, lane: np.ndarray, time: np.ndarray, ids: np.ndarray,
              known: np.ndarray) -> np.ndarray:
        """Slots of a round's new ids, numbered as they come up in the lane; notes them in
        ``known``."""
        keys = lane << 28 | ids << 12 | time
        order = np.argsort(keys)
        keys = keys.take(order) >> 12
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        first = order[head]
        # Heads in order of lane and time.
        by_time = np.argsort(lane[first] << 12 | time[first])
        of = lane[first][by_time]
        count = np.bincount(of, minlength=len(self.lane))
        rank = np.empty(len(first), np.int64)
        rank[by_time] = np.arange(len(first)) - (np.cumsum(count) - count)[of]
        slot = self.filled[lane[first]] + rank
        known[lane[first], slot] = ids[first]
        self.filled += count
        out = np.empty(len(keys), np.int64)
        out[order] = slot[np.cumsum(head) - 1]
        return out

    def learn(self, symbols: np.ndarray, slots: np.ndarray, new: np.ndarray) -> None:
        """Learn a round (lane, time): the coded symbols, the slots (beginning with the two before
        the round), and which were ``new``."""
        n = len(symbols)
        counts, row, now = self.counts.reshape(-1), self.slot0[:n, None], slots[:, 2:]
        np.add.at(counts, (row + symbols).reshape(-1),
                  np.where(new, 1 << 16, 2 << 16).astype(np.uint32).reshape(-1))
        np.add.at(counts, (row + now)[new], np.uint32(1 << 16))
        self.look(np.s_[:n, None], slots[:, 1:-1], slots[:, :-2])
        hit1, hit2 = self.next1 == now, self.next2 == now
        differ = hit1 & (self.next1 != self.next2)
        np.add.at(self.hits, self.at_w.reshape(-1),
                  ((_TRY << 40) + hit2 * (_TRY << 20) + differ * _TRY).reshape(-1))
        # Of equal contexts the last in time counts.
        fresh = now << 2 | 1
        mark = (self.entry1 & 3) + (hit1.view(np.uint8) << 2)
        self.one[self.at1] = np.where(mark > 1, self.entry1 + _CHANGE.take(mark), fresh)
        mark = (self.entry2 & 3) + (hit2.view(np.uint8) << 2)
        self.two[self.at2] = self.context | np.where(
            mark > 1, self.entry2 + _CHANGE.take(mark), fresh)


def _slots(ids: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each id (lane, time), numbered as they come up in the lane, and whether its round is
    the first that has it."""
    lanes, longest = ids.shape
    times = np.arange(longest, dtype=np.int32)
    keys = ids.astype(np.int32) << 12 | times
    keys.sort(axis=1)
    time = keys & 0xFFF
    at = (time + np.arange(lanes)[:, None] * longest).reshape(-1)
    keys >>= 12
    head = np.ones((lanes, longest), bool)
    np.not_equal(keys[:, 1:], keys[:, :-1], out=head[:, 1:])
    head = head.reshape(-1)
    flag = np.empty(lanes * longest, bool)
    flag[at] = head
    slots = np.cumsum(flag.reshape(lanes, longest), axis=1, dtype=np.int16).reshape(-1)
    slots += np.int16(_CLASSES - 1)
    group = np.cumsum(head) - 1
    turn = rounds.take(time.reshape(-1))
    flag[at] = turn == turn[head].take(group)
    slots[at] = slots.take(at[head]).take(group)
    return slots.reshape(lanes, longest), flag.reshape(lanes, longest)


def _low_bits(lane: np.ndarray, kind: np.ndarray, lanes: int) -> tuple:
    """Number of low bits of new ids, in order of lanes: of each, before each, and of lanes."""
    bits = _LOW_BITS.take(kind)
    whole = np.bincount(lane, bits, lanes).astype(np.int64)
    return bits, np.cumsum(bits) - bits - (np.cumsum(whole) - whole)[lane], whole


def _order(counts: list[int]) -> tuple[list[int], np.ndarray, int, list[int]]:
    """Blocks by falling size, their sizes, the largest, and how many reach each time."""
    order = sorted(range(len(counts)), key=lambda i: -counts[i])
    sizes = np.array([counts[i] for i in order], np.int64)
    longest = int(sizes.max(initial=0))
    return order, sizes, longest, np.searchsorted(
        -sizes, -np.arange(longest), side="left").tolist()


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (below 65536) as its own run of 16-bit words: the range coder's, then, from
    the end backwards, the low bits of new ids."""
    order, sizes, longest, living = _order([len(b) for b in blocks])
    lanes, rounds = len(blocks), _rounds(longest)
    models = _Models(lanes, longest)
    ids = np.full((lanes, longest), 0xFFFF, np.uint16)
    for lane, i in enumerate(order):
        ids[lane, :sizes[lane]] = blocks[i]
    turns = np.repeat(np.arange(len(rounds)), [end - begin for begin, end in rounds])
    # Two columns before the block, of a class that is never coded.
    slots, symbols = (np.full((lanes, longest + 2), _USED, np.int16) for _ in range(2))
    new = np.empty((lanes, longest), bool)
    plain: list[bytes] = []
    for at in range(0, lanes, 64):  # few at a time, to stay in the cache
        some = np.s_[at:at + 64]
        slots[some, 2:], new[some] = _slots(ids[some], turns)
        new[some] &= np.arange(longest) < sizes[some, None]
        symbols[some, 2:] = np.where(new[some], _CLASS.take(ids[some]), slots[some, 2:])
        plain += _plain(ids[some], new[some])
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    width = 2 * longest + 8
    # Words keep their carry in bit 16 until the end.
    words = np.zeros(lanes * width, np.uint32)
    used = np.arange(lanes) * width
    for begin, end in rounds:
        n = living[begin]
        models.begin(n, begin)
        coded = symbols[:n, begin:end + 2].astype(np.int64)
        models.look(np.s_[:n, None], coded[:, 1:-1], coded[:, :-2])
        models.mix()
        starts, spans = (np.ascontiguousarray(a.view(np.uint64).T)
                         for a in models.interval(np.s_[:n, None], coded[:, 2:]))
        for t in range(begin, end):
            m = living[t]
            part = span[:m] >> _PART
            low[:m] += part * starts[t - begin, :m]
            np.multiply(part, spans[t - begin, :m], out=span[:m])
            short = np.flatnonzero(span[:m] < _LEAST)
            while len(short):
                value, at = low.take(short), used.take(short)
                words[at] = value >> _HALF
                at += 1
                used[short] = at
                low[short] = (value & _LOW_MASK) << _WORD
                left = span.take(short) << _WORD
                span[short] = left
                short = short[left < _LEAST]
        known = slots[:n, begin:end + 2].astype(np.int64)
        models.learn(coded[:, 2:], known, new[:n, begin:end])
        models.filled[:n] = np.maximum(models.filled[:n], known[:, 2:].max(axis=1) + 1)
    for shift in (32, 16, 0):
        words[used] = low >> np.uint64(shift) & np.uint64(0x1FFFF if shift == 32 else 0xFFFF)
        used += 1
    used -= np.arange(lanes) * width
    words = words.reshape(lanes, width)[:, :int(used.max(initial=0))].T.copy()
    for at in range(len(words) - 1, 0, -1):
        words[at - 1] += words[at] >> 16
    words = words.T.astype("<u2")
    out: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order):
        out[i] = words[lane, :used[lane]].tobytes() + plain[lane]
    return out


def _plain(ids: np.ndarray, new: np.ndarray) -> list[bytes]:
    """The low bits of the new ids of each lane, words in reverse."""
    lanes, lane, given = len(ids), np.nonzero(new)[0], ids[new]
    kind = _CLASS.take(given)
    bits, offset, whole = _low_bits(lane, kind, lanes)
    out = np.zeros((lanes, int(whole.max(initial=0)) // 16 + 2), np.uint32)
    value = given - _BASE.take(kind) << 32 - (offset & 15) - bits
    at = lane * out.shape[1] + (offset >> 4)
    np.add.at(out.reshape(-1), at, (value >> 16).astype(np.uint32))
    np.add.at(out.reshape(-1), at + 1, (value & 0xFFFF).astype(np.uint32))
    words = out.astype("<u2")
    return [words[i, :-(-whole[i] // 16)][::-1].tobytes() for i in range(lanes)]


def decode_blocks(data: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The ids of each block, given how many it has."""
    order, sizes, longest, living = _order(counts)
    lanes = len(data)
    models = _Models(lanes, longest)
    width = max((len(d) for d in data), default=0) // 2 + 4
    words = np.zeros((lanes, width), np.uint16)
    for lane, i in enumerate(order):
        words[lane, :len(data[i]) // 2] = np.frombuffer(data[i], "<u2")
    head = words[:, :3].astype(np.uint64)
    code = head[:, 0] << _HALF | head[:, 1] << _WORD | head[:, 2]
    words = words.reshape(-1)
    used = np.arange(lanes) * width + 3
    limit = used + (width - 4)
    # Where the low bits begin: the last word of each lane.
    plain = np.array([len(data[i]) // 2 - 1 for i in order], np.int64) + np.arange(lanes) * width
    taken = np.zeros(lanes, np.int64)
    span = np.full(lanes, 1 << 48, np.uint64)
    slots = np.full((lanes, longest + 2), _USED, np.int16)
    known = np.zeros((lanes, models.slots), np.uint16)
    last = before = np.full(lanes, _USED)
    for begin, end in _rounds(longest):
        n = living[begin]
        models.begin(n, begin)
        models.invert(n)
        symbols = np.full((end - begin, n), _USED)
        for t in range(begin, end):
            m = living[t]
            models.look(slice(m), last[:m], before[:m])
            models.mix()
            part = span[:m] >> _PART
            spot = np.minimum(code[:m] // part, _LAST).view(np.int64)
            symbol = models.find(m, spot)
            start, size = models.interval(slice(m), symbol)
            code[:m] -= part * start.view(np.uint64)
            np.multiply(part, size.view(np.uint64), out=span[:m])
            short = np.flatnonzero(span[:m] < _LEAST)
            while len(short):
                at = used.take(short)
                code[short] = code.take(short) << _WORD | words.take(at)
                used[short] = np.minimum(at + 1, limit.take(short))
                left = span.take(short) << _WORD
                span[short] = left
                short = short[left < _LEAST]
            symbols[t - begin, :m] = symbol
            before, last = last, symbol
        coded = np.ascontiguousarray(symbols.T)
        new = coded < _USED
        lane, time = np.nonzero(new)
        kind = coded[new]
        bits, offset, whole = _low_bits(lane, kind, n)
        offset += taken.take(lane)
        taken[:n] += whole
        at = plain.take(lane) - (offset >> 4)
        value = (words.take(at, mode="clip").astype(np.int64) << 16
                 | words.take(at - 1, mode="clip")) >> 32 - (offset & 15) - bits
        now = coded.copy()
        now[new] = models.admit(lane, time, (value & (1 << bits) - 1) + _BASE.take(kind), known)
        slots[:n, begin + 2:end + 2] = now
        models.learn(coded, slots[:n, begin:end + 2].astype(np.int64), new)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for lane, i in enumerate(order):
        out[i] = known[lane].take(slots[lane, 2:sizes[lane] + 2]).astype(np.uint32)
    return out


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), pa.array(ids))


class Memory:
    """The tokenizers library, asked once per distinct piece of the chunks between white space.

    White space is dropped by these tokenizers and never joins with what stands beside it, so the ids
    of a text are those of its chunks one after another. A chunk of Latin letters and final marks is
    two pieces, which the library splits as well; any other chunk is one.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(1 << 16, bool)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        # The first piece is the empty one.
        self.known = pa.array([""])
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters, one after another, and how many each has; many words in a text,
        told apart by the ids that end a word. None where these do not tell."""
        texts = [" ".join(words[i:i + 1000]) for i in range(0, len(words), 1000)]
        got = [np.array(e.ids, np.uint32)
               for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *got])
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids) - 1):
            return ids, np.diff(ends, prepend=-1)
        return None

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]
        return (np.array([i for ids in got for i in ids], np.uint32),
                np.array([len(ids) for ids in got], np.int64))

    def _learn(self, fresh: list[str]) -> None:
        plain = np.array([_LETTERS(p) is not None for p in fresh], bool)
        words = [p for p, w in zip(fresh, plain) if w]
        ids, sizes = self._words(words) or self._each(words)
        more, more_sizes = self._each([p for p, w in zip(fresh, plain) if not w])
        place = np.where(plain, np.cumsum(plain) - 1, len(words) + np.cumsum(~plain) - 1)
        sizes = np.concatenate([sizes, more_sizes])
        ids = _lists(np.concatenate([ids, more]), sizes).take(pa.array(place)).flatten().to_numpy()
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes.take(place)])

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each distinct piece is remembered, after the library was asked for new ones."""
        if len(self.known) > MEMORY:
            self._forget()
        at = pc.index_in(pieces, value_set=self.known)
        fresh = pieces.filter(at.is_null())
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(fresh):
            place[place < 0] = len(self.known) + np.arange(len(fresh))
            self._learn(fresh.to_pylist())
            self.known = pa.concat_arrays([self.known, fresh])
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (null is empty) one after another, and how many each has."""
        # A chunk may hold white space other than ASCII's; the library drops it.
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        found = parts.flatten().dictionary_encode()
        chunks = found.dictionary
        split = pc.extract_regex(chunks, _WORD_AND_MARKS)
        word = split.field("word")
        lower = pc.if_else(pc.string_is_ascii(word), pc.ascii_lower(word), word)
        fits = split.is_valid()
        pieces = pa.concat_arrays([pc.if_else(fits, lower, chunks),
                                   pc.if_else(fits, split.field("marks"), "")]).dictionary_encode()
        place = self._places(pieces.dictionary).take(
            pieces.indices.to_numpy().reshape(2, -1).T.reshape(-1))
        ids = _lists(self.ids, self.sizes).take(pa.array(place)).flatten().to_numpy()
        sizes = self.sizes.take(place).reshape(-1, 2).sum(axis=1)
        at = found.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes.take(at))])
        ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        return (_lists(ids, sizes).take(found.indices).flatten().to_numpy(),
                np.diff(upto.take(ends)))


_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_LETTERS = re.compile(_LATIN).fullmatch
_WORD_AND_MARKS = f"^(?P<word>{_LATIN})(?P<marks>[.,;:!?]*)$"
_HEAD = struct.Struct("<III")
_TAIL = struct.Struct("<QQII8s")
_TABLE = struct.Struct("<q?I")


class Writer:
    """One file: add documents in order, blocks are written as lanes fill up."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream = stream
        self.open: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple[int | None, int]] = []
        self.ids = self.bytes = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def add(self, doc_id: int | None, ids: Sequence[int]) -> None:
        self.docs.append((doc_id, len(ids)))
        self.ids += len(ids)
        # A document of any length is taken in bounded pieces.
        for at in range(0, len(ids), LANES * BLOCK_IDS):
            piece = np.asarray(ids[at:at + LANES * BLOCK_IDS], np.uint32)
            self.open.append(piece)
            self.held += len(piece)
            if self.held >= LANES * BLOCK_IDS:
                self._blocks(LANES * BLOCK_IDS)

    def _blocks(self, count: int) -> None:
        held = np.concatenate(self.open)
        taken, self.open, self.held = held[:count], [held[count:]], len(held) - count
        blocks = [taken[i:i + BLOCK_IDS] for i in range(0, count, BLOCK_IDS)]
        for block, data in zip(blocks, encode_blocks(blocks)):
            self._write(_HEAD.pack(
                len(block), len(data) // 2, zlib.crc32(block.astype("<u4").tobytes())))
            self._write(data)

    def close(self) -> None:
        if self.held:
            self._blocks(self.held)
        start = self.bytes
        table = zlib.compress(b"".join(
            _TABLE.pack(d or 0, d is None, n) for d, n in self.docs), 6)
        self._write(table)
        self._write(_TAIL.pack(start, len(self.docs), len(table), zlib.crc32(table), MAGIC))
        self.stream.close()


def read_ids(file: pa.NativeFile) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file in order; ValueError where a checksum differs."""
    size = file.size()
    file.seek(size - _TAIL.size)
    start, count, length, crc, magic = _TAIL.unpack(file.read(_TAIL.size))
    file.seek(start)
    packed = file.read(length)
    if magic != MAGIC or zlib.crc32(packed) != crc:
        raise ValueError("damaged table of documents")
    docs = list(_TABLE.iter_unpack(zlib.decompress(packed)))
    if len(docs) != count:
        raise ValueError("damaged table of documents")
    file.seek(0)
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of ids")
    held = np.zeros(0, np.uint32)
    pos = len(MAGIC)
    for doc_id, missing, n in docs:
        while len(held) < n:
            data, counts, checks = [], [], []
            while pos < start and len(data) < LANES:
                ids, words, check = _HEAD.unpack(file.read(_HEAD.size))
                data.append(file.read(2 * words))
                counts.append(ids)
                checks.append(check)
                pos += _HEAD.size + 2 * words
            if not data:
                raise ValueError("blocks end before the documents")
            blocks = decode_blocks(data, counts)
            for block, check in zip(blocks, checks):
                if zlib.crc32(block.astype("<u4").tobytes()) != check:
                    raise ValueError("block checksum differs")
            held = np.concatenate([held, *blocks])
        yield (None if missing else doc_id), held[:n]
        held = held[n:]


_LIST = "path string, first_doc long, docs long, ids long, bytes long, part int"


@functools.lru_cache(maxsize=1)
def _memory(vocabulary: str) -> Memory:
    """Of a worker process, which runs many tasks."""
    return Memory(vocabulary)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of more rows, bounded in bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if (sum(b.num_rows for b in held) >= 4 * BATCH_ROWS
                or sum(b.nbytes for b in held) >= BATCH_BYTES // 2):
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _writer(folder: str, vocabulary: str, end_id: int, file_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        library = _memory(vocabulary)
        writer, path, part, rows = None, "", 0, []

        def done() -> None:
            writer.close()
            rows.append((path, writer.docs[0][0], len(writer.docs), writer.ids, writer.bytes, part))

        for batch in _gathered(batches):
            ids, sizes = library.encode(batch["_text"])
            # The end id after the ids of each document.
            ends = np.cumsum(sizes + 1)
            whole = np.empty(len(ids) + len(sizes), np.uint32)
            inner = np.ones(len(whole), bool)
            inner[ends - 1] = False
            whole[inner], whole[ends - 1] = ids, end_id
            for doc_id, end, size in zip(
                    batch["doc_id"].to_pylist(), ends.tolist(), sizes.tolist()):
                if writer is None:
                    # Files of an attempt that Spark does not commit are in no list.
                    name = f"{uuid.uuid4().hex}.ids"
                    path = f"{folder}/{name}"
                    writer = Writer(store.open_output_stream(f"{base}/{name}"))
                writer.add(doc_id, whole[end - size - 1:end])
                if writer.ids >= file_ids:
                    done()
                    writer, part = None, part + 1
        if writer is not None:
            done()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                names=["path", "first_doc", "docs", "ids", "bytes", "part"])

    return run


def write_ids(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID,
              file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every row of ``docs`` (doc_id, text; null is empty) and write the ids, each document
    ended by ``end_id``, in ascending doc_id order (null first).

    Returns the list of files: path, first_doc, docs, ids, bytes, part and start, the number of ids in
    all files before. An empty table gives an empty list; other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "ids")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")
    ).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("_text"))
    files = settle(ordered.mapInArrow(
        _writer(folder, vocabulary, end_id, file_ids), _LIST), "ids-list")
    # A window over the list of files; equal doc_ids never leave their partition, parts count on.
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part").rowsBetween(
        Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            store, base = fs.FileSystem.from_uri(path)
            names, starts, counts, digests = [], [], [], []
            with store.open_input_file(base) as file:
                for doc_id, ids in read_ids(file):
                    names.append(doc_id)
                    starts.append(start)
                    counts.append(len(ids))
                    digests.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (names, starts, counts, digests)],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 per document of the listed files, from the files."""
    listed = settle(files.select("path", "start"), "ids-starts")
    tasks = max(1, min(4096, listed.count()))
    return listed.repartition(tasks, "path").mapInArrow(
        _reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
