"""Vantage-point trees over 64-bit fingerprints under the Hamming distance.

A node has a vantage point and a radius. Fingerprints within the radius are members of the inner
child, the others of the outer one. Two members of different children can be within ``reach`` of each
other only if the outer one is within radius + reach of the vantage point (triangle inequality), so
just those outer members visit the inner child as guests. A guest looks for members only, and goes on
to each child whose ball the bounds cannot exclude. Every pair within reach meets in some leaf: as two
members, or as a member and a guest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# In-task nodes of at most so many members are compared directly.
SMALL = 768
_BLOCK = 1 << 18


@dataclass(frozen=True)
class Split:
    """Inner node: the children are 2 i + 1 (inner) and 2 i + 2 (outer) in a complete tree."""

    vantage: int
    radius: int


def distance(values: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(point)).astype(np.int16)


def choose_split(sample: np.ndarray) -> Split:
    """The vantage point, of a few, whose distances spread most, with the median as radius."""
    best, spread = int(sample[0]), -1.0
    for point in sample[:: max(1, len(sample) // 8)][:8]:
        found = float(distance(sample, int(point)).std())
        if found > spread:
            best, spread = int(point), found
    return Split(best, int(np.median(distance(sample, best))))


def build_tree(sample: np.ndarray, depth: int) -> list[Split]:
    """Splits of a complete tree of ``depth`` levels, in heap order, from a bounded sample."""
    parts = [np.unique(sample)]
    splits: list[Split] = []
    for _ in range(depth):
        below = []
        for part in parts:
            split = choose_split(part) if len(part) else Split(0, 32)
            splits.append(split)
            inner = distance(part, split.vantage) <= split.radius
            below += [part[inner], part[~inner]]
        parts = below
    return splits


def divide(values: np.ndarray, guest: np.ndarray, split: Split, reach: int
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(goes inside, goes inside as a guest, goes outside); nobody is a new guest outside."""
    far = distance(values, split.vantage)
    inner = far <= split.radius
    inside = far <= split.radius + reach
    outside = np.where(guest, far > split.radius - reach, ~inner)
    return inside, guest | ~inner, outside


def route(values: np.ndarray, splits: list[Split], depth: int, reach: int
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, is guest) of every visit of ``values`` to a leaf."""
    rows = np.arange(len(values))
    node = np.zeros(len(values), np.int64)
    guest = np.zeros(len(values), bool)
    for level in range(depth):
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for number in range(2**level):
            at = node == number
            if not at.any():
                continue
            r, g = rows[at], guest[at]
            inside, inside_guest, outside = divide(
                values[r], g, splits[2**level - 1 + number], reach)
            out.append((r[inside], np.full(inside.sum(), 2 * number), inside_guest[inside]))
            out.append((r[outside], np.full(outside.sum(), 2 * number + 1), g[outside]))
        if not out:
            break
        rows, node, guest = (np.concatenate(x) for x in zip(*out))
    return rows, node, guest


class Classes:
    """Classes of linked rows of one task, kept as the smallest linked row."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[left], label[right]
            open_ = a != b
            if not open_.any():
                return
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                shorter = label[label]
                if np.array_equal(shorter, label):
                    break
                label[:] = shorter


class Nearest:
    """For each row the smaller node of fewest differing bits among the linked ones."""

    def __init__(self, values: np.ndarray, node: np.ndarray) -> None:
        self.values, self.node = values, node
        self.bits = np.full(len(values), 127, np.int32)
        self.near = np.zeros(len(values), np.int64)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        up = self.node[left] > self.node[right]
        row, other = np.where(up, left, right), np.where(up, right, left)
        apart = row != other
        row, other = row[apart], other[apart]
        bits = np.bitwise_count(self.values[row] ^ self.values[other]).astype(np.int32)
        near = self.node[other]
        order = np.lexsort((near, bits, row))
        row, bits, near = row[order], bits[order], near[order]
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        row, bits, near = row[first], bits[first], near[first]
        better = (bits < self.bits[row]) | ((bits == self.bits[row]) & (near < self.near[row]))
        self.bits[row[better]], self.near[row[better]] = bits[better], near[better]


def search(values: np.ndarray, guest: np.ndarray, reach: int, classes: Classes | Nearest) -> None:
    """Link every pair (member, member or guest) within ``reach``, by a tree inside the task."""
    todo: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(len(values)), guest)]
    while todo:
        rows, visiting = todo.pop()
        members = rows[~visiting]
        if not len(members):
            continue
        own = values[rows]
        if len(members) > SMALL:
            split = choose_split(values[members][:: max(1, len(members) // 2048)])
            inside, inside_guest, outside = divide(own, visiting, split, reach)
            if inside.sum() < len(rows) or outside.sum() < len(rows):
                inner_members = int((inside & ~inside_guest).sum())
                if 0 < inner_members < len(members):
                    todo.append((rows[inside], inside_guest[inside]))
                    todo.append((rows[outside], visiting[outside]))
                    continue
        for left, right in close_pairs(values[members], own, reach):
            classes.link(members[left], rows[right])


def close_pairs(left: np.ndarray, right: np.ndarray, reach: int
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``reach``, block by block, each block small enough for the cache."""
    step = max(1, _BLOCK // max(1, len(right)))
    for start in range(0, len(left), step):
        near = np.bitwise_count(left[start:start + step, None] ^ right[None, :]) <= reach
        hit = np.flatnonzero(near)
        if len(hit):
            a, b = np.divmod(hit, len(right))
            yield a + start, b
