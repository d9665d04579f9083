"""The prefix trie against a brute-force trie of Python tuples."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from motorgrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n string"


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is None:
            continue
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(turns.get(base, [])[:h] + v[h:])
    return out


def trie_by_hand(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(own) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(conversations[c]) == len(path))))
        out.append((
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own), children[path],
            leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations_of(kind):
    if kind == "odd":
        return [
            (0, 1, "user", "hi", 1, "x"), (0, None, None, None, 1, "x"), (0, 1, "user", "hi", 1, "x"),
            (7, 5, "assistant", "é😀", 1, "x"), (7, None, "user", "", 1, "x"), (-7, 1, "a", "b", 1, "x"),
            (-7, 2, "ab", "", 1, "x"), (None, 1, "user", "nobody", 1, "x"), (350, 1, "", "alone", 1, "x"),
            (9, 1, "1:a", "b", 1, "x"), (9, 2, "1", ":ab", 1, "x")]
    if kind == "long":
        # Copies of 70 turns, some cut short or ending otherwise, and hundreds of short ones.
        rows = []
        for c in range(0, 40_000, 997):
            last = 70 - c % 23
            rows += [(c, t, "user" if t % 2 else None, f"turn {t}" * (t % 5), 1, "x") for t in range(last)]
            rows += [(c, last, "user", f"end {c % 3}", 1, "x")]
        return rows + [(100 * c + c % 7, t, "u", "same", 1, "x") for c in range(300) for t in range(c % 4)]
    # One hot conversation of 250 turns, all of one number.
    return [(100, 1, "u", f"t{t % 90}", 1, "x") for t in range(250)] + [
        (c, t, "u", f"{c % 2}{t}", 1, "x") for c in range(100, 160) for t in range(2, 5)]


@pytest.mark.parametrize("kind, ends, span", [
    ("odd", 65_536, 4096), ("long", 1000, 2), ("long", 65_536, 4096), ("hot", 7, 4)])
def test_trie_equals_brute_force(spark, monkeypatch, kind, ends, span):
    monkeypatch.setattr(prefix_trie, "ENDS", ends)
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rows = conversations_of(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr)
    assert got == trie_by_hand(rebuilt_by_hand(rows))


def test_empty_table_and_conversations_without_turns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(df).collect() == []
    # Both lose all their turns to the head, which is absent.
    gone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1][:2]
    df = spark.createDataFrame([(c, 1, "u", "x", 1, "x") for c in gone], SCHEMA)
    (root,) = prefix_trie.prefix_trie(df).collect()
    ends = hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest()
    assert tuple(root) == (gone[0], 0, None, 2, 0, 1, 0, ends)
