"""Exact and near dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from motorgrid.llm import exact_dedup, simhash, vptree
from motorgrid.llm.components import components

SCHEMA = "doc_id long, text string, kept int, keep_id string"
ROWS = [
    (1, "Same Text", 1, "x"), (2, "same text", 1, "x"), (2, "same text", 1, "x"), (3, None, 1, None),
    (4, "", None, "x"), (None, "same TEXT", 1, "x"), (5, "ÄB", 1, "x"), (6, "äb", 1, "x"),
    (None, "alone", 1, "x"), (7, "long " * 5000, 1, "x"), (8, "LONG " * 5000, 1, "x"),
    (9, "long " * 4999 + "lonG.", 1, "x"),
]


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[lowered(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        taken = False
        for i in ids:
            kept = i == keep and not taken
            taken |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("primes, chunk", [
    (exact_dedup.PRIMES, 1 << 20), (exact_dedup.PRIMES, 64), ((3, 2), 1 << 20), ((3, 2), 64)])
def test_exact_groups(spark, primes, chunk):
    """Weak primes make fingerprints collide: the comparison has to part the texts."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = [tuple(r) for r in exact_dedup.exact_groups(docs, chunk, primes).collect()]
    assert sorted(got, key=repr) == brute_exact(ROWS)


def test_hashes_of_parts_combine():
    data = random.Random(1).randbytes(70_001)
    base, prime = exact_dedup.BASES[0], exact_dedup.PRIMES[0]
    whole = exact_dedup.chunk_hash(data, base, prime)
    for cut in (2, 1000, 65_536):
        parts = [exact_dedup.chunk_hash(p, base, prime) for p in (data[:cut], data[cut:])]
        units = (len(data) - cut + 1) // 2
        assert exact_dedup.combine(*parts, units, base, prime) == whole


def test_drop_exact_copies(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.schema == docs.schema
    assert sorted((r["doc_id"], lowered(r["text"])[:9]) for r in left.where(
        "doc_id is not null").collect()) == [
        (2, "same text"), (4, ""), (5, "Äb"), (6, "äb"), (8, "long long"), (9, "long long")]


def test_drop_exact_copies_keeps_columns_of_internal_names(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr(
        "*", "kept AS _text_sha", "keep_id AS _Text_Sha_", "doc_id AS _gone_doc_id", "1 AS _sha")
    left = exact_dedup.drop_exact_copies(docs)
    assert left.schema == docs.schema
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 4, 5, 6, 8, 9]
    assert all(r["_text_sha"] == r["kept"] and r["_gone_doc_id"] == r["doc_id"]
               for r in left.collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.drop_exact_copies(docs).count() == 0
    assert simhash.near_groups(docs).count() == 0
    assert simhash.drop_near_copies(docs, 5, 8, 0.8).count() == 0


def plain_fingerprint(text, words=4):
    parts = [p for p in __import__("re").split("[\x20\x09-\x0d]+", lowered(text)) if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, reach):
    """Smallest linked position per value."""
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= reach
    for i, j in zip(*np.nonzero(near)):
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints():
    texts = ["", None, "One", "one two three", "A b\tc\nd e F", "é\x85ß x\xa0y z w v", "a " * 400,
             " ".join(str(i % 37) for i in range(70_000))]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def clusters(rng, n):
    """Values in chains and clouds of few bits around centres, so links cross every boundary."""
    out = []
    while len(out) < n:
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            out.append(value)
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
    return np.unique(np.array(out[:n], np.uint64))


@pytest.mark.parametrize("reach", [0, 3, 4, 8])
def test_tree_links_what_brute_force_links(reach, monkeypatch):
    monkeypatch.setattr(vptree, "SMALL", 40)
    values = clusters(random.Random(reach), 1500)
    found = vptree.Classes(len(values))
    vptree.search(values, np.zeros(len(values), bool), reach, found)
    assert found.label.tolist() == classes(values, reach)


@pytest.mark.parametrize("depth, task_rows", [(0, 10**6), (3, 10**6), (4, 50)])
def test_links_over_shards(spark, depth, task_rows):
    values = clusters(random.Random(5), 900)
    signed = values.view(np.int64).tolist()
    prints = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, node long")
    edges = simhash.links(prints, 4, depth=depth, task_rows=task_rows)
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert [found.get(i, i) for i in range(len(values))] == classes(values, 4)


def staying(docs, words, reach, similarity):
    """doc_ids that stay when each document is linked to its nearest smaller one, if alike."""
    def shingles(text):
        parts = lowered(text).split()
        return {" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()

    docs = sorted(docs)
    prints = [simhash.fingerprint(t, words) for _, t in docs]
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))
    for i in range(len(docs)):
        same = prints.index(prints[i])
        near = [((prints[i] ^ prints[j]).bit_count(), j) for j in range(i)]
        bits, j = (0, same) if same < i else min(near, default=(99, 0))
        if bits <= reach and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            up[i] = up[j]
    return {docs[i][0] for i in range(len(docs)) if up[i] == i}


def test_near_groups(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(10, " ".join(base), 0, "a"), (4, " ".join(base).upper(), 0, "a"), (11, None, 0, "a"),
            (12, " \n", None, "a"), (None, " ".join(base), 0, "a"), (None, "only this", 0, "a"),
            (4, " ".join(base).upper(), 0, "a")]
    for i in range(40):
        edited = list(base)
        for _ in range(rng.randint(0, 12)):
            edited[rng.randrange(300)] = f"v{rng.randrange(500)}"
        rows.append((100 + i, " ".join(edited), 0, "a"))
        rows.append((200 + i, " ".join(f"w{rng.randrange(9000)}" for _ in range(30)), 0, "a"))
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = np.array([plain_fingerprint(t) for _, t, *_ in rows], np.uint64)
    names = classes(prints, 4)
    low = defaultdict(list)
    for (doc_id, *_), name in zip(rows, names):
        if doc_id is not None:
            low[name].append(doc_id)
    wanted = sorted(((r[0], f"{int(p):016x}", min(low[n]) if low[n] else None)
                     for r, p, n in zip(rows, prints, names)), key=repr)
    got = sorted((tuple(r) for r in simhash.near_groups(docs).collect()), key=repr)
    assert got == wanted
    unique = rows[:4] + rows[5:6] + rows[7:]
    left = simhash.drop_near_copies(spark.createDataFrame(unique, SCHEMA), 5, 10, 0.8)
    assert left.columns == docs.columns
    stays = staying([(r[0], r[1]) for r in unique if r[0] is not None], 5, 10, 0.8)
    assert {r["doc_id"] for r in left.collect()} == stays | {None}
    assert 45 < len(stays) < 80


@pytest.mark.parametrize("task_items", [simhash.TASK_ITEMS, 3000])
def test_near_copies_are_all_similar_pairs(spark, task_items):
    rng = random.Random(12)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(15):
            edited = list(base)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(120)] = f"v{rng.randrange(500)}"
            rows.append((rng.randrange(10**6), " ".join(edited)))
    rows += [(10**6 + i, t.upper()) for i, (_, t) in enumerate(rows[:5])]
    sets = [{" ".join(p[i:i + 5]) for i in range(len(p) - 4)} for p in (t.lower().split() for _, t in rows)]
    low = [d for d, _ in rows]
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b):
                    low[i] = min(low[i], low[j])
    docs = spark.createDataFrame([(*r, 0, "a") for r in rows], SCHEMA)
    found = simhash.near_copies(docs, 5, 24, 0.8, every_pair=True, task_items=task_items)
    got = {r["doc_id"]: r["keep_id"] for r in found.collect()}
    assert got == {d: k for (d, _), k in zip(rows, low) if d != k}
    # The nearest smaller fingerprint alone, as before, misses some.
    assert len(staying(rows, 5, 24, 0.8)) > len(rows) - len(got)


def test_rarest_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    frequent = rng.choice(3000, 200, replace=False).astype(np.uint64)
    order = np.argsort(frequent)
    met = 0
    for _ in range(3000):
        one = np.unique(rng.integers(0, 3000, rng.integers(1, 60)).astype(np.uint64))
        two = np.unique(np.concatenate((one[rng.random(len(one)) < 0.93], rng.integers(0, 3000, 3).astype(np.uint64))))
        both = len(np.intersect1d(one, two))
        for share in (0.5, 0.8, 1.0):
            if both >= share * (len(one) + len(two) - both):
                rare = [simhash.rarest(x, share, frequent[order], order) for x in (one, two)]
                assert len(np.intersect1d(*rare)) > 0
                met += 1
    assert met > 2000
    assert simhash.rarest(one[:0], 0.8, frequent[order], order).tolist() == []
    assert simhash.rarest(one, 0.01, frequent[:0], order[:0]).tolist() == one.tolist()


def test_near_copies_of_full_shards(spark):
    """Shards of more rows than a task takes, most of whose pairs are not alike."""
    rng = random.Random(21)
    rows = []
    for _ in range(2):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(90):
            edited = list(base)
            for _ in range(rng.randint(0, 9)):
                edited[rng.randrange(120)] = f"v{rng.randrange(500)}"
            rows.append((rng.randrange(10**6), " ".join(edited)))
    sets = [{" ".join(p[i:i + 5]) for i in range(len(p) - 4)} for p in (t.split() for _, t in rows)]
    low, before = [d for d, _ in rows], None
    while before != low:
        before = list(low)
        for i, a in enumerate(sets):
            low[i] = min(low[j] for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b))
    assert 5 < len(set(low)) < len(rows)
    docs = spark.createDataFrame([(*r, 0, "a") for r in rows], SCHEMA)
    for task_rows in (40, 10**6):
        found = simhash.near_copies(docs, 5, 64, 0.8, every_pair=True, task_rows=task_rows)
        assert {r["doc_id"]: r["keep_id"] for r in found.collect()} == {
            d: k for (d, _), k in zip(rows, low) if d != k}


def test_unlike_texts_do_not_meet(spark, monkeypatch):
    """Work on near copies grows with the texts, not with their pairs: no step makes more rows than texts."""
    rng, made, settle = random.Random(8), {}, simhash.settle

    def counted(df, name):
        out = settle(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "settle", counted)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60)), 0, "a") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert simhash.near_copies(docs, 5, 14, 0.8, every_pair=True).count() == 0
    assert max(made.values()) == 400


def test_components_of_a_long_chain(spark):
    nodes = list(range(300))
    random.Random(2).shuffle(nodes)
    rows = list(zip(nodes, nodes[1:])) + [(1000, 1001), (1001, 1000), (5, 5)]
    found = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert found == {**{i: 0 for i in nodes}, 1000: 1000, 1001: 1000}
