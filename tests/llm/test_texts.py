"""Quality rules, BPE, id files and the classifier against brute force and the library."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from motorgrid.llm import id_files, ordinal, quality_rules
from motorgrid.llm.bpe import Bpe, encode_documents, id_bytes
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_words string, n_tokens string, start int"
ROWS = [
    (5, "The quick brown fox, it's <|endoftext|> a test! " * 30, "a", "a", 1), (1, None, "a", "a", 1),
    (2, "", "a", "a", None), (None, "no name", "a", "a", 1), (5, "twice", "a", "a", 1),
    (5, "twice", "a", "a", 1), (3, "x" * 9000 + " " + "ab!" * 4000, "a", "a", 1),
    (4, "ΑΣ Σ\x1cİ\x85中文 👍🏽 ½² \U0001b4cc", "a", "a", 1),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return Bpe(PATH)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("aéΣσ İ<|>'sdtlvre!1½̧́\n\t\x1f\x85中👍", max_size=60)))
def test_bpe_is_the_library(bpe, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == ids
    assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("word", ["antidisestablishmentarianism", "zzzzzzzz", "abcabcabcabcabc" * 9])
def test_scan_and_heap_merge_alike(bpe, word):
    ids = [bpe.inner[b] for b in word.encode()]
    ids[-1] = bpe.last[word.encode()[-1]]
    assert bpe._scan(list(ids)) == bpe._heap(list(ids))


def test_encode_documents(docs, library):
    got = sorted(tuple(r) for r in encode_documents(docs.fillna({"doc_id": 0}), PATH, True).drop(
        "decoded_sha256").collect())
    import hashlib

    wanted = []
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id or 0, len(ids), hashlib.sha256(id_bytes(ids)).hexdigest(), ids))
    assert got == sorted(wanted)


@settings(max_examples=25, deadline=None)
@given(blocks=st.lists(st.lists(st.integers(0, 65535), max_size=40), min_size=1, max_size=9))
def test_range_coder_round_trip(blocks):
    arrays = [np.array(b, np.uint32) for b in blocks]
    back = id_files.decode_blocks(id_files.encode_blocks(arrays), [len(b) for b in blocks])
    assert [b.tolist() for b in back] == blocks


def test_range_coder_learns():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 49_000, 50), 40).astype(np.uint32)
    noise = rng.integers(0, 65_536, 2000).astype(np.uint32)
    learnt, plain = id_files.encode_blocks([ids, noise])
    assert len(learnt) < len(ids) and len(plain) < 2.5 * len(noise)


def test_blocks_stand_alone():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, 300, n).astype(np.uint32) for n in (100, 7, 64)]
    together = id_files.encode_blocks(blocks)
    assert together == [id_files.encode_blocks([b])[0] for b in blocks]


def test_range_coder_is_quick_and_packs_well():
    import time

    rng = np.random.default_rng(3)
    words = rng.zipf(1.3, (400, 3)) % 40_000
    blocks = [words[rng.zipf(1.2, 350) % 400].ravel()[:1024].astype(np.uint32)
              for _ in range(512)]
    usual = time.process_time()
    sum(range(30_000_000))
    usual = time.process_time() - usual
    spent = time.process_time()
    coded = id_files.encode_blocks(blocks)
    back = id_files.decode_blocks(coded, [len(b) for b in blocks])
    spent = time.process_time() - spent
    assert all((a == b).all() for a, b in zip(back, blocks))
    ids = sum(map(len, blocks))
    assert sum(map(len, coded)) * 8 < 5.5 * ids
    # A sum of 30 million takes about a second; four nibbles an id took six times that.
    assert spent < 2.5 * usual


def test_blocks_have_a_largest_size():
    ids = np.arange(id_files._MOST, dtype=np.uint32)
    assert (id_files.decode_blocks(id_files.encode_blocks([ids]), [len(ids)])[0] == ids).all()
    with pytest.raises(ValueError, match="at most"):
        id_files.encode_blocks([np.zeros(id_files._MOST + 1, np.uint32)])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(
    "aéÉHxΣσ<|endoft>'s.,;!?1\u0331\u0301 \n\t\x1c\x85中\0", max_size=40)), min_size=1, max_size=5))
def test_pieces_are_encoded_as_the_library_does(library, texts):
    import pyarrow as pa

    memory = id_files._memory(PATH)
    ids, sizes = memory.encode(pa.array(texts, pa.string()))
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


def test_id_files(docs, library, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 64)
    files = id_files.write_ids(docs, PATH, file_ids=2000)
    got = [tuple(r) for r in id_files.read_documents(files).orderBy("start").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [r[0] for r in got] == [r[0] for r in sorted(ROWS, key=key)]
    wanted, start = Counter(), 0
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        wanted[doc_id, len(ids), zlib.crc32(id_bytes(ids))] += 1
    assert Counter((r[0], r[2], r[3]) for r in got) == wanted
    for _, at, n, _ in got:
        assert at == start
        start += n


def test_damaged_ids_are_noticed(tmp_path):
    from array import array

    import pyarrow as pa

    path = str(tmp_path / "x.ids")
    writer = id_files.Writer(pa.OSFile(path, "wb"))
    writer.add(7, array("I", range(500)))
    writer.add(None, array("I", [3]))
    writer.close()
    assert [(d, len(i)) for d, i in id_files.read_ids(pa.OSFile(path))] == [(7, 500), (None, 1)]
    data = bytearray(open(path, "rb").read())
    data[60] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="checksum"):
        list(id_files.read_ids(pa.OSFile(path)))


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, again = [], 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.append(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again,
            len(covered))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text("ab \n#\x1c\xa0é", max_size=120), st.lists(
    st.sampled_from(["a b c d e f g h ", "x\n", "a ", "\t"]), max_size=20).map("".join)))
def test_base_counts(text):
    assert quality_rules.base_counts(text) == plain_counts(text)


def test_quality_of_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in quality_rules.quality_scores(docs).collect()}
    good = duckdb.sql(f"""SELECT doc_id, quality FROM '{sf}/labels.parquet'
                          WHERE toxic = 0""").fetchall()
    for doc_id, text in docs.select("doc_id", "text").collect():
        r, counts = rows[doc_id], plain_counts(text or "")
        assert tuple(r)[1:6] == counts
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["rule"] == "ok")
    clean = [rows[i] for i, q in good if q == 1]
    assert all(r["kept"] for r in clean if not r["base_failed"])
    kept = {r["doc_id"] for r in quality_rules.keep_good_texts(docs).collect()}
    assert kept == {i for i, r in rows.items() if r["kept"]}


def test_bands_reject_repetition_and_noise():
    import zstandard

    rng = np.random.default_rng(1)
    packer = zstandard.ZstdCompressor(level=3)
    bands = quality_rules.BANDS
    noise = bytes(rng.integers(33, 126, 20_000, dtype=np.uint8))
    known = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choice(known, 6000)).encode()
    for data, rule in ((b"again " * 900, "repetitive"), (noise, "incompressible"), (b"", "ok"),
                       (b"short", "ok"), (prose[:6000], "ok")):
        ratio, bad = quality_rules.compression(data, bands, packer)
        assert quality_rules.verdict(len(data), ratio, bad, bands) == rule
    mixed = prose + b"again " * 6000
    ratio, bad = quality_rules.compression(mixed, bands, packer)
    assert bad > bands.bad_chunks


@pytest.mark.parametrize("run, rows", [
    (quality_rules.quality_scores, len(ROWS)),
    (quality_rules.keep_good_texts, 0),  # all are short or repeat themselves
    (lambda d: encode_documents(d, PATH), len(ROWS)),
    (lambda d: id_files.read_documents(id_files.write_ids(d, PATH)), len(ROWS)),
    (lambda d: ordinal.rate(d, ordinal.fit_on(d, d.selectExpr("doc_id", "1 AS grade"))), len(ROWS)),
])
def test_empty_and_clashing_columns(docs, run, rows):
    assert run(docs.limit(0)).count() == 0
    assert run(docs).count() == rows


def test_thresholds_are_ordered_and_grades_learnt():
    rng = np.random.default_rng(4)
    words = [[f"good{i}" for i in range(20)], [f"mid{i}" for i in range(20)],
             [f"bad{i}" for i in range(20)]]
    grades = rng.integers(0, 3, 600)
    rows = [ordinal.features(" ".join(rng.choice(words[2 - g], 6)) + " the a of") for g in grades]
    model = ordinal.fit(rows[:400], grades[:400])
    assert (np.diff(model.thresholds) > 0).all()
    tails = np.array([model.tails(model.score(r)) for r in rows[400:]])
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert (((tails > 0.5).sum(axis=1)) == grades[400:]).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    graded = labels.select("doc_id", ordinal.grade(labels.quality, labels.toxic).alias("grade"))
    model = ordinal.fit_on(docs, graded.where("doc_id % 3 <> 0"))
    held = ordinal.rate(docs.where("doc_id % 3 = 0"), model).join(graded, "doc_id").toPandas()
    right = (held.kept == (held.grade == 2)).mean()
    assert right > 0.95 and held[held.grade == 2].kept.mean() > 0.98
