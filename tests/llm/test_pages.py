"""WARC, page text, tool calls, mixing and the pipeline."""

import hashlib
import json
import random

import pyarrow as pa
import pytest
from motorgrid.llm import mixing, page_text, tool_calls, warc
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, text int, record_type string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)


BIG = "<p>é" + "x" * 1200


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ \n", BIG), (2, None, BIG), (9, "http://b", BIG), (9, "http://b", BIG),
            (3, "http://c", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (None, "u", BIG), (None, "u", "y" * 2000), (7, "u", "WARC/1.1\r\n\r\n" * 200)]
    got = sorted((tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()), key=repr)
    wanted = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if r[2] == html and r[0] is not None]
        first = max(same) if same and len(data) >= 1000 else page_id
        revisit = first != page_id
        wanted.append((page_id, len(data), hashlib.sha1(data).hexdigest(),
                       "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(wanted, key=repr)
    assert warc.round_trip(pages(spark, [])).count() == 0


def read(data):
    out = list(warc.salvage(warc.Source(pa.BufferReader(data))))
    return ([r.headers["warc-record-id"]
             for r in out if isinstance(r, warc.Record)], [g for g in out if isinstance(g, tuple)])


def parts(packed):
    out = []
    for i in range(8):
        data = warc.record(i, f"http://x/{i}", f"page {i} ".encode() * 400, None, False)
        out.append(warc.member(data) if packed else data)
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_later_records(packed):
    good = parts(packed)
    names = [warc.record_id(i) for i in range(8)]
    assert read(b"".join(good)) == (names, [])
    start = [sum(map(len, good[:i])) for i in range(9)]
    # A flipped byte in record 3.
    hurt = bytearray(b"".join(good))
    hurt[start[3] + len(good[3]) // 2] ^= 0x55
    found, gaps = read(bytes(hurt))
    assert found == names[:3] + names[4:]
    assert [g[:2] for g in gaps] == [(start[3], len(good[3]))]
    # Bytes lost across a boundary, junk between records, and a cut end.
    lost = b"".join(good[:2]) + good[2][:-30] + good[3][40:] + b"\x1f\x8b\x08junk WARC/1.1\r\n" + b"".join(
        good[4:7]) + good[7][:-9]
    found, gaps = read(lost)
    assert found == names[:2] + names[4:7]
    middle = len(good[2]) - 30 + len(good[3]) - 40 + 18
    assert [g[:2] for g in gaps] == [
        (start[2], middle), (start[2] + middle + sum(map(len, good[4:7])), len(good[7]) - 9)]
    assert read(b"") == ([], []) and read(b"no archive")[1][0][:2] == (0, 10)


def test_salvage_of_any_damage():
    rng = random.Random(7)
    for _ in range(60):
        good = parts(rng.random() < 0.5)
        data, at = bytearray(b"".join(good)), rng.randrange(3000)
        for _ in range(rng.randint(1, 60)):
            data[(at + rng.randrange(80)) % len(data)] = rng.randrange(256)
        out = list(warc.salvage(warc.Source(pa.BufferReader(bytes(data)))))
        covered = sum(g[1] for g in out if isinstance(g, tuple)) + sum(
            r.length for r in out if isinstance(r, warc.Record))
        assert covered == len(data)
        assert len([r for r in out if isinstance(r, warc.Record)]) >= 5


def test_many_records_in_one_member():
    data = b"".join(parts(False))
    assert read(warc.member(data))[0] == [warc.record_id(i) for i in range(8)]


def test_good_records_of_a_bad_member_stay():
    good, names = parts(False), [warc.record_id(i) for i in range(8)]
    hurt = [bytearray(g) for g in good]
    hurt[3][-50] ^= 1
    hurt[5][:4] = b"XXXX"
    at = [sum(map(len, good[:i])) for i in range(9)]
    packed = warc.member(b"".join(map(bytes, hurt)))
    found, gaps = read(packed + warc.member(good[0]))
    assert found == [n for i, n in enumerate(names) if i not in (3, 5)] + names[:1]
    assert gaps == [(0, len(packed), "block digest differs", at[3], len(good[3])),
                    (0, len(packed), "no member or version line", at[5], len(good[5]))]
    # A damaged or cut member: records with a sound digest come out, all its bytes are a gap.
    rng = random.Random(5)
    whole = [warc.record(i, None, rng.randbytes(3000), None, False) for i in range(200)]
    packed = bytearray(warc.member(b"".join(whole)))
    for cut in (len(packed) // 2, len(packed) - 3):
        found, gaps = read(bytes(packed[:cut]) + warc.member(good[7]))
        assert gaps == [(0, cut, "truncated member")] or gaps == [(0, cut, "damaged member")]
        assert found[-1] == names[7] and found[:-1] == [warc.record_id(i) for i in range(len(found) - 1)]
        assert len(found) >= 200 * cut // len(packed) - 3
    packed[len(packed) // 2] ^= 0x10
    found, gaps = read(bytes(packed))
    assert len(found) >= 95 and [g[:2] for g in gaps] == [(0, len(packed))]
    assert read(warc.member(b""))[1] == [(0, len(warc.member(b"")), "empty member", 0, 0)]
    other = warc.member(b"not an archive" * 50000)
    assert read(other) == ([], [(0, len(other), "no member or version line", 0, 700000)])


def test_long_members_are_streamed(monkeypatch):
    monkeypatch.setattr(warc, "MAX_RECORD", 10**6)
    rng = random.Random(6)
    text = [rng.randbytes(2000) for _ in range(1500)]
    whole = [warc.record(i, None, t, None, False) for i, t in enumerate(text)]
    out = list(warc.salvage(warc.Source(pa.BufferReader(warc.member(b"".join(whole), 1)))))
    assert [r.payload for r in out] == text
    long = [*whole[:2], warc.record(7, None, b"x" * 10**6, None, False), *whole[2:4]]
    found, gaps = read(warc.member(b"".join(long)))
    assert found == [warc.record_id(i) for i in range(4)] and [g[2:] for g in gaps] == [
        ("record too long", len(whole[0]) + len(whole[1]), len(long[2]))]
    # A header without an end is given up at its first line that is none.
    assert read(b"WARC/1.1\r\n" + b"junk\r\n" * 30000)[0] == []
    assert read(b"WARC/1.1\r\n" + b"a: b\r\n" * 30000 + b"".join(whole[:2]))[0] == [
        warc.record_id(0), warc.record_id(1)]


@pytest.mark.parametrize("n", [65_400, 70_000, 300_000])
def test_long_headers(spark, n):
    rows = [(1, "data:" + "u" * n, "page"), (2, "http://b", "other")]
    got = warc.read_archives(warc.write_archives(pages(spark, rows)))
    assert {(r["record_id"], r["target_uri"], r["reason"]) for r in got.collect()} == {
        (warc.record_id(i), u, None) for i, u, _ in rows}


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><!-- <p>ad</p> -->
<div class="top ad-box">Buy</div><main><article><header><h1>Caf&eacute; &#8217;x</h1></header>
<p>One  two<br>three &amp; four<p><b>Five<i>six</i></b> <a title="a>b">link</a>
<script>var t="</p>";</script><aside>no</aside><form>no</form><div id="comments"><p>me too</p></div>
<ul><li>a<li>b</ul></article></main><footer>&copy; all</footer></body>"""


def test_page_structure():
    kept = [line for line, main in page_text.page_lines(ARTICLE) if main]
    assert kept == ["Café ’x", "One two three & four", "Fivesix link", "a", "b"]
    assert page_text.page_lines("") == []
    assert page_text.page_lines("plain <b>text") == [("plain text", False)]
    assert page_text.page_lines("<nav>never closed <p>x") == []
    assert page_text.page_lines("<script>never closed <p>x") == []


def test_lcs():
    rng = random.Random(2)

    def length(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(600):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 20))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(0, 20))]
        found = page_text.common_lines(a, b)
        rest = iter(b)
        assert len(found) == length(a, b) and all(a[i] in rest for i in found)
    assert len(page_text.common_lines(list(range(30_000)), list(range(1, 30_001)))) == 29_999


def test_differencing_deletes_the_shared_frame(spark):
    def page(i, body):
        return f"<div>Home</div><div>About us</div><div>{body}</div><p>Rights {i // 10}</p>"

    rows = [(i, f"http://h.org/news/{i:03}?q=1", page(i, f"Story {i} " * 9)) for i in range(20)]
    rows += [(50, "http://h.org/news/003", rows[3][2]), (60, "http://other.org/", "<p>Alone</p>"),
             (61, None, "<p>No host</p>"), (62, "http://h.org/a", ARTICLE), (63, "http://h.org/b", ARTICLE),
             (64, "http://x", None), (65, "http://x", ""), (20, "http://h.org/news/0", page(0, "a b"))]
    rows.append(rows[0])
    for pages_per_slice in (128, 1000):
        got = {r["page_id"]: r for r in page_text.main_text(pages(spark, rows), pages_per_slice).collect()}
        assert page_text.main_text(pages(spark, rows), pages_per_slice).count() == len(rows)
        for i in (3, 5, 15, 50):
            assert got[i]["text"] == ("Story %d " % (3 if i == 50 else i) * 9).strip()
        assert got[60]["text"] == "Alone" and got[61]["text"] == "No host"
        assert got[62]["text"] == got[63]["text"] == "Café ’x\nOne two three & four\nFivesix link\na\nb"
        assert got[64]["text"] == got[65]["text"] == "" and got[64]["n_chars"] == 0
        assert got[62]["n_chars"] == len(got[62]["text"])
    assert page_text.main_text(pages(spark, [])).count() == 0


def test_neighbours_are_sought_in_the_whole_host(spark):
    """Copies on both sides, more of them than any slice holds, hide the neighbour that shows the frame."""
    def page(body):
        return f"<div>Home</div><div>About us</div><div>{body}</div>"

    rows = [(i, f"http://h.org/n/{i:03}", page("Same story " * 9)) for i in range(60)]
    rows += [(i, f"http://h.org/n/{i:03}", page(f"Near {i} " + "words " * 99)) for i in range(100, 140)]
    rows += [(200, "http://h.org/zz", page("Other text")), (300, "http://i.org/1", page("Alone"))]
    for pages_per_slice in (4, 128):
        got = {r["page_id"]: r["text"] for r in page_text.main_text(pages(spark, rows), pages_per_slice).collect()}
        assert len(got) == len(rows)
        assert all(got[i] == ("Same story " * 9).strip() for i in range(60))
        assert all(got[i] == (f"Near {i} " + "words " * 99).strip() for i in range(100, 140))
        assert got[200] == "Other text" and got[300] == "Home\nAbout us\nAlone"


def test_differencing_decides_on_pages_with_an_article(spark):
    """Lines outside an article stay unless the nearest page has them as well, however large the frame is."""
    def page(body, article):
        return f"<div>{'Menu ' * 50}</div><div>{body}</div><article><p>{article}</p></article><p>Imprint</p>"

    rows = [(i, f"http://h.org/n/{i:03}", page(f"Body {i}", f"Card {i}")) for i in range(30)]
    # Copies of an article, pages without lines beside them, and a host with no other page.
    rows += [(i, f"http://h.org/p/{i:03}", page(f"Place {i}", "Same card")) for i in range(40, 60)]
    rows += [(i, f"http://h.org/p/{i - 20:03}", html) for i, html in ((60, None), (61, ""), (62, "<nav>x</nav>"))]
    rows += [(70, "http://i.org/", "<div>Alone</div><main>Text</main>")]
    for pages_per_slice in (4, 128):
        got = {r["page_id"]: r["text"] for r in page_text.main_text(pages(spark, rows), pages_per_slice).collect()}
        assert len(got) == len(rows)
        assert all(got[i] == f"Body {i}\nCard {i}" for i in range(30))
        assert all(got[i] == f"Place {i}\nSame card" for i in range(40, 60))
        assert got[60] == got[61] == got[62] == "" and got[70] == "Alone\nText"


def test_pages_of_the_small_table(spark):
    """The pages were made from texts of documents: each main text is one, below its heading."""
    sf = "/root/testdata/sf0.01"
    squeeze = lambda t: "\n".join(" ".join(x.split()) for x in t.split("\n") if x.split())
    texts = {squeeze(r[0]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()}
    got = page_text.main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(got) == 250
    assert all(r["text"].split("\n", 1)[1] in texts for r in got)


CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, depends_on array<string>, level int"
RESULTS = "conv_id long, call_id string, turn long, content string, level int"


def link(spark, calls, results):
    made = tool_calls.link_calls(
        spark.createDataFrame([(*c, 0) for c in calls], CALLS),
        spark.createDataFrame([(*r, 0) for r in results], RESULTS), tool_calls.TOOLS)
    return {(r["conv_id"], r["call_id"] or (r["status"] if r["conv_id"] == 2 else None)): r
            for r in made.collect()}


def test_tool_calls(spark):
    ok = '{"limit": 3, "query": "q"}'
    got = link(spark, [
        (1, "b", 2, "search", ok, ["a"]), (1, "a", 5, "search", ok, []), (1, "a", 6, "write", ok, []),
        (1, "c", 1, "lookup", '{"fields": {"z": [1, {"b": 2, "a": 1.50}]}, "extra": null}', ["a", "b", "no"]),
        (1, "x", 1, "write", "{bad", ["y"]), (1, "y", 1, "write", "[1]", ["x"]), (1, "z", 1, None, None, ["y"]),
        (1, "self", 1, "none", "{}", ["self"]), (None, "n", 1, "write", '{"text": 1}', None),
        (2, None, 1, "search", '{"limit": "3", "query": "é\\"\\n"}', None)], [
        (1, "a", 9, "late"), (1, "a", 7, "first"), (1, "gone", 1, None), (None, "n", 1, "r"), (2, None, 1, "r")])
    assert [got[1, k]["position"] for k in "abc"] == [0, 1, 2]
    assert got[1, "a"]["copies"] == 2 and got[1, "a"]["status"] == "ok"
    assert json.loads(got[1, "a"]["linked"])["result"] == "first"
    assert got[1, "b"]["status"] == "no result" and got[1, "b"]["errors"] == ""
    assert got[1, "c"]["errors"] == "extra: unknown; fields: not array; key: missing; depends_on: missing"
    assert got[1, "c"]["linked"] == (
        '{"arguments":{"extra":null,"fields":{"z":[1,{"a":1.5,"b":2}]}},"call_id":"c",'
        '"depends_on":["a","b","no"],"result":null,"tool":"lookup"}')
    for k in ("x", "y", "z", "self"):
        assert got[1, k]["status"] == "cycle" and got[1, k]["position"] is None
    assert got[1, "x"]["errors"] == "arguments: not JSON"
    assert got[1, "y"]["errors"] == "arguments: not an object"
    assert got[1, "gone"]["status"] == "no call"
    assert got[None, "n"]["errors"] == "text: not string" and got[None, "n"]["status"] == "ok"
    # A call and a result without ids do not meet.
    assert {k for c, k in got if c == 2} == {"no result", "no call"}
    assert link(spark, [], []) == {}


def test_turns_in_order_need_no_levels(spark):
    calls = [(c, f"c{i}", i, "write", '{"text": "t"}', [f"c{i - 1}", f"c{i - 2}"]) for c in (1, None)
             for i in range(300)]
    frame = spark.createDataFrame([(*c, 0) for c in calls], CALLS)
    assert {r["rank"] for r in tool_calls.ranks(frame).collect()} == {0}
    got = link(spark, calls, [])
    assert [got[1, f"c{i}"]["position"] for i in range(300)] == list(range(300))


def longest(calls):
    """Level per (conv_id, call_id), None on or behind a cycle, by plain passes."""
    needs = {(c, k): [(c, n) for n in set(d or []) if n is not None] for c, k, _, _, _, d in calls}
    needs = {k: [n for n in v if n in needs] for k, v in needs.items()}
    found = {}
    while True:
        ready = {k: max((found[n] + 1 for n in v), default=0) for k, v in needs.items()
                 if k not in found and all(n in found for n in v)}
        if not ready:
            return {k: found.get(k) for k in needs}
        found.update(ready)


@pytest.mark.parametrize("block", [1024, 16])
def test_every_conversation_is_ordered_by_level(spark, monkeypatch, block):
    monkeypatch.setattr(tool_calls, "BLOCK_CALLS", block)
    rng = random.Random(8)
    calls = []
    for conv in (1, 2, None):
        ids = [f"c{i}" for i in range(60)]
        rank = rng.sample(range(60), 60) if conv == 1 else list(range(60))
        for i in ids:
            below = [k for k in ids if rank[int(k[1:])] < rank[int(i[1:])]]
            calls.append((conv, i, int(i[1:]), "write", '{"text": "t"}',
                          rng.sample(below, min(len(below), rng.randint(0, 3)))))
    calls += [(3, f"d{i}", i, "write", '{"text": "t"}', [f"d{(i + 1) % 30}"] if i < 30 else [f"d{i - 1}"] * (i > 31))
              for i in range(40)]
    got, want = link(spark, calls, []), longest(calls)
    assert {k: r["level"] for k, r in got.items()} == want
    assert max(v for k, v in want.items() if k[0] == 1 and v is not None) > 5
    for conv in (1, 2, None, 3):
        inside = sorted((want[c[0], c[1]], c[2], c[1]) for c in calls if c[0] == conv and want[c[0], c[1]] is not None)
        assert [got[conv, k]["position"] for _, _, k in inside] == list(range(len(inside)))
    assert {r["status"] for k, r in got.items() if want[k] is None} == {"cycle"}


def test_two_dependencies_of_a_long_conversation(spark):
    # Neither dependency follows from the other, so no edge is the chain; one in seven points forward.
    calls = [(1, f"c{i}", i, "write", '{"text": "t"}',
              [f"c{k}" for k in ((i - 2, i - 3) if i % 7 else (i - 3, i + 1)) if 0 <= k < 400])
             for i in range(400)]
    got, want = link(spark, calls, []), longest(calls)
    assert {k: r["level"] for k, r in got.items()} == want


def test_long_chains_are_ordered(spark):
    calls = [(1, f"c{i}", 0, "write", '{"text": "t"}', [f"c{i - 1}"] if i else []) for i in range(120)]
    calls += [(1, f"d{i}", 0, "write", '{"text": "t"}', [f"d{i - 1}", f"c{i}"] if i else []) for i in range(6)]
    got = link(spark, calls, [])
    frame = spark.createDataFrame([(*c, 0) for c in calls], CALLS)
    levels = {r["call_id"]: r["rank"] for r in tool_calls.ranks(frame).collect()}
    assert [levels[f"c{i}"] for i in range(120)] == list(range(120))
    assert [levels[f"d{i}"] for i in range(6)] == [0, 2, 3, 4, 5, 6]
    places = {k[1]: r["position"] for k, r in got.items()}
    assert sorted(places.values()) == list(range(126))
    assert all(places[d] < places[c[1]] for c in calls for d in c[5])


DOCS = "doc_id long, text string, source string, lang string, n_chars long, probability string"


def test_raking_reaches_the_targets(spark):
    rng = random.Random(1)
    rows = [(s, l, t, rng.randint(1, 5000)) for s in "abc" for l in ("en", "de") for t in "xyz"
            if rng.random() < 0.9] + [("a", "fr", "x", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 5, "b": 3, "c": 2, "none": 4}, "lang": {"en": 1, "de": 1},
               "topic": {"x": 1, "y": 2, "z": 1}}
    raked = mixing.rake(cells, targets, sweeps=40).toPandas()
    for name, wanted in targets.items():
        shares = raked.groupby(name).weight.sum()
        total = sum(v for k, v in wanted.items() if k in shares.index)
        for k, v in shares.items():
            assert v == pytest.approx(wanted[k] / total, abs=1e-6)
    only = mixing.rake(cells, {"source": {"a": 1}}, sweeps=12).toPandas()
    assert only[only.source != "a"].weight.sum() == 0


def test_sampling(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 300)), rng.choice("aaab"), rng.choice(["en", "en", "de", None]), 1, "p")
            for i in range(6000)] + [(None, None, None, None, None, None), (7000, "", "a", "en", 0, None)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = {"source": {"a": 1, "b": 1}, "lang": {"en": 2, "de": 1, "": 1}}
    out = mixing.report(docs, targets).toPandas()
    assert len(out) == len(rows) and out[out.n_tokens == 0].kept.sum() == 0
    assert out.probability.max() == 1.0
    kept = out[out.kept]
    shares = kept.groupby("source").n_tokens.sum() / kept.n_tokens.sum()
    assert shares["a"] == pytest.approx(0.5, abs=0.05)
    left = mixing.sample(docs, targets)
    assert left.schema == docs.schema and left.count() == len(kept)
    assert mixing.sample(docs.limit(0)).count() == 0


def test_tiny_cells_do_not_set_the_scale(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(50, 90)), rng.choice("ab"), "en", 1, "p") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_p", F.lit(1)).withColumn("_ratio", F.lit(2))
    tiny = docs.limit(1).withColumns({"doc_id": F.lit(9000).cast("long"), "source": F.lit("z"), "text": F.lit("w w")})
    targets = {"source": {"a": 0.5, "b": 0.49, "z": 0.01}}
    both = docs.unionByName(tiny)
    left = mixing.sample(both, targets)
    assert left.columns == docs.columns and left.count() > 2700
    assert left.where("doc_id = 9000").count() == 1
    for r in mixing.shares_reached(both, targets).collect():
        assert abs(r["target"] - r["expected"]) < mixing.CLIP
    # Without clipping the tiny cell would take nearly all others away.
    assert mixing.mix(both, targets, clip=0.0).where("_mix_kept").count() < 300


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    import duckdb
    from motorgrid.llm import quality_rules
    from motorgrid.llm.common import settle
    from test_dedup import lowered, staying
    import zstandard
    from motorgrid.llm.bpe import Bpe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    packer = zstandard.ZstdCompressor(level=3)

    def good(text):
        n, *_, again = quality_rules.base_counts(text)
        data = text.encode()
        rule = quality_rules.verdict(len(data), *quality_rules.compression(
            data, quality_rules.BANDS, packer), quality_rules.BANDS)
        return n >= 20 and 100 * again <= 30 * n and rule == "ok"

    wanted = {i for i, r in rows.items() if good(r["text"])}
    last = {lowered(rows[i]["text"]): i for i in sorted(wanted)}
    steps = [wanted, set(last.values())]
    steps.append(staying([(i, rows[i]["text"]) for i in steps[1]], corpus_pipeline.NEAR_WORDS,
                        corpus_pipeline.NEAR_BITS, corpus_pipeline.NEAR_SIMILARITY))
    for (name, stage), want in zip(corpus_pipeline.STAGES, [*steps, None, None]):
        docs = settle(stage(spark, docs, sf), f"test-{name}")
        found = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "mixing":
            con = duckdb.connect()
            table = pa.table({c: [rows[i][c] for i in sorted(want or steps[-1])] for c in columns})
            con.register("documents", table)
            want = {r[0] for r in con.execute(mixing.sql()).fetchall() if r[-1]}
            mixed = want
        if name == "bpe":
            want = mixed
            bpe = Bpe(corpus_pipeline.VOCABULARY)
            for r in docs.collect():
                assert r["token_ids"] == bpe.encode(rows[r["doc_id"]]["text"])
        else:
            assert docs.columns == columns
        assert found == want and docs.count() == len(want)
    assert corpus_pipeline.run(spark, sf).count() == len(mixed)
