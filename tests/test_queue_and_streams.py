import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from motorgrid.operators import crawlqueue, live
from motorgrid.operators.skew import cut_by_ranges
from motorgrid.streaming import jobs

T0 = datetime(2024, 1, 1)
NOW = F.lit("2024-06-01 00:00:00").cast("timestamp")
EVENTS = "url string, source string, kind string, action string, error string, ts timestamp, seq bigint"


def _history(n_urls=25, n=600, seed=1):
    rng = random.Random(seed)
    actions = ["enqueue", "done", "failed", "failed", "failed", "dead", "requeue"]
    rows = []
    for i in range(n):
        # A third of all events belong to one URL.
        url = "hot" if i % 3 == 0 else f"u{rng.randrange(n_urls)}"
        rows.append((url, "bat", "listing", rng.choice(actions), rng.choice([None, f"e{i}"]),
                     T0 + timedelta(minutes=7 * i + rng.randrange(3)), i))
    return rows


def _replay(rows, start):
    """One event after the other."""
    state = {u: dict(status="pending", attempts=0, error=None, due=t) for u, t in start.items()}
    for url, _, _, action, error, ts, _ in sorted(rows, key=lambda r: (r[5], r[6])):
        row = state.get(url)
        if row is None:
            if action == "enqueue":
                state[url] = dict(status="pending", attempts=0, error=None, due=ts)
            continue
        if action == "done":
            row.update(status="done", error=None)
        elif action == "failed":
            row["attempts"] += 1
            row.update(status="dead" if row["attempts"] >= 5 else "failed", error=error,
                       due=ts + timedelta(seconds=min(2 ** row["attempts"], 3600)))
        elif action == "dead":
            row.update(status="dead", error=error if error is not None else row["error"])
        elif action == "requeue":
            row.update(status="pending", attempts=0, error=None, due=ts)
    return state


def _states(df):
    return {r.url: dict(status=r.status, attempts=r.attempts, error=r.last_error, due=r.next_try_at)
            for r in df.collect()}


def _start(spark, urls):
    df = spark.createDataFrame([(u, "bat", "listing") for u in urls], "url string, source string, kind string")
    return crawlqueue.new_items(df, F.lit(T0))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_replay(spark, seed):
    rows = _history(seed=seed)
    start = ["u1", "u2", "idle"]
    got = _states(crawlqueue.fold_events(_start(spark, start), spark.createDataFrame(rows, EVENTS)))
    assert got == _replay(rows, dict.fromkeys(start, T0))


def test_fold_stream_over_several_files(spark, tmp_path):
    rows = _history(n=300)
    for i in range(3):
        spark.createDataFrame(rows[100 * i:100 * i + 100], EVENTS).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.queue_stream(stream, str(tmp_path / "out"), _start(spark, ["u1"]))
    query.awaitTermination()
    got = _states(jobs.latest_state(spark, str(tmp_path / "out"), query))
    assert got == _replay(rows, {"u1": T0})


PRED = "slot string, ts timestamp, seq bigint, label string, class_id string, confidence double"


def _predictions(n=400, seed=4):
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"s{rng.randrange(5)}", T0 + timedelta(seconds=i // 2), i,
             label := rng.choice("abc"), "c" + label, rng.randrange(8) / 8) for i in range(n)]


def _vote_by_hand(rows):
    out, history = {}, {}
    for slot, _, seq, label, cid, conf in sorted(rows, key=lambda r: (r[1], r[2])):
        last = history.setdefault(slot, [])
        last.append((label, cid, conf))
        del last[:-8]
        tally = []
        for name in {x[0] for x in last}:
            own = [x for x in last if x[0] == name]
            tally.append((-len(own), -sum(x[2] for x in own) / len(own), name, own[0][1]))
        best = min(tally)
        out[seq] = (best[2], best[3], -best[1])
    return out


def _votes(df):
    return {r.seq: (r.smoothed_label, r.smoothed_class_id, r.smoothed_confidence) for r in df.collect()}


@pytest.mark.parametrize("block_rows", [8, 50, 200_000])
def test_smoothing(spark, block_rows):
    rows = _predictions()
    df = spark.createDataFrame(rows, PRED)
    got = live.smooth_predictions(df, block_rows=block_rows)
    assert _votes(got) == _vote_by_hand(rows)


def test_smoothing_stream_equals_batch(spark, tmp_path):
    rows = _predictions(300)
    for i in range(4):
        spark.createDataFrame(rows[75 * i:75 * i + 75], PRED).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(PRED).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.smooth_stream(stream, str(tmp_path / "out")).awaitTermination()
    assert _votes(jobs.smoothed_rows(spark, str(tmp_path / "out"))) == _vote_by_hand(rows)


def _stream_of(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return jobs.read_stream(spark, f"{folder}/in", spark.createDataFrame([], schema), files_per_batch=1)


def test_late_predictions_go_to_the_side(spark, tmp_path):
    def row(seq, label, second):
        return ("s", T0 + timedelta(seconds=second), seq, label, "c" + label, 0.5)

    batches = [[row(1, "a", 10), row(2, "b", 11)], [row(3, "a", 5), row(4, "a", 12), row(5, "b", 11)],
               [row(6, "b", 13)], [("other", T0, 7, "x", "cx", 0.5)]]
    stream = _stream_of(spark, tmp_path, batches, PRED)
    jobs.smooth_stream(stream, str(tmp_path), ttl_ms=None).awaitTermination()
    assert {r.seq for r in jobs.smoothed_rows(spark, str(tmp_path), late=True).collect()} == {3}
    on_time = [r for b in batches for r in b if r[2] != 3]
    assert _votes(jobs.smoothed_rows(spark, str(tmp_path))) == _vote_by_hand(on_time)


def _state_bytes(folder):
    return {str(p): p.stat().st_size for p in (folder / "offsets" / "state").rglob("*") if p.is_file()}


def test_a_batch_writes_its_own_keys_only(spark, tmp_path):
    """After 20,000 keys in the first batch, a batch of two keys adds few rows and few bytes of state."""
    many = [(f"k{i}", i) for i in range(20_000)]
    schema = "k string, n int"
    stream = _stream_of(spark, tmp_path, [many, [("k5", -1), ("new", 1)]], schema)
    jobs.ingest_stream(stream, str(tmp_path), "k", ["n"]).awaitTermination()
    before = _state_bytes(tmp_path)
    spark.createDataFrame([("new", 0), ("newer", 2), ("k7", -9)], schema).coalesce(1).write.parquet(
        f"{tmp_path}/in/2")
    again = jobs.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema), files_per_batch=1)
    done = jobs.ingest_stream(again, str(tmp_path), "k", ["n"])
    done.awaitTermination()
    assert [p["numInputRows"] for p in done.recentProgress if p["numInputRows"]] == [3]
    added = {p: n for p, n in _state_bytes(tmp_path).items() if p not in before}
    assert sum(n for p, n in added.items() if p.endswith(".changelog")) < 20_000
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 20_002 and rows.where("n < 0").count() == 0


def test_queue_stream_writes_touched_urls_only(spark, tmp_path):
    start = _start(spark, [f"u{i}" for i in range(50)])
    events = [(f"u{i}", "bat", "listing", "failed", "e", T0 + timedelta(hours=i), i) for i in range(4)]
    stream = _stream_of(spark, tmp_path, [[e] for e in events], EVENTS)
    jobs.queue_stream(stream, str(tmp_path), start).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [
        "u0", "u1", "u2", "u3"]
    left = jobs.latest_state(spark, str(tmp_path))
    assert left.columns == start.columns and left.count() == 50
    assert left.where("attempts = 1").count() == 4 and left.where("status = 'failed'").count() == 4


def test_ingest_stream_across_batches(spark, tmp_path):
    for i, keys in enumerate((["a", "b", "a"], ["b", "c"], ["c", "d", "a"])):
        spark.createDataFrame([(k, 10 * i + j) for j, k in enumerate(keys)], "k string, n int").coalesce(
            1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema("k string, n int").option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.ingest_stream(stream, str(tmp_path / "out"), "k", ["n"]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "out")).collect()
    assert sorted((r.k, r.n) for r in got) == [("a", 0), ("b", 1), ("c", 11), ("d", 21)]


def test_a_busy_second_is_dealt_out_evenly(spark):
    """All rows of one slot at one time: ranges of like size, and the votes of one history."""
    rows = spark.range(40_000).select(
        F.lit("s").alias("slot"), F.lit(T0).alias("ts"), F.col("id").alias("seq"),
        F.concat(F.lit("l"), F.pmod(F.hash("id"), F.lit(3))).alias("label"), F.lit("c").alias("class_id"),
        F.lit(0.5).alias("confidence"))
    # Spark would merge ranges as small as these.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = cut_by_ranges(rows, ["slot"], ["ts", "seq"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    pieces = [r["count"] for r in ranged.groupBy("_piece").count().collect()]
    assert len(pieces) > 1 and max(pieces) < 3 * 40_000 / len(pieces)
    got = {r.seq: r.smoothed_label for r in live.smooth_predictions(rows, block_rows=5000).collect()}
    labels = [r.label for r in rows.orderBy("seq").collect()]
    for i in (0, 5, 4999, 5000, 5001, 39_999):
        last = labels[max(0, i - 7):i + 1]
        assert got[i] == min(set(last), key=lambda x: (-last.count(x), x))


def test_detection(spark):
    rows = [(1, 1, "car", 0.5, 2.0, 2.0), (1, 2, "truck", 0.9, 3.0, 1.0), (1, 3, "bird", 1.0, 9.0, 9.0),
            (2, 4, "bus", 0.14, 9.0, 9.0), (3, 6, "car", 0.15, 1.0, 1.0), (3, 5, "car", 0.15, 1.0, 1.0)]
    df = spark.createDataFrame(
        rows, "frame_id int, detection_id int, label string, confidence double, width double, height double")
    got = {r.frame_id: r.detection_id for r in live.most_prominent(df).collect()}
    assert got == {1: 2, 3: 5}


def test_claim_order_and_death(spark):
    q = _start(spark, ["s", "l", "i"]).withColumn(
        "kind", F.when(F.col("url") == "s", "search").when(F.col("url") == "l", "listing").otherwise("image"))
    batch = crawlqueue.next_batch(q, 2, NOW).collect()
    assert [r.url for r in batch] == ["i", "l"]
    claimed = crawlqueue.claim_batch(q, 2, NOW)
    assert {r.url for r in claimed.where("status = 'in_progress'").collect()} == {"i", "l"}
    assert crawlqueue.next_batch(claimed, 5, NOW).count() == 1
    errors = spark.createDataFrame([("i", "boom"), ("unknown", "x")], "url string, error string")
    failing = q
    for n in range(1, 6):
        failing = crawlqueue.mark_failed(failing, errors, NOW)
        row = failing.where("url = 'i'").first()
        assert row.attempts == n and row.status == ("dead" if n == 5 else "failed")
    assert failing.count() == 3 and crawlqueue.next_batch(failing, 5, NOW).count() == 2
    back = crawlqueue.requeue(failing, errors.select("url"), NOW).where("url = 'i'").first()
    assert (back.status, back.attempts, back.last_error) == ("pending", 0, None)


def test_enqueue_first_wins(spark):
    rows = spark.createDataFrame(
        [("a", "bat", "listing", "p1"), ("b", "bat", "image", "p2"), ("b", "bat", "image", "p1")],
        "url string, source string, kind string, parent_listing_id string")
    out = crawlqueue.enqueue(_start(spark, ["a"]), rows, NOW, ["parent_listing_id"])
    got = {r.url: (r.kind, r.parent_listing_id, r.enqueued_at) for r in out.collect()}
    assert got["b"][:2] == ("image", "p1") and got["a"][2] == T0 and len(got) == 2


class _Entries(dict):
    """A map state in memory."""

    def getMapState(self, *args, **options):  # noqa: N802
        return self

    getValue = dict.get  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815


def test_one_call_handles_all_keys_of_a_bucket():
    import pandas as pd
    from pyspark.sql import types as T

    from motorgrid.streaming import state

    fold = state.QueueRow()
    entries = _Entries()
    fold.init(entries)
    rows = pd.DataFrame([(u, "bat", "listing", a, None, i, i) for i, (u, a) in enumerate(
        [("u", "enqueue"), ("v", "enqueue"), ("u", "failed"), ("w", "done")])],
        columns=["url", "source", "kind", "action", "error", "us", "seq"])
    changed = pd.concat(list(fold.handleInputRows((1,), iter([rows]), None)))
    assert dict(zip(changed["url"], changed["status"])) == {"u": "failed", "v": "pending"}
    assert set(entries) == {("u",), ("v",)}
    recent = state.RecentPredictions(3, None, T.StringType())
    entries = _Entries()
    recent.init(entries)
    rows = pd.DataFrame([(s, "l" + s, "c", 0.5, i, i) for i, s in enumerate("abaabb")],
                        columns=["slot", "label", "class_id", "confidence", "us", "seq"])
    got = pd.concat(list(recent.handleInputRows((1,), iter([rows]), None)))
    assert dict(zip(got["seq"], got["_n"])) == {0: 1, 1: 1, 2: 2, 3: 3, 4: 2, 5: 3}
    assert set(entries) == {("a",), ("b",)} and entries["b",][4] == [4, 5]


def test_first_of_a_batch_with_null_keys(spark):
    from motorgrid.streaming.state import first_of_batch

    rows = spark.createDataFrame([("a", 3), (None, 5), ("a", 1), (None, 4), ("b", None), ("b", 9)], "k string, n int")
    assert sorted((str(r.k), r.n) for r in first_of_batch(rows, "k", ["n"]).collect()) == [
        ("None", 4), ("a", 1), ("b", 9)]


def test_slots_share_entries_of_the_state():
    """500 slots over three batches: the rows of a call per slot, by far fewer calls; silent slots are forgotten."""
    import pandas as pd
    from pyspark.sql import types as T

    from motorgrid.streaming import state

    class Clock:
        ms = 0

        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return self.ms

    class Counted(_Entries):
        calls = 0

        def getValue(self, key):  # noqa: N802
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self.calls += 1
            self[key] = value

    rng = random.Random(5)
    one, packed = state.RecentPredictions(3, None, T.StringType()), state.PackedPredictions(3, 1000, T.StringType())
    entries, clock = Counted(), Clock()
    one.init(_Entries())
    packed.init(entries)

    def both(rows):
        frame = pd.DataFrame(rows, columns=["slot", "label", "class_id", "confidence", "us", "seq"])
        return [pd.concat(list(p.handleInputRows((1,), iter([frame]), clock))) for p in (one, packed)]

    for batch in range(3):
        clock.ms = 400 * batch
        slots = [None if i == 7 else f"s{i}" for i in range(500) if batch == 0 or i % (batch + 1) == 1] * 2
        before = entries.calls
        rows = [(s, rng.choice("abc"), "c", 0.5, 100 * batch + i, i) for i, s in enumerate(slots)]
        left, right = both(rows)
        pd.testing.assert_frame_equal(left, right)
        assert entries.calls - before < 150
    assert (packed.n_slots, packed.n_chunks) == (500, 8)
    clock.ms = 1500
    row = [(s, "a", "c", 0.5, 10_000, 0) for s in ("s3", "s4", "s0", "new")]
    assert list(both(row)[1].sort_values("slot")["_n"]) == [1, 1, 1, 3]
