"""Keyed state of the streaming jobs: recent predictions per slot, a queue row per URL, keys seen.

The state lives in Spark's RocksDB store. A micro-batch loads and writes the keys that occur in it and no
others; its changes are logged, so a replayed batch gives the same rows. Python is called once per bucket of
keys, not per key: a bucket is a map state, whose entries are the keys. A bucket's rows of one micro-batch
are handled together, so the trigger bounds them.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from motorgrid import constants as K

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
# Buckets of a keyed state; a checkpoint is bound to the number.
BUCKETS = 1024
# Slots of a bucket that share an entry of its state, at most on average.
CHUNK_SLOTS = 64


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB with changelogs: a batch uploads its changes, not a snapshot of everything."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _by_key(frame: pd.DataFrame, key: str, order: list[str]) -> tuple[pd.DataFrame, np.ndarray, list]:
    """The rows sorted by key and order, the number of each row's key, and the keys as the state takes them."""
    codes, keys = pd.factorize(frame[key], use_na_sentinel=False)
    at = frame.assign(_code=codes).sort_values(["_code", *order], kind="stable", ignore_index=True)
    plain = [_plain(k) for k in keys.tolist()]
    whole = [int(k) if isinstance(k, float) else k for k in plain] if frame[key].dtype.kind == "f" else plain
    return at.drop(columns="_code"), at["_code"].to_numpy(), whole


class RecentPredictions(StatefulProcessor):
    """Adds to every prediction the last ones of its slot, itself included, and whether it is late.

    ``_label0`` and so on is the prediction itself, ``_label1`` the one before it; ``_n`` tells how many
    there are. A prediction is late if it comes, by (us, seq), no later than one of an earlier batch; it
    gets no history and changes none. A slot that stays silent for ``ttl_ms`` is forgotten.
    """

    FIELDS = ("label", "class_id", "confidence", "us", "seq")
    HISTORY = {"label": "string", "class_id": "string", "confidence": "double"}

    def __init__(self, window: int, ttl_ms: int | None, slot: T.DataType) -> None:
        self.window, self.ttl_ms, self.slot = window, ttl_ms, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getMapState(
            "recent", T.StructType().add("slot", self.slot), "label array<string>, class_id array<string>, "
            "confidence array<double>, us array<bigint>, seq array<bigint>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
                        ) -> Iterator[pd.DataFrame]:
        frame, codes, slots = _by_key(pd.concat(list(rows), ignore_index=True), "slot", ["us", "seq"])
        us, seq = frame["us"].to_numpy(), frame["seq"].to_numpy()
        held: dict[str, list] = {name: [] for name in self.FIELDS}
        held_code: list[int] = []
        known_us, known_seq = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        known = np.zeros(len(slots), bool)
        for code, before in enumerate(self._load(slots, timerValues)):
            if before is not None:
                for name, values in zip(self.FIELDS, before):
                    held[name] += values
                held_code += [code] * len(before[3])
                known[code], known_us[code], known_seq[code] = True, before[3][-1], before[4][-1]
        first = known_us[codes]
        late = known[codes] & ((us < first) | ((us == first) & (seq <= known_seq[codes])))
        # Held rows come before the new ones of their slot, as those that do not are late.
        n_held, fresh = len(held_code), np.flatnonzero(~late)
        code = np.concatenate((np.array(held_code, np.int64), codes[fresh]))
        columns = {name: np.concatenate((
            np.array(held[name], frame[name].to_numpy().dtype), frame[name].to_numpy()[fresh])) for name in self.FIELDS}
        order = np.argsort(code, kind="stable")
        code, source = code[order], order - n_held
        columns = {name: values[order] for name, values in columns.items()}
        starts = np.searchsorted(code, np.arange(len(slots) + 1))
        place = np.arange(len(code)) - starts[code]
        mine = source >= 0
        target = fresh[source[mine]]
        added: dict[str, Any] = {"late": late, "_n": np.zeros(len(frame), np.int32)}
        added["_n"][target] = np.minimum(place[mine] + 1, self.window)
        for k in range(self.window):
            has = mine & (place >= k)
            for name in self.HISTORY:
                values = np.full(len(frame), np.nan) if name == "confidence" else np.full(len(frame), None, object)
                values[fresh[source[has]]] = columns[name][np.flatnonzero(has) - k]
                added[f"_{name}{k}"] = values
        lists = {name: values.tolist() for name, values in columns.items()}
        ends = starts[1:].tolist()
        begins = np.maximum(starts[:-1], starts[1:] - max(1, self.window - 1)).tolist()
        self._save(slots, [tuple(lists[name][begin:end] for name in self.FIELDS) for begin, end in zip(begins, ends)])
        yield pd.concat([frame.drop(columns=["us", "_bucket"], errors="ignore"), pd.DataFrame(added)], axis=1)

    def close(self) -> None:
        pass

    def _load(self, slots: list, timer: Any) -> list[tuple | None]:
        """What is held of each slot."""
        return [self.recent.getValue((slot,)) for slot in slots]

    def _save(self, slots: list, values: list[tuple]) -> None:
        for slot, value in zip(slots, values):
            self.recent.updateValue((slot,), value)


class PackedPredictions(RecentPredictions):
    """The same with up to ``CHUNK_SLOTS`` slots in one entry of the state, as a call per slot would be most
    of the work. Entries are split in two when the slots of the bucket become more, one at a time, so a slot
    costs no more than its entry, however many there are."""

    SIZE = -1  # the entry that tells the number of chunks and of slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk int", "packed binary", ttlDurationMs=self.ttl_ms)

    def _get(self, chunk: int) -> Any:
        held = self.chunks.getValue((chunk,))
        return None if held is None else pickle.loads(bytes(held[0]))

    def _put(self, chunk: int, held: Any) -> None:
        self.chunks.updateValue((chunk,), (pickle.dumps(held, protocol=4),))

    def _alive(self, chunk: int) -> tuple[dict, int]:
        """The slots of a chunk that are not forgotten, and how many are; the entry outlives them."""
        held = self._get(chunk) or {}
        alive = {slot: (ms, value) for slot, (ms, value) in held.items()
                 if self.ttl_ms is None or ms + self.ttl_ms > self.now}
        return alive, len(held) - len(alive)

    def _load(self, slots: list, timer: Any) -> list[tuple | None]:
        self.n_chunks, self.n_slots = self._get(self.SIZE) or (1, 0)
        self.now = timer.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0
        self.places = [_place(slot) % self.n_chunks for slot in slots]
        self.open = {}
        for chunk in sorted(set(self.places)):
            self.open[chunk], gone = self._alive(chunk)
            self.n_slots -= gone
        return [self.open[chunk].get(slot, (0, None))[1] for chunk, slot in zip(self.places, slots)]

    def _save(self, slots: list, values: list[tuple]) -> None:
        for chunk, slot, value in zip(self.places, slots, values):
            self.n_slots += slot not in self.open[chunk]
            self.open[chunk][slot] = (self.now, value)
        for chunk, held in self.open.items():
            self._put(chunk, held)
        while self.n_slots > CHUNK_SLOTS * self.n_chunks:
            # Forgotten slots may still be counted.
            self.n_slots = sum(len(self._alive(chunk)[0]) for chunk in range(self.n_chunks))
            if self.n_slots <= CHUNK_SLOTS * self.n_chunks // 2:
                break
            for chunk in range(self.n_chunks):
                held, _ = self._alive(chunk)
                for part in (chunk, chunk + self.n_chunks):
                    self._put(part, {slot: entry for slot, entry in held.items()
                                     if _place(slot) % (2 * self.n_chunks) == part})
            self.n_chunks *= 2
        self._put(self.SIZE, (self.n_chunks, self.n_slots))


class QueueRow(StatefulProcessor):
    """Folds the events of a URL into its queue row and returns the row where it changed.

    Columns: url, source, kind, status, attempts, last_error, next_us, enqueued_us, claimed_us and
    changes, which counts the returned rows of the URL.
    """

    FIELDS = ("source", "kind", "status", "attempts", "last_error", "next_us", "enqueued_us",
              "claimed_us", "changes")
    SCHEMA = ("source string, kind string, status string, attempts int, last_error string, "
              "next_us bigint, enqueued_us bigint, claimed_us bigint, changes bigint")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getMapState("row", "url string", self.SCHEMA)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for url, *values in zip(*(initialState[c].tolist() for c in ("url", *self.FIELDS))):
            self.row.updateValue((_plain(url),), _whole(values))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
                        ) -> Iterator[pd.DataFrame]:
        frame, codes, urls = _by_key(pd.concat(list(rows), ignore_index=True), "url", ["us", "seq"])
        events = list(zip(*(frame[c].tolist() for c in ("source", "kind", "action", "error", "us"))))
        starts = np.searchsorted(codes, np.arange(len(urls) + 1)).tolist()
        changed = []
        for code, url in enumerate(urls):
            held = self.row.getValue((url,))
            state = None if held is None else dict(zip(self.FIELDS, held))
            touched = False
            for source, kind, action, error, us in events[starts[code]:starts[code + 1]]:
                if state is None:
                    if action == "enqueue":
                        state = dict(source=source, kind=kind, status="pending", attempts=0, last_error=None,
                                     next_us=us, enqueued_us=us, claimed_us=None, changes=0)
                        touched = True
                elif action != "enqueue":
                    state.update(_after(action, _plain(error), us, state))
                    touched = True
            if touched:
                state["changes"] += 1
                values = _whole([state[f] for f in self.FIELDS])
                self.row.updateValue((url,), values)
                changed.append((url, *values))
        if changed:
            yield pd.DataFrame(changed, columns=["url", *self.FIELDS]).astype(
                {f: "Int64" for f in ("next_us", "enqueued_us", "claimed_us", "changes", "attempts")})

    def close(self) -> None:
        pass


def _place(slot: Any) -> int:
    """A number for a slot that is the same in every process."""
    return zlib.crc32(repr(slot).encode())


def _plain(value: Any) -> Any:
    """A value that the state takes: null for what pandas calls missing, Python's own numbers."""
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def _whole(row: list) -> tuple:
    """A queue row as the state takes it: pandas makes floats of whole numbers beside nulls."""
    return tuple(int(v) if isinstance(v, float) else v for v in map(_plain, row))


def _after(action: str, error: str | None, us: int, row: dict) -> dict:
    """What an event changes in the row of a known URL."""
    if action == "done":
        return dict(status="done", last_error=None)
    if action == "failed":
        attempts = row["attempts"] + 1
        wait = int(min(2.0 ** min(attempts, 60), K.BACKOFF_CAP_SECONDS))
        return dict(status="dead" if attempts >= K.DEAD_AFTER_ATTEMPTS else "failed", attempts=attempts,
                    last_error=error, next_us=us + wait * SECOND)
    if action == "dead":
        return dict(status="dead", last_error=row["last_error"] if error is None else error)
    if action == "requeue":
        return dict(status="pending", attempts=0, last_error=None, next_us=us, claimed_us=None)
    return {}


def first_of_batch(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key by ``order`` in each micro-batch; nulls come last.

    All rows of a key in a micro-batch lie in one task, which holds one row per key, and as many more
    before it sorts them again.
    """
    names = stream.columns

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        sorted_rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) > max(2 * sorted_rows, 100_000):
                held = [reduced(held)]
                sorted_rows = held[0].num_rows
        if held:
            yield from reduced(held).to_batches()

    def reduced(tables: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(tables).sort_by([(c, "ascending") for c in order])
        places = rows.select([key]).append_column("_place", pa.array(np.arange(rows.num_rows)))
        return rows.take(places.group_by(key).aggregate([("_place", "min")])["_place_min"]).select(names)

    return stream.repartition(F.col(key)).mapInArrow(firsts, stream.schema)


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: Any,
          start: DataFrame | None = None, expires: bool = False) -> DataFrame:
    """``stream`` through ``processor``, one entry of its map state per value of ``key``; ``expires`` if
    entries have a time to live. The rows have their bucket in ``_bucket``."""
    use_rocksdb(stream.sparkSession)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def grouped(rows: DataFrame) -> Any:
        return rows.withColumn("_bucket", bucket).groupBy("_bucket")

    return grouped(stream).transformWithStateInPandas(
        processor, schema, "Append", "ProcessingTime" if expires else "None",
        initialState=None if start is None else grouped(start))
