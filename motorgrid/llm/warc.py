"""WARC archives: a writer and a salvage reader.

The writer stores one gzip member per record. The reader checks every member (its gzip checksum, the
record's framing, block and payload digests). After a failed check it searches for the next member or
version line that starts a valid record, goes on from there, and reports the bytes in between as a gap.
Members of many records are searched in the same way, in their unpacked bytes, as a stream.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid.llm.common import settle, shared_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Payloads shorter than this are always stored.
LEAST_REVISIT = 1000
FILE_BYTES = 32 * 2**20
# A record is held in memory whole; longer ones are quarantined.
MAX_RECORD = 2**30
_HEAD = 1 << 16
_STEP = 1 << 18
_PIECE = 1 << 14
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: int | None) -> str:
    return f"<urn:x-page:{'' if name is None else name}>"


def record(name: int | None, url: str | None, payload: bytes, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC record; a revisit carries the HTTP head (with the full length) but no payload."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {record_id(name)}", f"WARC-Date: {DATE}"]
    if url:
        safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response",
              f"WARC-Payload-Digest: {base32_sha1(payload)}",
              f"WARC-Block-Digest: {base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """The data as one gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Bad(Exception):
    """A failed check; ``end`` is where the damaged record surely ends, if that is known."""

    def __init__(self, reason: str, end: int | None = None) -> None:
        super().__init__(reason)
        self.reason, self.end = reason, end


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    payload_bytes: int = 0
    checked: bool = False


class Source:
    """Bytes of a file by position, through one block that is read ahead."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.start, self.block = file, 0, b""
        self.size = file.size()

    def at(self, pos: int, n: int) -> bytes:
        skip = pos - self.start
        if skip < 0 or skip + n > len(self.block):
            n = max(0, min(n, self.size - pos))
            if skip < 0 or skip + n > len(self.block):
                self.file.seek(pos)
                self.start, skip = pos, 0
                self.block = self.file.read(max(n, _STEP))
        return self.block[skip:skip + n]

    def release(self, pos: int) -> None:
        """Bytes before ``pos`` are not asked for again."""


class Member:
    """Unpacked bytes of the gzip member at ``start``, read forwards; what is released is forgotten.

    ``size`` is known at the end: then ``reason`` says what is wrong with the member (None if its
    checksum holds) and ``next`` where it ends in the file. From ``careful`` on, the position before
    the piece that an earlier attempt failed on, input is taken byte by byte, so that all that can
    be unpacked before the damage is.
    """

    def __init__(self, source: Source, start: int, careful: int | None = None) -> None:
        self.source, self.next, self.careful = source, start, careful
        self.unpack = zlib.decompressobj(31)
        self.low, self.held = 0, bytearray()
        self.size: int | None = None
        self.reason: str | None = None

    def more(self) -> None:
        data = self.unpack.unconsumed_tail
        if not data:
            step = _PIECE
            if self.careful is not None:
                step = max(1, min(step, self.careful - self.next))
            data = self.source.at(self.next, step)
            self.next += len(data)
        try:
            out = self.unpack.decompress(data, _STEP)
        except zlib.error:
            self.careful = self.next - len(data)
            return self._close("damaged member")
        self.held += out
        if self.unpack.eof:
            self.next -= len(self.unpack.unused_data)
            self._close(None)
        elif not data and not out:
            self._close("truncated member")

    def _close(self, reason: str | None) -> None:
        self.reason, self.size = reason, self.low + len(self.held)

    def at(self, pos: int, n: int) -> bytes:
        while self.size is None and self.low + len(self.held) < pos + n:
            self.more()
        with memoryview(self.held) as view:
            return bytes(view[pos - self.low:pos - self.low + n])

    def release(self, pos: int) -> None:
        del self.held[:pos - self.low]
        self.low = pos


def _headers(source: Source | Member, pos: int) -> tuple[dict[str, str], int]:
    """Fields of the record header at ``pos``, of any length, and where its block begins."""
    size, data, cut = _HEAD, b"", -1
    while cut < 0:
        data = source.at(pos, size)
        cut = data.find(b"\r\n\r\n")
        lines = data[:cut if cut >= 0 else data.rfind(b"\r\n") + 1].split(b"\r\n")
        if not data.startswith(b"WARC/1.") or (cut < 0 and len(data) < size):
            raise Bad("no record header")
        if any(b":" not in line for line in lines[1:] if cut >= 0 or line.strip()):
            raise Bad("malformed header line")
        if cut < 0 and size > MAX_RECORD:
            raise Bad("record too long")
        size *= 2
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return headers, pos + cut + 4


def read_record(source: Source | Member, pos: int) -> tuple[Record, int]:
    """The record at ``pos`` and where it ends; Bad if any check fails."""
    headers, start = _headers(source, pos)
    told = headers.get("content-length", "")
    if not (told.isascii() and told.isdigit()):
        raise Bad("no content length")
    size = int(told)
    if size > MAX_RECORD:
        raise Bad("record too long")
    end = start + size + 4
    data = source.at(start, size + 4) if source.size is None or end <= source.size else b""
    if data[size:] != b"\r\n\r\n":
        raise Bad("block does not end where its length says")
    block = data[:size]
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not headers.get("content-type", "").startswith("application/http") or not blank:
        head, payload = b"", block
    kind = headers.get("warc-type", "")
    whole, part = (headers.get(f"warc-{n}-digest") for n in ("block", "payload"))
    if whole is not None and whole != base32_sha1(block):
        raise Bad("block digest differs", end)
    count = len(payload)
    if kind == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        count, part = int(told[1]) if told else 0, None
    elif part is not None and part != base32_sha1(payload):
        raise Bad("payload digest differs", end)
    return Record(pos, end - pos, headers, payload, count, whole is not None), end


Gap = tuple[int, int, str] | tuple[int, int, str, int, int]


def _in_member(source: Source, pos: int
               ) -> tuple[Iterator[Record | Gap], int | None, str | None]:
    """Records and gaps of the gzip member at ``pos``, its end and what is wrong with it.

    The member is unpacked once to learn that, and a second time for its records unless it was short
    enough to be kept. Of a damaged member only records count whose block digest holds.
    """
    member, whole = Member(source, pos), True
    while member.size is None:
        member.more()
        if len(member.held) > _STEP:
            member.release(member.low + len(member.held))
            whole = False
    end, reason = (None if member.reason else member.next), member.reason
    unpacked = member.size
    if reason or not whole:
        member = Member(source, pos, member.careful if reason else None)

    def items() -> Iterator[Record | Gap]:
        length = 0 if end is None else end - pos
        for item in _walk(member, False):
            if isinstance(item, Record):
                if reason is None or (item.checked and member.at(item.offset + item.length, 1)):
                    item.offset, item.length = pos, length
                    yield item
            elif reason is None:
                yield pos, length, item[2], *item[:2]
        if not unpacked and reason is None:
            yield pos, length, "empty member", 0, 0

    return items(), end, reason


def _walk(source: Source | Member, members: bool) -> Iterator[Record | Gap]:
    pos, gap, told = 0, None, ""
    while start := source.at(pos, 3):
        source.release(pos)
        items, end, reason = iter(()), None, "no member or version line"
        if members and start == _MAGIC:
            items, end, reason = _in_member(source, pos)
        elif start == b"WAR":
            try:
                found, end = read_record(source, pos)
                items, reason = iter([found]), None
            except Bad as bad:
                end, reason = bad.end, bad.reason
        if reason is None and gap is not None:
            yield gap, pos - gap, told
            gap = None
        yield from items
        if reason is not None and gap is None:
            gap, told = pos, reason
        if end is None:
            pos = _next_start(source, pos + 1, _START if members else _VERSION)
            continue
        pos = end
        if gap is not None:
            yield gap, pos - gap, told
            gap = None
    if gap is not None:
        yield gap, pos - gap, told


def salvage(source: Source) -> Iterator[Record | Gap]:
    """Records of a file in order, and the bytes given up: (offset, length, reason).

    A record that fails inside a sound member is a gap of five values: range of the member, reason,
    and offset and length in its unpacked bytes. A damaged member is part of a gap; the records that
    its bytes still hold come before that gap, with a length of 0.
    """
    return _walk(source, True)


def _next_start(source: Source | Member, pos: int, start: re.Pattern) -> int:
    while block := source.at(pos, _STEP):
        source.release(pos)
        hit = start.search(block)
        if hit:
            return pos + hit.start()
        if len(block) < _STEP:
            break
        pos += _STEP - 8
    return pos + len(block)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, _payload, _revisit, _refers_to: which pages repeat the payload of another.

    Of equal payloads of at least ``least`` bytes the largest page_id is stored (all rows of it, if
    it is repeated; a null page_id only if there is no other), the others refer to it.
    """
    staged = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("_payload"))
    staged = staged.withColumn("_digest", F.unhex(F.sha2("_payload", 256)))
    shared = staged.where(F.octet_length("_payload") >= least).groupBy("_digest").agg(
        F.max("page_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1").select(
        F.col("_digest").alias("_shared"), "_first")
    # Sort-merge at every size; AQE splits the rows of a hot payload.
    joined = staged.join(shared.hint("merge"), F.col("_digest") == F.col("_shared"), "left")
    revisit = F.col("_shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "_payload", revisit.alias("_revisit"),
                         F.when(revisit, F.col("_first")).alias("_refers_to"))


def _writer(folder: str, file_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, path, size, rows = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [path], "records": [rows], "bytes": [size]},
                pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "_payload", "_refers_to",
                                                 "_revisit")]
            for row in zip(*columns):
                name, url, payload, refers_to, revisit = (v.as_py() for v in row)
                if out is None:
                    # Every attempt of a task has files of its own; only those of the attempt that
                    # Spark commits are in the list that is returned.
                    name_of = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, rows = f"{folder}/{name_of}", 0, 0
                    out = store.open_output_stream(f"{base}/{name_of}", compression=None)
                data = member(record(name, url, payload, refers_to, revisit))
                out.write(data)
                size, rows = size + len(data), rows + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES
                   ) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html; null html is empty) into ``folder``, a URI
    that all executors reach; returns the list of files (path, records, bytes).

    An empty table gives an empty list; columns other than these three are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return settle(with_revisits(pages).mapInArrow(
        _writer(folder, file_bytes), "path string, records long, bytes long"), "warc-list")


_READ = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
    ("inner_offset", pa.int64()), ("inner_length", pa.int64()), ("record_type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_READ_SQL = ("path string, offset long, length long, reason string, inner_offset long, "
             "inner_length long, record_type string, record_id string, target_uri string, "
             "refers_to string, payload_digest string, payload_bytes long, payload binary")


def _reader(with_payload: bool) -> Callable:
    def row(path: str, item: Record | Gap) -> tuple:
        if isinstance(item, tuple):
            return (path, *item, *[None] * (12 - len(item)))
        h = item.headers
        kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "")
        try:
            digest = base64.b32decode(digest.removeprefix("sha1:")).hex()
        except ValueError:
            digest = None
        return (path, item.offset, item.length, None, None, None, kind, h.get("warc-record-id"),
                h.get("warc-target-uri"), h.get("warc-refers-to"), digest, item.payload_bytes,
                item.payload if with_payload and kind != "revisit" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, base = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(base) as file:
                    for item in salvage(Source(file)):
                        rows.append(row(path, item))
                        held += 200 + (len(rows[-1][-1] or b""))
                        if held > 2**23:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in ``files`` (path), one task per few files.

    A gap has a ``reason`` and no record columns; ``offset`` and ``length`` are its bytes in the file
    (for records, those of their member). A record that failed inside a sound member has its bytes
    in the unpacked member as ``inner_offset`` and ``inner_length``. The payload of a revisit is null, its ``payload_bytes`` are
    those of the full payload.
    """
    tasks = max(1, min(4096, files.count()))
    return files.select("path").repartition(tasks, "path").mapInArrow(
        _reader(with_payload), _READ_SQL)


def page_number(name: str) -> Column:
    """The page_id in a record id."""
    return F.expr(f"try_cast(regexp_extract({name}, '^<urn:x-page:(-?[0-9]+)>$', 1) as long)")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive ``pages`` and read the archives back: page_id, payload_bytes, payload_digest (SHA-1,
    hex), record_type and refers_to per page, repeated rows as often as they came."""
    read = read_archives(write_archives(pages, folder), with_payload=False)
    return read.where("reason is null").select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", page_number("refers_to").alias("refers_to"))
