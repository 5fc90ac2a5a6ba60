"""WARC archives: a writer with revisit records, and a salvage reader.

The writer puts one record per row into gzip-per-record archives under a shared folder.  Each task names its files
freshly and returns their paths; the list of paths is committed through Spark's own writer, so a task that ran twice (a
lost executor, speculation) adds nothing twice: files of attempts that did not commit are never read.

The reader checks version line, headers, length and digests of every record.  When a check fails it searches for the
next gzip member or version line that starts a whole valid record, goes on from there, and logs the bytes in between as
a gap.  A member is inflated record by record, however many it holds (an archive gzipped as a whole is one member); its
records and the gaps between them have the bounds of the member.  Records found before the place where a member is
damaged have its start alone, and the gap starts there too.  The reader holds a few records at a time.

Defined cases: a null payload is empty; a null id is written as such and read back as null; an empty table makes no
archive; rows that repeat id and payload are all responses when the id is the group's smallest; of equal payloads, rows
without an id revisit the smallest id, and are responses where none of them has one; extra columns are ignored.  Headers
may be of any length: they are read in steps until they end.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.shared import fresh_path, materialize

_ID = "urn:trellis:row:"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.I)
_STEP = 1 << 18

RECORDS = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()), T.StructField("reason", T.StringType()),
    ]
)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, row_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None = None) -> bytes:
    """One record; a revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{row_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_revisits(df: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Columns id, url, payload, refers_to: of equal payloads of at least ``min_bytes`` the smallest id stays a response.

    The groups are counted with partial aggregates and joined back by digest, which adaptive execution can split.
    """
    payload = F.coalesce(F.encode(df[payload_col].cast("string"), "UTF-8"), F.lit(b""))
    rows = df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(groups.select("sha", "size", "first_id"), ["sha", "size"], "left")
    return joined.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write rows (id, url, payload, refers_to) to ``folder``; returns the committed list of archives (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, written, n = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row_id, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    path, written, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = member(record("response" if refers is None else "revisit", row_id, url, payload, digest(payload), refers))
                out.write(data)
                written, n = written + len(data), n + 1
                if written >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return materialize(rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long"), "warc-list")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    end: int


class Broken(ValueError):
    """A record that fails a check."""


class Damaged(Broken):
    """A gzip member that cannot be inflated to its end."""


def parse_record(data: bytes) -> Record:
    """The record that ``data`` starts with, wholly checked, and its end."""
    if not _VERSION.match(data):
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Broken("no end of headers")
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Broken("no length")
    if missing := [h for h in ("warc-type", "warc-record-id", "warc-date") if not headers.get(h)]:
        raise Broken(f"no {missing[0]}")
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    if len(block) < int(headers["content-length"]):
        raise Broken("short block")
    if data[end + 4 + len(block) :][:4] != b"\r\n\r\n":
        raise Broken("no end of record")
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha1:") and named[5:] != digest(block):
        raise Broken("block digest differs")
    return Record(headers, block, end + 4 + len(block) + 4)


class _Member:
    """The records of the gzip member at ``at``, inflated as far as they are asked for."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size = file, at, size
        self.z, self.pos, self.tail = zlib.decompressobj(31), at, b""
        self.held, self.taken = bytearray(), 0
        self.damage = ""

    @property
    def end(self) -> int:
        return self.pos - len(self.z.unused_data)

    def _more(self) -> bool:
        """Inflate a step; False at the end of the member."""
        if self.z.eof:
            return False
        if not self.tail:
            self.file.seek(self.pos)
            self.tail = self.file.read(min(_STEP, self.size - self.pos))
            self.pos += len(self.tail)
        last = not self.tail
        try:
            out = self.z.decompress(self.tail, _STEP)
        except zlib.error as e:
            raise Damaged(f"bad member: {e}") from None
        if last and not out and not self.z.eof:
            raise Damaged("cut member")
        self.tail = self.z.unconsumed_tail
        self.held += out
        return True

    def _drop(self, n: int) -> None:
        del self.held[:n]
        self.taken += n

    def whole(self) -> tuple[int, int, str]:
        """The end of the member, the size of its data, and what is wrong with it, from a pass of its own."""
        if not hasattr(self, "_whole"):
            other = _Member(self.file, self.at, self.size)
            try:
                while other._more():
                    other._drop(len(other.held))
            except Damaged as e:
                other.damage = str(e)
            self._whole = other.end, other.taken + len(other.held), other.damage
        return self._whole

    def _need(self, n: int) -> bool:
        # a false length must not fill the memory
        if n - len(self.held) > 4 * _STEP and self.taken + n > self.whole()[1]:
            return False
        while len(self.held) < n and self._more():
            pass
        return len(self.held) >= n

    def _take(self) -> Record:
        """The next record."""
        self._need(10)
        if not _VERSION.match(self.held):
            raise Broken("no version line")
        end = at = 0
        while (end := self.held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.held) - 3)
            if not self._more():
                break
        found = _LENGTH.search(self.held, 0, end + 2) if end >= 0 else None
        n = end + 4 + int(found[1]) + 4 if found else len(self.held)
        if not self._need(n):
            raise Damaged(self.whole()[2]) if self.whole()[2] else Broken("short block")
        found = parse_record(bytes(self.held[:n]))
        self._drop(found.end)
        return found

    def _skip(self) -> None:
        """To the next version line, or the end."""
        at = 1
        while (hit := self.held.find(b"WARC/1.", at)) < 0:
            if len(self.held) > 6:
                self._drop(len(self.held) - 6)
                at = 0
            if not self._more():
                self._drop(len(self.held))
                return
        self._drop(hit)

    def records(self) -> Iterator[tuple[Record | None, str]]:
        """(record, reason), None for a gap.  A record counts when what follows it, or the member's end, is sound."""
        before, lost = None, ""
        try:
            while self._need(1):
                try:
                    found = self._take()
                except Damaged:
                    raise
                except Broken as e:
                    if before:
                        yield before, ""
                    before, lost = None, lost or str(e)
                    self._skip()
                    continue
                if before:
                    yield before, ""
                if lost:
                    yield None, lost
                before, lost = found, ""
        except Damaged as e:
            self.damage = str(e)
            if before and _VERSION.match(self.held):
                yield before, ""
            return
        if before:
            yield before, ""
        if lost:
            yield None, lost


def _plain_at(file, at: int, size: int) -> tuple[bytes, int]:
    """The uncompressed record at ``at``, and its end."""
    file.seek(at)
    head, seen = bytearray(file.read(min(_STEP, size - at))), 0
    if not _VERSION.match(head):
        raise Broken("no record here")
    while (end := head.find(b"\r\n\r\n", seen)) < 0 and at + len(head) < size:
        seen = max(0, len(head) - 3)
        head += file.read(min(len(head), size - at - len(head)))
    found = _LENGTH.search(head, 0, end + 2) if end >= 0 else None
    if not found:
        raise Broken("no record here")
    length = end + 4 + int(found[1]) + 4
    if at + length > size:
        raise Broken("cut record")
    file.seek(at)
    return file.read(length), at + length


def _next_start(file, at: int, size: int) -> int:
    """Where, from ``at`` on, a member or a version line may begin; ``size`` if nowhere."""
    while at < size:
        file.seek(at)
        chunk = file.read(min(_STEP, size - at))
        hits = [x for x in (chunk.find(_MAGIC), chunk.find(b"WARC/1.")) if x >= 0]
        if hits:
            return at + min(hits)
        if at + len(chunk) >= size:
            break
        at += len(chunk) - 8
    return size


def salvage(file, size: int) -> Iterator[tuple[int, int, Record | None, str]]:
    """(start, end, record, reason) of an open archive, in order; record is None for a gap of unreadable bytes."""
    at = gap = 0
    reason = ""
    while at < size:
        file.seek(at)
        lead = file.read(3)
        try:
            if lead == _MAGIC:
                member = _Member(file, at, size)
                items = member.records()
                some = list(itertools.islice(items, 2))  # of two in a row, one is a record
                if not any(found for found, _ in some):
                    raise Broken(member.damage or next((why for _, why in some), "empty member"))
                end, _, damage = member.whole() if len(some) > 1 else (member.end, 0, member.damage)
            else:
                data, end = _plain_at(file, at, size)
                some, items, damage = [(parse_record(data), "")], (), ""
        except Broken as e:
            reason = reason or str(e)
            at = _next_start(file, at + 1, size)
            continue
        if gap < at:
            yield gap, at, None, reason
        for found, why in itertools.chain(some, items):
            if found or not damage:
                yield at, at if damage else end, found, why
        if damage:
            gap, reason = at, damage
            at = _next_start(file, at + 1, size)
        else:
            at = gap = end
            reason = ""
    if gap < size:
        yield gap, size, None, reason


def _row(path: str, start: int, end: int, found: Record | None, reason: str, with_payload: bool) -> dict:
    row = dict.fromkeys(RECORDS.names) | {"path": path, "start": start, "end": end, "record_type": "gap", "reason": reason or None}
    if found is None:
        return row
    h = found.headers
    head, _, payload = found.block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", head)
    kind = h.get("warc-type")
    row |= {"record_type": kind, "record_id": h.get("warc-record-id", "").strip("<>"), "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to", "").strip("<>") or None}
    if kind == "revisit":
        return row | {"payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": int(stated[1]) if stated else None}
    own = digest(payload)
    if h.get("warc-payload-digest", f"sha1:{own}") != f"sha1:{own}":
        row["reason"] = "payload digest differs"
    return row | {"payload_digest": own, "payload_bytes": len(payload), "payload": payload if with_payload else None}


def read_archives(archives: DataFrame, with_payload: bool = True, most_tasks: int = 10_000) -> DataFrame:
    """Records and gaps (record_type 'gap') of the archives named in column ``path``; see RECORDS.

    An archive is read by one task; beyond ``most_tasks`` archives, tasks read several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), *((n, pa.string()) for n in RECORDS.names[3:8]), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, where = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
                rows, held = [], 0
                with fs.open_input_file(where) as file:
                    for start, end, found, reason in salvage(file, file.size()):
                        rows.append(_row(path, start, end, found, reason, with_payload))
                        held += len(rows[-1]["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = archives.count()
    return archives.select("path").repartition(min(max(1, n), most_tasks)).mapInArrow(run, RECORDS)


def row_id(column) -> F.Column:
    """The id in a record id made by this writer."""
    return F.substring(column, len(_ID) + 1, 30).try_cast("long")


def round_trip(spark: SparkSession, df: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Write every row as a record, read the archives back; see RECORDS."""
    folder = fresh_path(spark, "warc")
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    archives = write_archives(with_revisits(df, id_col, url_col, payload_col, min_bytes), folder)
    if scheme and scheme != "file://":
        host = folder.partition("://")[2].partition("/")[0] if scheme == "hdfs://" else ""
        archives = archives.withColumn("path", F.concat(F.lit(scheme + host), F.col("path")))
    return read_archives(archives, with_payload=False)
