"""Operator 3: WARC archives, a gzip member per record, and a splittable reader.

Writer: tasks turn rows into records and compress each into a gzip member of its own;
Spark's text writer puts the raw bytes into files wherever Spark can write.  That writer
ends each row with a separator; it is set to the zero byte with which a member's length
field ends, so that files are plain sequences of members.

Reader: Spark's text scan hands out byte ranges of the files (cut behind line feed bytes,
which the two bytes of the gzip magic cannot be).  A task scans its range for the magic,
validates a candidate by inflating its first bytes to a WARC header, and owns the records
that start inside.  What follows the range's last start, and what precedes its first,
are fragments; a small exchange puts them together by file, and records that cross
ranges, however many, are decoded there.  Files must not be named *.gz, for Spark's scan
would inflate these by itself and not split them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The gzip magic with the only method there is, and the empty member.
MAGIC = b"\x1f\x8b\x08"
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + b"\x00" * 8
#: Compressed bytes that are enough to inflate a header's start, and how much is fed at once.
PROBE, STEP = 1024, 16384
RECORD = "record_type string, record_id string, refers_to string, uri string, payload_bytes bigint, payload_digest string, payload binary"
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """An uncompressed record.  A revisit holds the HTTP header of what it revisits, with
    that payload's length, and no payload."""
    clean = " ".join((uri or "").split())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without its last byte, which is a zero."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return (out if out[-1] == 0 else out + EMPTY)[:-1]


def parsed(data: bytes) -> tuple | None:
    """The fields of RECORD, or None for what isn't a response or revisit record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = field.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(field.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = field.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if (own := base32_sha1(payload)) != digest:
            raise ValueError(f"payload digest of {field.get('warc-record-id')} is {own}, not {digest}")
        size = len(payload)
    else:
        lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, payload = (int(lengths[0]) if lengths else None), None
    plain = lambda s: s.strip("<>") if s else None
    return kind, plain(field.get("warc-record-id")), plain(field.get("warc-refers-to")), field.get("warc-target-uri"), size, digest, payload


class Scanner:
    """Finds and inflates members in bytes that are fed piece by piece.

    `head` gets what precedes the first validated member; `tail()` is what follows the
    last complete one."""

    def __init__(self):
        self.data, self.at, self.head, self.found = b"", 0, [], False
        self.inflate, self.out, self.raw = None, [], []

    def valid(self, at: int) -> bool | None:
        """Whether a member with a WARC header (or nothing) starts here; None: can't tell
        without the bytes that follow, which may be the next range's."""
        part = self.data[at : at + PROBE]
        z = zlib.decompressobj(31)
        try:
            got = z.decompress(part, 64)
        except zlib.error:
            return False
        if got[:5] == b"WARC/" or z.eof and not got:
            return True
        return None if len(part) < PROBE and not z.eof and b"WARC/".startswith(got[:5]) else False

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.data, self.at = self.data[self.at :] + data, 0
        while True:
            if self.inflate:
                if self.at >= len(self.data):
                    return
                part = self.data[self.at : self.at + STEP]
                self.out.append(self.inflate.decompress(part))
                if not self.inflate.eof:
                    self.raw.append(part)
                    self.at += len(part)
                    continue
                self.at += len(part) - len(self.inflate.unused_data)
                whole, self.inflate, self.out, self.raw = b"".join(self.out), None, [], []
                if whole:
                    yield whole
                continue
            i = self.data.find(MAGIC, self.at)
            ok = None if i < 0 else self.valid(i)
            if ok is None:
                # Nothing, or a candidate that needs more bytes than there are yet.
                end = i if i >= 0 else max(self.at, len(self.data) - 2)
                if not self.found:
                    self.head.append(self.data[self.at : end])
                self.at = end
                return
            end = i if ok else i + 1
            if not self.found:
                self.head.append(self.data[self.at : end])
            self.at = end
            if ok:
                self.found, self.inflate = True, zlib.decompressobj(31)

    def tail(self) -> bytes:
        return b"".join(self.raw) + self.data[self.at :]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _scan(lines: DataFrame) -> DataFrame:
    """(RECORD fields, path, start, part, bytes): part is null for a record, 0 for what
    precedes a range's first member and 1 for what follows its last complete one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scanner, done = None, Scanner(), []

        def batch(rows: list[tuple], pieces: list[tuple]) -> pa.RecordBatch:
            n, m = len(rows), len(pieces)
            cols = [pa.concat_arrays([a, pa.nulls(m, a.type)]) for a in _columns(rows)]
            ends = [pa.concat_arrays([pa.nulls(n, k), pa.array([p[i] for p in pieces], k)]) for i, k in enumerate((pa.string(), pa.int64(), pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays([*cols, *ends], names=[*NAMES, "path", "start", "part", "bytes"])

        def closed() -> list[tuple]:
            if not scanner.found:
                return [(*key, 0, b"".join(scanner.head) + scanner.tail())]
            return [(*key, 0, b"".join(scanner.head)), (*key, 1, scanner.tail())]

        for b in batches:
            values, paths, starts = b.column(0), b.column(1).to_pylist(), b.column(2).to_numpy()
            cuts = [0, *[i for i in range(1, b.num_rows) if starts[i] != starts[i - 1] or paths[i] != paths[i - 1]], b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if key != (now := (paths[lo], int(starts[lo]))):
                    if key:
                        yield batch([], closed())
                    key, scanner = now, Scanner()
                data = b"\n".join(values.slice(lo, hi - lo).to_pylist()) + b"\n"
                done = [r for r in map(parsed, scanner.feed(data)) if r]
                if done:
                    yield batch(done, [])
        if key:
            yield batch([], closed())

    return lines.mapInArrow(run, f"{RECORD}, path string, start bigint, part int, bytes binary")


def _stitched(pieces: DataFrame) -> DataFrame:
    """The records of fragments: a piece 1 and all pieces 0 that follow it in the file."""
    order = Window.partitionBy("path").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("part") == 1, F.col("start")), ignorenulls=True).over(order)
    # The window moves no bytes: it runs over the fragments' places alone.
    places = pieces.select("path", "start", "part").withColumn("owner", owner)
    rows = pieces.join(places, ["path", "start", "part"]).where("owner is not null")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("start", "ascending"), ("part", "ascending")])
        scanner = Scanner()
        found = list(scanner.feed(b"".join(group.column("bytes").to_pylist())))
        if scanner.inflate:
            raise ValueError("an archive ends inside a record")
        return pa.Table.from_arrays(_columns([r for r in map(parsed, found) if r]), names=NAMES)

    return rows.groupBy("path", "owner").applyInArrow(run, RECORD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of all archives in a folder, in no order.

    Fields as in RECORD; payload is null for revisits, payload_bytes is the full payload's
    length (of a revisit as its HTTP header states it).  Bytes between members that are no
    record are passed over, also a member with nothing inside.  An empty folder gives an
    empty result.  A response whose payload does not match its digest fails the job, and
    so does an archive that ends inside a record.
    """
    lines = spark.read.option("lineSep", "\n").schema("value string").text(path)
    lines = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    both = _scan(lines)
    return both.where("part is null").select(*NAMES).union(_stitched(both.where("part is not null").select("path", "start", "part", "bytes")))


def record_id(ids: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(ids.cast("string"), F.lit("none")))


def with_first(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, uri, payload binary, refers_to): of rows with equal payloads of at least
    least_bytes bytes the smallest id is the first, which all others refer to.

    Groups combine before the exchange, and only groups of several rows are joined back;
    Spark may split that join where one payload is very frequent."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("uri"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    both = rows.join(groups.drop("n"), "sha", "left")
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    return both.select("id", "uri", "payload", F.when(later, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> None:
    """Write pages (id_col, url, html_col) as archives of response and revisit records.

    A null html is an empty payload; a null url an empty one.  Rows with a null id are
    records `urn:page:none`, revisits if another row has their payload.  Rows that repeat
    the first's id and payload are responses too.  Other columns are not written.  An
    empty table writes no record.
    """
    rows = with_first(pages, least_bytes, id_col, html_col).select(record_id(F.col("id")).alias("rid"), "uri", "payload", F.when(F.col("refers_to").isNotNull(), record_id(F.col("refers_to"))).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = [member(record(*row)) for row in zip(*[c.to_pylist() for c in b.columns])]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = rows.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)
