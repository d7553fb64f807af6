"""WARC archives: a writer through Spark's own file writer and a salvaging reader.

*Writer.* Each record becomes a gzip member of its own. Spark's text writer puts the members
into files of any Hadoop file system; its line separator is one zero byte, and the last byte
of a member of under 16 MB is zero anyway (the high byte of its length), so that byte is left
to the writer and the files are plain concatenated members. Longer members are followed by one
zero byte, which gzip readers skip.

An archive ends at ``ARCHIVE_BYTES``. Only the payloads of repeated digests are shuffled, one a task.

*Reader.* Archives come whole from the ``binaryFile`` source (so one of over 2 GiB must be split
before) and are parsed in Python, a member at a time; members are inflated piece by piece, what has
been read is dropped, so a member may inflate to any size. A record must have a version line, a
length, its closing blank lines and, where the header states one, the right block digest. After a
failed check the reader searches for the next member or version line that passes all checks, goes
on from there and logs the bytes between as a quarantined gap. The same is done inside a member's
inflated bytes, and inside what inflates before the damage of a member that is cut off or has a
wrong checksum; but where such a member inflates to exactly one record, its failed check counts as
the record's, which is quarantined. Else nothing valid before or after damage is lost.

Edge cases: null payloads are empty; null URLs have no header line; null ids give an empty id;
control characters in header values are percent-coded; repeated rows are records of their own, and
so are several rows of the largest id among equal payloads, all of them responses; a payload is
held whole (up to the 2 GiB of a cell); empty tables write an archive folder without records and
read back as an empty table. Further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.bitmap import bitmap, in_bitmap
from notelake.storage import fresh_path, materialize, table

#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: An archive takes no further record from this size on.
ARCHIVE_BYTES = 1 << 28
LEVEL, CHUNK, OUT_BYTES = 1, 1 << 16, 1 << 24
#: Bytes that are fed at once near the damage of a member.
STEP = 64
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DDL = "archive string, start long, stop long, kind string, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload binary"
_FIELDS = [x.split()[0] for x in RECORD_DDL.split(", ")]
_ARROW = pa.schema([pa.field(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k]) for n, k in (x.split() for x in RECORD_DDL.split(", "))])


def _header_value(x: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def record_bytes(record_type: str, record_id: str, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of its payload, but not the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if record_type == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(records: DataFrame, path: str) -> None:
    """Writes rows (record_type, record_id, url, payload: binary, size, digest, refers_to) to ``path``.

    The payload of a revisit may be null; ``size`` is its length. Each task numbers its archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = written = 0
        for b in batches:
            out, at, held = [], [], 0
            for cells in zip(*(b.column(k) for k in range(7)), strict=True):
                kind, rid, url, payload, size, digest, refers = (c.as_py() for c in cells)
                m = member(record_bytes(kind, rid, url, payload or b"", size, digest, refers))
                if written >= ARCHIVE_BYTES:
                    archive, written = archive + 1, 0
                out.append(m[:-1] if m[-1] == 0 else m)
                at.append(archive)
                held, written = held + len(m), written + len(m)
                if held >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["part", "member"])
                    out, at, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["part", "member"])

    made = records.select("record_type", "record_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, "part int, member binary")
    made.select("part", F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").partitionBy("part").text(path)


class Damaged(ValueError):
    pass


@dataclass
class Record:
    record_type: str | None
    record_id: str | None
    target_uri: str | None
    refers_to: str | None
    payload_digest: str | None
    payload: bytes


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _bare(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace").strip().removeprefix("<").removesuffix(">")


def parse_record(data: bytes | bytearray, at: int, more: Callable[[], bool] = lambda: False) -> tuple[Record, int]:
    """The record at ``at`` and where it ends; ``Damaged`` if a check fails.

    ``more`` lengthens ``data`` in place, or says that there is no more."""
    while len(data) - at < 10 and more():
        pass
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    close = data.find(b"\r\n\r\n", at)
    while close < 0:
        seen = len(data)
        if not more():
            raise Damaged("header without end")
        close = data.find(b"\r\n\r\n", max(at, seen - 3))
    fields = {}
    for line in bytes(data[at:close]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        raise Damaged("no content length")
    start = close + 4
    stop = start + int(length)
    while len(data) < stop + 4 and more():
        pass
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record without end")
    block = bytes(data[start:stop])
    algorithm, _, want = fields.get(b"warc-block-digest", b"").partition(b":")
    if algorithm.lower() == b"sha1":
        made = hashlib.sha1(block)
        if want.lower() != made.hexdigest().encode() and want != base64.b32encode(made.digest()):
            raise Damaged("block digest differs")
    payload = block
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    kind = fields.get(b"warc-type")
    digest = fields.get(b"warc-payload-digest")
    return Record(kind.decode("utf-8", "replace") if kind else None, _bare(fields.get(b"warc-record-id")), _bare(fields.get(b"warc-target-uri")), _bare(fields.get(b"warc-refers-to")), _bare(digest.rpartition(b":")[2]) if digest else None, payload), stop + 4


class Inflating:
    """A gzip member that is inflated as far as it is asked for; ``held`` are the bytes from ``base`` on.

    Before damage it gives all that inflates; ``lost`` says then what ails it."""

    def __init__(self, data: bytes, at: int):
        self.data, self.begin, self.pos, self.z = data, at, at, zlib.decompressobj(31)
        self.held, self.base = bytearray(), 0
        self.over, self.lost = False, None

    def more(self) -> bool:
        if self.over:
            return False
        before, step = self.z.copy(), CHUNK
        while True:
            chunk = self.data[self.pos : self.pos + step]
            if not chunk:
                self.over, self.lost = True, self.lost or "member is cut off"
                return False
            try:
                made = self.z.decompress(chunk)
            except zlib.error as e:
                self.lost = f"member: {e}"
                if step == 1:
                    self.over = True
                    return False
                self.z, step = before, STEP if step > STEP else 1  # up to the byte that fails
                before = self.z.copy()
                continue
            self.pos += len(chunk)
            self.held += made
            if self.z.eof:
                self.over, self.pos = True, self.pos - len(self.z.unused_data)
            if made or self.over:
                return True
            if step < CHUNK:
                before = self.z.copy()

    def drop(self, at: int) -> None:
        del self.held[: at - self.base]
        self.base = at

    def place(self, made: int) -> int:
        """Where in the data the step begins with which ``made`` bytes were there."""
        z, pos, total, step = zlib.decompressobj(31), self.begin, 0, CHUNK
        while pos < len(self.data):
            before = z.copy()
            try:
                size = len(z.decompress(self.data[pos : pos + step]))
            except zlib.error:
                size = made  # the damage is in this step
            if total + size < made:
                total, pos = total + size, pos + step
            elif step == CHUNK:
                z, step = before, STEP
            else:
                break
        return pos


def inner_records(stream: Inflating) -> Iterator[tuple[int, int, Record | str]]:
    """As ``salvage_bytes``, of inflated bytes, which are dropped as they have been read."""
    at, gap, why = 0, None, ""
    while at < stream.base + len(stream.held) or stream.more():
        try:
            record, end = parse_record(stream.held, at - stream.base, stream.more)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at, following = at + 1, None
            while not (following := _VERSION.search(stream.held, at - stream.base)):
                at = max(at, stream.base + len(stream.held) - 9)  # a version line may be cut here
                stream.drop(at)
                if not stream.more():
                    at = stream.base + len(stream.held)
                    break
            if following:
                at = stream.base + following.start()
            stream.drop(at)
            continue
        end += stream.base
        if gap is not None:
            yield gap, at, why
            gap = None
        yield at, end, record
        at = end
        stream.drop(at)
    if gap is not None:
        yield gap, stream.base + len(stream.held), why


def member_records(data: bytes, at: int) -> Iterator[tuple[int, Record | str] | tuple[int, None, str | None]]:
    """(stop, record or inner gap) of the gzip member at ``at``; at last where to go on, null, and
    what ails the member if its rest is lost. ``Damaged``, before anything is given, if nothing in it
    passes."""
    stream, waiting, given, stop = Inflating(data, at), [], False, 0
    for a, b, x in inner_records(stream):
        waiting.append((a, b, x))
        if isinstance(x, Record):
            stop = b
            if given or len(waiting) > 1:  # a lone record waits for the member's checksum
                yield from ((stream.pos, _inner(*w)) for w in waiting)
                given, waiting = True, []
        elif stop and not given:  # more than one record inflated
            yield stream.pos, waiting.pop(0)[2]
            given = True
    if not given and (stream.lost or (waiting and not stop)):
        raise Damaged(stream.lost or waiting[0][2])
    if not stream.lost:
        yield from ((stream.pos, _inner(*w)) for w in waiting)
        yield stream.pos, None, None
    else:  # after the last record that passed; what can't be read after it is one gap
        yield max(at + 1, stream.place(stop)), None, stream.lost


def _inner(a: int, b: int, x: Record | str) -> Record | str:
    return x if isinstance(x, Record) else f"bytes {a} to {b} of the member: {x}"


def salvage_bytes(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(start, stop, record) for each valid record, (start, stop, reason) for each gap.

    Both are places in ``data``; what is inside a member has the member's start, and as stop how far
    the member was read by then; a gap in it says where it is."""
    at, gap, why = 0, None, ""
    while at < len(data):
        if gap is None and data[at] == 0:  # padding between members
            at += 1
            continue
        lost = None
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                for x in member_records(data, at):
                    if gap is not None:
                        yield gap, at, why
                        gap = None
                    if x[1] is None:
                        end, _, lost = x
                    else:
                        yield at, *x
            else:
                x, end = parse_record(data, at)
                if gap is not None:
                    yield gap, at, why
                    gap = None
                yield at, end, x
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            end, lost = at + 1, why
        at = end
        if lost:
            gap, why = (gap, why) if gap is not None else (end, lost)
            following = _START.search(data, end)
            at = following.start() if following else len(data)
    if gap is not None:
        yield gap, len(data), why


def salvage(spark: SparkSession, path: str) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` from all archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                archive, rows, held = name.as_py(), [], 0
                for start, stop, x in salvage_bytes(content.as_py() or b""):
                    if isinstance(x, str):
                        rows.append((archive, start, stop, "gap", x, *[None] * 6))
                    else:
                        rows.append((archive, start, stop, "record", None, x.record_type, x.record_id, x.target_uri, x.refers_to, x.payload_digest, x.payload))
                        held += len(x.payload)
                    if held >= OUT_BYTES or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FIELDS), _ARROW, strict=True)], schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD_DDL)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of ``pages``: of equal payloads the one with the largest id is the response.

    A bitmap tells the pages whose digest may be repeated; the others are written where they are
    read. Of repeated digests one payload a task is shuffled, of their pages only ids and URLs."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    key = F.when(F.col("size") >= REVISIT_BYTES, F.xxhash64("digest", "size"))
    keyed = rows.select("digest", "size", key.alias("key")).where("key is not null")
    repeated = keyed.groupBy("digest", "size", "key").count().where("count > 1").select("key")
    shared = pages.sparkSession.sparkContext.broadcast(bitmap(repeated))

    def some(inside: bool, *columns: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(b.num_columns - 1)
                hit = in_bitmap(shared.value, keys.fill_null(0).to_numpy()) & ~keys.is_null().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == inside))

        part = rows.select(*columns, key.alias("key"))
        return part.mapInArrow(run, part.schema).drop("key")

    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    alone = some(False, "page_id", "url", "payload", "digest", "size").select(F.lit("response").alias("record_type"), name("page_id").alias("record_id"), "url", "payload", "size", "digest", F.lit(None).cast("string").alias("refers_to"))
    first = some(True, "page_id", "payload", "digest", "size").groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.first("payload").alias("payload"))
    joined = some(True, "page_id", "url", "digest", "size").join(first, ["digest", "size"])
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return alone.unionByName(joined.select(F.when(again, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"), "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", F.when(again, name("first")).alias("refers_to")))


def resolve(records: DataFrame) -> DataFrame:
    """Page rows from salvaged records: revisits get the size of the record they refer to."""
    rows = materialize(records.where("kind = 'record'").select("record_id", "record_type", "refers_to", "payload_digest", F.sha1("payload").alias("made"), F.octet_length("payload").cast("long").alias("size")), "warc-index")
    whole = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), F.col("made").alias("payload_digest")).agg(F.max("size").alias("payload_bytes"))
    page = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(.*)$", 1), F.lit("")).cast("long")
    first = rows.where("record_type = 'response'").select(page("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("made").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = rows.where("record_type = 'revisit'").join(whole, ["refers_to", "payload_digest"], "left").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
    return first.unionByName(again)


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(page_records(table(spark, sf_dir, "pages")), path)
    return resolve(salvage(spark, path))


OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM k)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""
