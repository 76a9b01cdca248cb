"""WARC files: a writer, and a salvage reader that goes on after damage.

The reader takes plain files and files of gzip members. At each place it tries to read one record and checks it: the
member inflates and its CRC and length hold, the version line and headers parse, ``Content-Length`` fits and the block
ends in the two line breaks, the payload has its digest. If a check fails, the bytes are quarantined, and the reader looks
for the next valid start: a gzip header that inflates to a version line, or a version line that begins a record
which passes every check. Later records are so recovered, and the bytes between are logged as a gap with the
reason of its first failure and the records around it. Searching goes once over the bytes.

Files on storage are read in splits: a task seeks to its offset, looks for the first valid start there, and reads the
records that start before its end, the last one beyond it. Gaps are then what no record of the file covers.

Defined results: null or empty content has no rows; content without any record is one gap; zero bytes between records
are a gap like others; two damaged records in a row make one gap; null ids stay null; a repeated row repeats its records;
records and headers of any length are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_START = re.compile(rb"WARC/\d\.\d\r?\n|\x1f\x8b\x08")
SCHEMA = "begin long, finish long, kind string, type string, record_id string, uri string, payload binary, reason string"


class Damaged(Exception):
    """Why no record stands here; ``needs`` is how many bytes of the data might hold one after all (0: no more help)."""

    def __init__(self, reason: str, needs: int = 0) -> None:
        super().__init__(reason)
        self.needs = needs


class Blank:
    """The next empty line from an offset on. Remembered, so that many false starts before one of them search for it once."""

    def __init__(self, data: bytes) -> None:
        self.data, self.begin, self.found = data, 0, -2

    def after(self, at: int) -> int:
        if not (self.found != -2 and self.begin <= at and (self.found == -1 or at <= self.found)):
            self.begin, self.found = at, self.data.find(b"\r\n\r\n", at)
        return self.found


def record(kind: str, record_id: str, uri: str, payload: bytes) -> bytes:
    """One record, with the digest of its payload."""
    head = (
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Target-URI: {uri}\r\n"
        f"WARC-Payload-Digest: md5:{hashlib.md5(payload).hexdigest()}\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return head.encode() + payload + b"\r\n\r\n"


def stored_member(data: bytes) -> bytes:
    """A gzip member of stored blocks, whose size follows from that of the data."""
    out = [b"\x1f\x8b\x08\0\0\0\0\0\0\xff"]
    for at in range(0, max(1, len(data)), 65535):
        part = data[at : at + 65535]
        out += [struct.pack("<BHH", at + 65535 >= len(data), len(part), 65535 - len(part)), part]
    return b"".join([*out, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)])


def parse(data: bytes, at: int, total: int | None = None, blank: Blank | None = None) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the plain record at an offset, or Damaged.

    total: how many bytes there are, of which ``data`` are the first. Headers may have any length; their lines are read one
    by one, so that a false start costs what stands before its first bad line.
    """
    total = len(data) if total is None else total
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("bad_version", len(data) + 16 if at + 11 > len(data) and len(data) < total else 0)
    end = (blank or Blank(data)).after(version.end() - 2)
    headers, place = {}, version.end()
    while end < 0 or place < end:
        stop = data.find(b"\r\n", place)
        if stop < 0:
            raise Damaged("bad_header", 2 * len(data) if len(data) < total else 0)
        name, colon, value = data[place:stop].partition(b":")
        if not colon:
            # The data may end within an empty line, which more of it would show.
            raise Damaged("bad_header", 2 * len(data) if end < 0 and stop + 2 >= len(data) < total else 0)
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        place = stop + 2
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdecimal() and len(length) < 19):
        raise Damaged("bad_length")
    begin, stop = end + 4, end + 4 + int(length)
    if stop + 4 > len(data):
        raise Damaged("truncated", stop + 4 if stop + 4 <= total else 0)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("bad_length")
    payload = data[begin:stop]
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("md5:") and hashlib.md5(payload).hexdigest() != digest[4:]:
        raise Damaged("bad_digest")
    if digest.startswith("sha1:"):
        import base64

        raw = hashlib.sha1(payload).digest()
        if digest[5:].lower() not in (raw.hex(), base64.b32encode(raw).decode().lower()):
            raise Damaged("bad_digest")
    return headers, payload, stop + 4


def read_at(data: bytes, at: int, total: int | None = None, blank: Blank | None = None) -> tuple[dict[str, str], bytes, int]:
    """As parse(), of the plain record or gzip member at an offset."""
    total = len(data) if total is None else total
    if data[at : at + 3] != b"\x1f\x8b\x08":
        return parse(data, at, total, blank)
    inflater = zlib.decompressobj(31)
    view = memoryview(data)
    parts, step, place = [], 1 << 16, at
    try:
        while not inflater.eof and place < len(data):
            parts.append(inflater.decompress(view[place : place + step]))
            place += step
            if len(parts) == 1 and len(parts[0]) > 16 and not _VERSION.match(parts[0]):
                raise Damaged("bad_version")
    except zlib.error:
        raise Damaged("bad_member") from None
    if not inflater.eof:
        raise Damaged("truncated", 2 * len(data) if len(data) < total else 0)
    inner = b"".join(parts)
    headers, payload, end = parse(inner, 0)
    if end != len(inner):
        raise Damaged("bad_length")
    return headers, payload, min(place, len(data)) - len(inflater.unused_data)


def salvage(data: bytes | None, begin: int = 0, finish: int | None = None, total: int | None = None, each: bool = False) -> Iterator[tuple]:
    """Rows of SCHEMA for the records that start in [begin, finish), and for the gaps before, between and after them.

    each: a gap for each start that failed, up to the next one, so that their reasons can be told apart.

    If ``data`` are only the first of ``total`` bytes and a start would need more of them, Damaged is raised with their number.
    """
    if not data:
        return
    finish = len(data) if finish is None else finish
    at, gap, reason = begin, None, ""
    blank = Blank(data)
    while at < finish:
        try:
            headers, payload, end = read_at(data, at, total, blank)
        except Damaged as e:
            if e.needs > len(data):
                raise
            if gap is None:
                gap, reason = at, str(e)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            if each:
                yield gap, at, "gap", None, None, None, None, reason
                gap = None
            continue
        if gap is not None:
            yield gap, at, "gap", None, None, None, None, reason
            gap = None
        yield at, end, "record", headers.get("warc-type"), headers.get("warc-record-id", "").strip("<>") or None, headers.get("warc-target-uri"), payload, None
        at = end
    if gap is not None:
        yield gap, min(at, len(data)), "gap", None, None, None, None, reason


def read_blobs(captures: DataFrame, key: str, content: str) -> DataFrame:
    """Records and gaps of WARC contents in a binary column: ``key``, number, and the columns of SCHEMA.

    A key column named like one of these others comes back under that name with underscores before it.
    """
    taken = {"number", *(x.split()[0] for x in SCHEMA.split(", "))}
    free = key
    while free.lower() in taken:
        free = f"_{free}"
    captures, key = captures.select(F.col(f"`{key}`").alias(free), F.col(f"`{content}`").alias("_content" if free != "_content" else "__content")), free
    content = captures.columns[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(salvage(batch.column(1)[i].as_py()))
                if rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    keys = batch.column(0).take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(rows)), pa.int32()), *columns], [key, "number", *names])

    kind = dict(captures.dtypes)[key]
    return captures.select(key, content).mapInArrow(run, f"`{key}` {kind}, number int, {SCHEMA}")


def read_files(spark: SparkSession, paths: list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """Records and gaps of WARC files: path, and the columns of SCHEMA, in splits of about ``split_bytes``.

    The files are read twice: once for the places of records and gaps, which tell how far the records of the splits before
    one reach into it, and once for the records, of which those that begin before that go. Payloads are not moved.
    """
    from pyarrow import fs

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    splits = []
    for path in paths:
        where, name = fs.FileSystem.from_uri(path)
        size = where.get_file_info(name).size
        splits += [(path, b, min(b + split_bytes, size), size) for b in range(0, max(size, 1), split_bytes)]

    def reader(kind: str, columns: list[str]):
        places = [names.index(c) for c in columns]
        kinds = [k for k, n in zip([pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()], names, strict=True) if n in columns]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, begin, finish, size in zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True):
                    where, name = fs.FileSystem.from_uri(path)
                    with where.open_input_file(name) as f:
                        data = f.read_at(min(finish - begin + 16, size - begin), begin)
                        while True:  # a record that begins here may end anywhere beyond; only what it needs is read, and damage needs nothing
                            try:
                                rows = list(salvage(data, 0, finish - begin, size - begin, True))
                                break
                            except Damaged as e:
                                data += f.read_at(min(e.needs, size - begin) - len(data), begin + len(data))
                    rows = [[(r[0] + begin, min(r[1] + begin, finish) if r[2] == "gap" else r[1] + begin, *r[2:])[i] for i in places] for r in rows if kind in ("", r[2])]
                    for at in range(0, len(rows), 256):
                        part = list(zip(*rows[at : at + 256], strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(part[0])), pa.array([begin] * len(part[0]), pa.int64()), *[pa.array(c, k) for c, k in zip(part, kinds, strict=True)]],
                            ["path", "split", *columns],
                        )

        return run

    kinds = dict(x.split() for x in SCHEMA.split(", "))
    todo = spark.createDataFrame(splits, "path string, first long, last long, size long").repartition(max(1, len(splits)))
    seen = ["begin", "finish", "kind", "reason"]
    places = checkpoint(todo.mapInArrow(reader("", seen), f"path string, split long, {', '.join(f'{c} {kinds[c]}' for c in seen)}"))
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    ends = places.filter("kind = 'record'").groupBy("path", "split").agg(F.max("finish").alias("end"))
    reach = (
        todo.select("path", "first").join(ends.withColumnRenamed("split", "first"), ["path", "first"], "left")
        .select("path", F.col("first").alias("split"), F.coalesce(F.max("end").over(before), F.lit(0)).alias("reach"))
    )
    records = todo.mapInArrow(reader("record", names), f"path string, split long, {SCHEMA}").join(reach, ["path", "split"]).filter("begin >= reach").drop("split", "reach")

    # A gap that goes on in the next split is one gap, with its first reason.
    gaps = places.filter("kind = 'gap'").join(reach, ["path", "split"]).withColumn("begin", F.greatest("begin", "reach")).filter("begin < finish")
    order = Window.partitionBy("path").orderBy("begin")
    marked = gaps.withColumn("new", (F.coalesce(F.lag("finish").over(order), F.lit(-1)) < F.col("begin")).cast("int")).withColumn("n", F.sum("new").over(order))
    merged = marked.groupBy("path", "n").agg(F.min_by("reason", "begin").alias("reason"), F.min("begin").alias("begin"), F.max("finish").alias("finish"))
    return records.unionByName(merged.drop("n").withColumn("kind", F.lit("gap")), allowMissingColumns=True)


#: Damage that the query does to its own captures, by the remainder of the page id: none for others.
DAMAGE = {0: "version", 3: "payload", 5: "length", 7: "cut"}
PERIOD = 11


def capture(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a WARC file of three records, gzip members for odd ids; damaged for some ids, whole and plain without one."""
    label = "null" if page_id is None else page_id
    page_id = 2 if page_id is None else page_id
    pack = stored_member if page_id % 2 else bytes
    uri = url or ""
    parts = [record(k, f"urn:page:{label}:{i}", uri, p) for i, (k, p) in enumerate((("request", b"GET"), ("response", (html or "").encode()), ("metadata", b"done")))]
    packed = [bytearray(pack(p)) for p in parts]
    inner = 15 if page_id % 2 else 0  # where the data begins in a member

    def dirty(i: int) -> None:
        if inner:  # the blocks of a member are stored, so a record could be read from within it; not with a bad digest
            packed[i][inner + parts[i].find(b"md5:") + 4] = ord("z")

    kind = DAMAGE.get(page_id % PERIOD)
    if kind == "version":
        packed[1][:4] = b"DIRT"
        packed[1][inner : inner + 4] = b"DIRT"
    elif kind == "payload":
        at = inner + parts[1].find(b"\r\n\r\n") - 4
        packed[1][at : at + 2] = b"zz"
    elif kind == "length":
        dirty(1)
        del packed[1][-3:]
    elif kind == "cut":
        dirty(2)
        del packed[2][-7:]
    return b"".join(packed)


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, warc)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                blobs = [capture(p, u, h) for p, u, h in zip(*[c.to_pylist() for c in part.columns], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["page_id", "warc"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, warc binary")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_blobs(captures(table(spark, sf_dir, "pages")), "page_id", "warc")
    return rows.select("page_id", "number", "begin", "finish", "kind", "type", "record_id", "uri", F.coalesce(F.octet_length("payload"), F.lit(-1)).alias("n_bytes"), F.md5("payload").alias("digest"), "reason")


QUERIES = {"op1_warc_salvage": op1}
ORACLE_SQL = {
    "op1_warc_salvage": f"""
WITH p AS (SELECT row_number() OVER () AS page, page_id, coalesce(page_id, 2) AS k, coalesce(CAST(page_id AS VARCHAR), 'null') AS label, coalesce(url, '') AS uri, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page, page_id, k, label, uri, unnest([0, 1, 2]) AS i, unnest(['request', 'response', 'metadata']) AS type, unnest(['GET', html, 'done']) AS payload FROM p),
s AS (
  SELECT *, 'urn:page:' || label || ':' || i AS record_id,
    strlen('WARC/1.0WARC-Type: ' || type || 'WARC-Record-ID: <' || 'urn:page:' || label || ':' || i || '>WARC-Target-URI: ' || uri
      || 'WARC-Payload-Digest: md5:' || md5(payload) || 'Content-Length: ' || strlen(payload)) + 14 + strlen(payload) + 4 AS plain FROM r),
t AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN plain ELSE plain + 18 + 5 * greatest(1, CAST(ceil(plain / 65535) AS BIGINT)) END
      - CASE WHEN k % {PERIOD} = 5 AND i = 1 THEN 3 WHEN k % {PERIOD} = 7 AND i = 2 THEN 7 ELSE 0 END AS size,
    CASE WHEN i = 1 AND k % {PERIOD} = 0 THEN 'bad_version'
      WHEN i = 1 AND k % {PERIOD} = 3 THEN CASE WHEN k % 2 = 0 THEN 'bad_length' ELSE 'bad_member' END
      WHEN i = 1 AND k % {PERIOD} = 5 THEN CASE WHEN k % 2 = 0 THEN 'bad_length' ELSE 'bad_member' END
      WHEN i = 2 AND k % {PERIOD} = 7 THEN 'truncated' END AS reason FROM s),
u AS (SELECT *, sum(size) OVER (PARTITION BY page ORDER BY i) AS finish FROM t)
SELECT page_id, CAST(i AS INTEGER) AS number, CAST(finish - size AS BIGINT) AS begin, CAST(finish AS BIGINT) AS finish,
  CASE WHEN reason IS NULL THEN 'record' ELSE 'gap' END AS kind, CASE WHEN reason IS NULL THEN type END AS type,
  CASE WHEN reason IS NULL THEN record_id END AS record_id, CASE WHEN reason IS NULL THEN uri END AS uri,
  CAST(CASE WHEN reason IS NULL THEN strlen(payload) ELSE -1 END AS INTEGER) AS n_bytes, CASE WHEN reason IS NULL THEN md5(payload) END AS digest, reason
FROM u"""
}
