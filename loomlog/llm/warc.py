"""Legacy archive converter: ARC version 1 and 2 to WARC 1.1, a WARC writer and a reader.

An ARC file starts with a version block, ``filedesc://...``, whose second line gives the version; every
record is a header line with the fields of that version, the last being the declared length, then as many
bytes and a newline. The converter follows the declared lengths, never the look of the content, and makes
WARC records from them: WARC-Record-ID (a name-based UUID of URL, date and digest), WARC-Date, the type
(warcinfo, response or, if told so, revisit), WARC-Block-Digest and WARC-Payload-Digest (base32 SHA-1).

Archives live as files in the folder that all nodes share, written and read by Spark's own text and
binaryFile formats, so an executor that is lost takes nothing with it. A file holds whole records of about
``FILE_BYTES`` (or a single larger one), each a gzip member of its own, so it can be read from any record on; the
zero byte that the text writer adds at a file's end is padding. read_arcs reads ARC files of either version, plain
or gzip, and convert_arcs makes WARC files of them.

Nulls and odd rows: a null html is an empty payload, a null url is written as ``-``. Rows are told apart by
page_id; rows that repeat a page_id are records of their own, and any of them may be the one that others
revisit only if its page_id is the largest of its group: rows that tie there are all responses. Rows with a
null page_id are always responses and never referred to. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BROADCAST_BYTES, shared_dir, table, written

#: Bytes of records, before compression, after which another archive file begins.
FILE_BYTES = 4 * 1024 * 1024
#: Field names of an ARC header line, by the version that the first block declares.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:loomlog:arc")
DEFAULT_DATE = "20240101000000"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    type: str
    body: bytes
    extra: dict[str, str] = field(default_factory=dict)


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """Names (lower-cased) and values of the HTTP headers in the block, and the payload."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}, payload


def write_arc(records: list[ArcRecord], version: int = 1, name: str = "legacy.arc") -> bytes:
    """An uncompressed ARC file of the version."""
    names = " ".join({1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], 2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}[version])
    about = f"{version} 0 loomlog\n{names}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 {DEFAULT_DATE} text/plain".encode() + (b" 200 - - 0 " + name.encode() if version == 2 else b"") + b" %d\n" % len(about) + about]
    at = len(out[0])
    for r in records:
        values = {"url": r.url, "ip": r.ip, "date": r.date, "type": r.type, "status": "200", "checksum": "-", "location": "-", "offset": str(at), "filename": name, "length": str(len(r.body))} | r.extra
        line = " ".join(values[f].replace(" ", "%20") or "-" for f in ARC_FIELDS[version])
        out.append(b"\n" + line.encode() + b"\n" + r.body)
        at += len(out[-1])
    return b"".join(out) + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file (plain or gzip, by member or whole); the version block comes first, as a filedesc record.

    A header line with another number of fields than its version has, or a length that isn't a number or runs
    past the end, raises ValueError: a truncated archive is not taken for a whole one.
    """
    data = b"".join(members(data))
    at, version = 0, 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").rstrip("\r")
        values = line.split(" ")
        if not version:
            length = values[-1]
            if not line.startswith("filedesc://") or not length.isdigit():
                raise ValueError(f"not a version block: {line[:80]!r}")
            body = data[end + 1 : end + 1 + int(length)]
            version = int(body.split(b" ", 1)[0] or 0)
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            names = ARC_FIELDS[version] if len(values) == len(ARC_FIELDS[version]) else ARC_FIELDS[1]
        else:
            names = ARC_FIELDS[version]
        if len(values) > len(names) and version == 1:  # old writers left spaces in URLs
            values = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"header line of version {version} has {len(values)} fields: {line[:80]!r}")
        got = dict(zip(names, values, strict=True))
        size = int(got.pop("length"))
        body = data[end + 1 : end + 1 + size]
        if len(body) < size or end < 0:
            raise ValueError(f"record at {at} declares {size} bytes, {len(body)} are left")
        at = end + 1 + size
        yield ArcRecord(got.pop("url"), got.pop("ip"), got.pop("date"), got.pop("type"), body, got)


def iso_date(date: str) -> str:
    """WARC-Date of an ARC date of 14 digits; shorter ones (12 or 8 in old files) are filled with zeros."""
    d = (date if date.isdigit() and len(date) >= 8 else DEFAULT_DATE)[:14].ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str) -> str:
    """A record's name-based identifier: equal input gives an equal one, so a retried task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def to_warc(r: ArcRecord, name: str | None = None, refers_to: str | None = None) -> WarcRecord:
    """The equivalent WARC record; with refers_to, a revisit of that record without the payload.

    The identifier is made from name, or else from URL, date and digest.
    """
    headers = {"WARC-Type": "response", "WARC-Target-URI": r.url, "WARC-Date": iso_date(r.date), "WARC-IP-Address": r.ip, "Content-Type": "application/http; msgtype=response"}
    block = r.body
    if r.url.startswith("filedesc://"):
        headers |= {"WARC-Type": "warcinfo", "WARC-Filename": r.url.removeprefix("filedesc://"), "Content-Type": "text/plain"}
        del headers["WARC-Target-URI"]
        digest = base32_sha1(block)
    elif not block.startswith(b"HTTP/"):
        headers |= {"WARC-Type": "resource", "Content-Type": r.type if "/" in r.type else "application/octet-stream"}
        digest = base32_sha1(block)
    else:
        head, _, payload = block.partition(b"\r\n\r\n")
        digest = base32_sha1(payload)
        headers["WARC-Payload-Digest"] = f"sha1:{digest}"
        if refers_to is not None:
            headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers_to}
            block = head + b"\r\n\r\n"
    headers["WARC-Record-ID"] = record_id(name or f"{r.url} {r.date} {digest}")
    headers |= {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    return WarcRecord(headers, block)


def warc_bytes(r: WarcRecord) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r.headers.items()).encode("utf-8", "surrogateescape") + b"\r\n" + r.block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The contents of a gzip file's members, one by one; of a plain file, all of it."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        d = zlib.decompressobj(31)
        yield d.decompress(memoryview(data)[at:]) + d.flush()
        if not d.eof:
            raise ValueError(f"gzip member at {at} is truncated")
        at = len(data) - len(d.unused_data)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file, plain or gzip (whole records in a member). Truncated records raise ValueError."""
    for part in members(data):
        at = 0
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            if end < 0 or not part.startswith(b"WARC/", at):
                raise ValueError(f"no WARC header at {at}")
            lines = part[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
            headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(headers["Content-Length"])
            block = part[end + 4 : end + 4 + size]
            if len(block) < size:
                raise ValueError(f"record at {at} declares {size} bytes, {len(block)} are left")
            yield WarcRecord(headers, block)
            at = end + 4 + size + 4


def files_of(records: Iterator[bytes], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives of about file_bytes, before compression, as rows of bytes."""
    held: list[bytes] = []
    size = 0
    for record in records:
        held.append(gzip_member(record))
        size += len(record)
        if size >= file_bytes:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)], pa.binary())})
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)], pa.binary())})


def write_archives(archives: DataFrame) -> str:
    """A file for each row of archives (value binary) in a new folder of the shared one."""
    path = f"{shared_dir(archives.sparkSession)}/warc-{uuid.uuid4().hex}"
    # a string column is written byte by byte as it is
    archives.select(F.col("value").cast("string")).write.option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(path)


ARC = "file string, nr long, url string, ip string, date string, type string, body binary, extra map<string,string>"


def read_arcs(spark: SparkSession, path: str, glob: str = "*.arc*") -> DataFrame:
    """The records of legacy archives, by file and number in it (0: the version block, a filedesc record); extra: the fields that only
    version 2 has. A file is read by one task, as its records can only be told apart from the start."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.map_(pa.string(), pa.string())]
        names = [x.split()[0] for x in ARC.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for nr, r in enumerate(read_arc(content.as_py())):
                    rows.append((name, nr, r.url, r.ip, r.date, r.type, r.body, list(r.extra.items())))
                    size += len(r.body)
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return binary_files(spark, path, glob).select("path", "content").mapInArrow(records, ARC)


def convert_arcs(spark: SparkSession, path: str, glob: str = "*.arc*", file_bytes: int = FILE_BYTES) -> str:
    """Legacy archives to gzip WARC files; returns their folder. A record's identifier is made from its file, number, URL, date and digest."""

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for r in batch.to_pylist():
                record = ArcRecord(r["url"], r["ip"], r["date"], r["type"], r["body"], dict(r["extra"]))
                yield warc_bytes(to_warc(record, f"{r['file'].rpartition('/')[2]} {r['nr']} {r['url']} {r['date']} {base32_sha1(r['body'])}"))

    return write_archives(read_arcs(spark, path, glob).mapInArrow(lambda batches: files_of(converted(batches), file_bytes), "value binary"))


WARC = "file string, nr long, type string, url string, headers map<string,string>, block binary"


def read_warcs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The records of WARC files, plain or gzip, by file and number in it."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for nr, r in enumerate(read_warc(content.as_py())):
                    row = (name, nr, r.headers.get("WARC-Type"), r.headers.get("WARC-Target-URI"), list(r.headers.items()), r.block)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in WARC.split(", ")])

    return binary_files(spark, path, glob).select("path", "content").mapInArrow(records, WARC)


def page_record(page_id: int | None, url: str | None, html: bytes) -> ArcRecord:
    """A page as a legacy record: an HTTP response whose X-Page-Id header carries the id."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "-")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    return ArcRecord(clean, "0.0.0.0", DEFAULT_DATE, "text/html", head.encode() + html)


def payload_leaders(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """digest, leader: payloads of at least min_bytes that rows of several page_ids have, and the largest of these.

    Only digests are shuffled; equal payloads are combined on the map side, so a large group of copies is one row a task.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("bytes")).where(F.col("page_id").isNotNull() & (F.col("bytes") >= min_bytes))
    return keyed.groupBy("digest").agg(F.max("page_id").alias("leader"), F.min("page_id").alias("first")).where("leader <> first").select("digest", "leader")


def write_pages(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES, max_broadcast: int = BROADCAST_BYTES) -> str:
    """Write a record per row of pages (page_id, url, html) to gzip WARC files; returns their folder.

    A row's identifier comes from its page_id and payload. Rows are laid down as legacy archives, of version 1 and 2 in turn, and
    converted. Rows whose payload another row of a larger page_id also has, of at least min_bytes, become revisits of it. Pages
    are shuffled only if the leaders take over max_broadcast bytes.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    leaders = written(payload_leaders(pages, min_bytes), "leaders")
    small = 80 * leaders.count() <= max_broadcast
    joined = rows.join(F.broadcast(leaders) if small else leaders.hint("shuffle_merge"), "digest", "left")
    joined = joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("leader"), F.col("leader")).alias("leader"))

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for k, batch in enumerate(batches):
            rows = batch.to_pylist()
            _, *records = read_arc(write_arc([page_record(r["page_id"], r["url"], r["html"]) for r in rows], 1 + k % 2))
            for row, record in zip(rows, records, strict=True):
                names = [f"page {x} {row['digest'].hex()}" for x in (row["page_id"], row["leader"])]
                out = to_warc(record, names[0], None if row["leader"] is None else record_id(names[1]))
                if row["leader"] is not None:
                    out.headers["X-Refers-To-Page-Id"] = str(row["leader"])
                yield warc_bytes(out)

    return write_archives(joined.mapInArrow(lambda batches: files_of(converted(batches), file_bytes), "value binary"))


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives that write_pages has written: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response are taken from the bytes read, those of a revisit from its headers.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in read_warc(content.as_py()):
                    http, payload = r.http()
                    kind, page = r.headers["WARC-Type"], http["x-page-id"]
                    response = kind == "response"
                    refers = r.headers.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, r.headers["WARC-Target-URI"], len(payload) if response else int(http["content-length"]), base32_sha1(payload) if response else r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, int(refers) if refers else None))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return binary_files(spark, path, "*.txt").select("content").mapInArrow(records, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, by way of its ARC record, and read the archives back."""
    return read_pages(spark, write_pages(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op10_warc": """
WITH a AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS leader FROM a),
c AS (SELECT *, list_transform(range(0, 32), lambda i: (ascii(hex[(i * 5) // 4 + 1]) * 0 + strpos('0123456789abcdef', hex[(i * 5) // 4 + 1]) - 1) * 16
  + CASE WHEN (i * 5) // 4 + 2 <= 40 THEN strpos('0123456789abcdef', hex[(i * 5) // 4 + 2]) - 1 ELSE 0 END) AS bytes FROM b)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((bytes[i + 1] >> (3 - (i * 5) % 4)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM c
""",
}
