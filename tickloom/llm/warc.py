"""Legacy ARC archives and their conversion to WARC.

ARC files hold records of a header line (5 fields in version 1, 10 in version 2), the declared number of bytes and a
newline. The converter parses them by version and length and writes WARC/1.1 records with identifiers, timestamps, types
and digests that follow from the ARC record and its place alone, so a repeated conversion gives the same archive. Of records
with equal payloads, one is a response and the rest revisit it, naming its identifier, address and date.

Each record is a gzip member of its own, as readers that seek expect. Spark's text writer stores the members, since it alone
reaches every file system of a cluster; its separator is an empty member. Readers take whole files as binary and parse them as
a stream.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folder, kept, swept

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Fixed values of the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
CRLF, ARC_DATE, IP = b"\r\n", "20240101000000", "0.0.0.0"
#: Namespace of synthesised identifiers.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")
RECORD = "place string, page_id bigint, url string, ip string, date string, mime string, status int, head binary"
#: Bytes inflated at a time: about a record's, since what lies behind a member's end is copied.
CHUNK = 1 << 12


def _field(x: str | None) -> str:
    """A value without the spaces and line ends that part ARC fields; '-' stands for null, '%2D' for a lone '-'."""
    if x is None:
        return "-"
    out = "".join(f"%{ord(c):02X}" if c in "%\x7f" or c <= " " else c for c in x)
    return "%2D" if out == "-" else out or "%"


def _value(x: str) -> str | None:
    if x == "-":
        return None
    return "" if x == "%" else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), x)


def arc_head(version: int, name: str) -> bytes:
    """The record that begins an ARC file."""
    block = f"{version} 0 tickloom\n{ARC_FIELDS[version]}\n".encode()
    tail = f"{len(block)}" if version == 1 else f"200 - - 0 {name} {len(block)}"
    return f"filedesc://{name} {IP} {ARC_DATE} text/plain {tail}\n".encode() + block


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes, offset: int, name: str) -> bytes:
    """A page as an ARC record: the header line, then an HTTP response. The page's id is a header of the response."""
    lines = [b"HTTP/1.0 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    lines += [] if page_id is None else [b"X-Page-Id: %d" % page_id]
    block = CRLF.join(lines) + CRLF * 2 + payload
    tail = f"{len(block)}" if version == 1 else f"200 {zlib.crc32(payload):08x} - {offset} {name} {len(block)}"
    return f"{_field(url)} {IP} {ARC_DATE} text/html {tail}\n".encode() + block


def write_arc(pages: DataFrame, path: str) -> None:
    """pages (page_id, url, html) as ARC files at path; each partition writes version 1 or 2 in turn."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        version, name, at, head = 1 + n % 2, f"part-{n:05d}.arc", 0, True
        for b in batches:
            rows = [arc_head(version, name)] if head else []
            head = False
            at += sum(len(r) + 1 for r in rows)
            for p, u, h in zip(*(b.column(i) for i in range(3))):
                rows.append(arc_record(version, p.as_py(), u.as_py(), h.as_py() or b"", at, name))
                at += len(rows[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([packed(r + b"\n") for r in rows], pa.binary())], ["record"])

    stored(pages.select(F.col("page_id").cast("bigint"), "url", F.col("html").cast("binary")).mapInArrow(records, "record binary"), path)


def packed(record: bytes) -> bytes:
    """A gzip member."""
    return zlib.compress(record, 1, wbits=31)


def stored(members: DataFrame, path: str) -> None:
    """members (record), gzip members, as files at path."""
    end = packed(b"").decode("latin-1")
    members.select(F.col("record").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", end).text(path)


class Stream:
    """Reads by line and by length from a file's bytes, inflating gzip members piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.read, self.zip, self.buffer, self.at, self.before = memoryview(data), 0, None, bytearray(), 0, 0
        self.packed = data[:2] == b"\x1f\x8b"

    def more(self) -> bool:
        """Whether another piece of the file came."""
        if self.read == len(self.data):
            return False
        self.before += self.at
        del self.buffer[: self.at]
        self.at = 0
        if not self.packed:
            self.buffer += self.data
            self.read = len(self.data)
            return True
        self.zip = self.zip or zlib.decompressobj(31)
        piece = self.data[self.read : self.read + CHUNK]
        self.buffer += self.zip.decompress(piece)
        self.read += len(piece) - len(self.zip.unused_data)
        if self.zip.eof:
            self.zip = None
        return True

    def offset(self) -> int:
        """Bytes read so far, as inflated."""
        return self.before + self.at

    def line(self, end: bytes = b"\n") -> bytes:
        """Up to and without the next `end`; what is left at the file's end."""
        seen = 0
        while (k := self.buffer.find(end, self.at + seen)) < 0:
            seen = max(0, len(self.buffer) - self.at - len(end) + 1)
            if not self.more():
                k = len(self.buffer)
                break
        out, self.at = bytes(self.buffer[self.at : k]), min(len(self.buffer), k + len(end))
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self.more():
            pass
        out = bytes(self.buffer[self.at : self.at + n])
        if len(out) < n:
            raise ValueError(f"the archive ends {n - len(out)} bytes before a declared length")
        self.at += n
        return out

    def ended(self) -> bool:
        return self.at == len(self.buffer) and not self.more() and self.at == len(self.buffer)


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str], int | None]:
    """Head, payload, header fields and status of an HTTP response; a block that is none is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}, None
    head, _, payload = block.partition(CRLF * 2)
    first, *lines = head.decode("latin-1").split("\r\n")
    status = first.split(" ")[1:2]
    return head, payload, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, int(status[0]) if status and status[0].isdigit() else None


def parse_arc(data: bytes) -> Iterator[tuple]:
    """(place, page_id, url, ip, date, mime, status, head, payload) of each record. The version block names the header's fields
    and the file; a place is the file's name and the record's offset."""
    s = Stream(data)
    names, file = [], ""
    while not s.ended():
        offset, line = s.offset(), s.line().decode("utf-8", "replace")
        if not line.strip():
            continue  # the newline after a record
        got = line.split(" ")
        if line.startswith("filedesc://"):
            block = s.take(int(got[-1])).decode("utf-8", "replace").split("\n")
            version = int(block[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            names = block[1].split(" ") if len(block) > 1 and block[1] else ARC_FIELDS[version].split(" ")
            file = got[0].removeprefix("filedesc://")
            continue
        if len(got) != len(names):
            raise ValueError(f"{len(names)} fields are declared, a header line has {len(got)}: {line[:200]!r}")
        row = dict(zip(names, got))
        head, payload, fields, status = _http(s.take(int(row["Archive-length"])))
        status = int(row["Result-code"]) if row.get("Result-code", "").isdigit() else status
        page = fields.get("x-page-id")
        yield (f"{file}:{offset}", int(page) if page else None, _value(row["URL"]), row["IP-address"], row["Archive-date"], row["Content-type"], status, head, payload)


TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def table(rows: list[tuple], kind: str) -> pa.RecordBatch:
    """rows as a batch of these columns ("name type, ...")."""
    names, types = zip(*(x.split(" ") for x in kind.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], TYPES[t]) for i, t in enumerate(types)], list(names))


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD, the payload's size and digest, and if asked for the payload itself, deflated until it is written, for each record
    of the ARC files below path; in batches of about 4 MB of payload."""
    kind = RECORD + ", size bigint, digest string" + (", payload binary" if payloads else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                got, size = [], 0
                for *rest, payload in parse_arc(data.as_py()):
                    got.append((*rest, len(payload), hashlib.sha256(payload).hexdigest(), *([zlib.compress(payload, 1)] if payloads else [])))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield table(got, kind)
                        got, size = [], 0
                if got:
                    yield table(got, kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, kind)


def warc_id(place: str) -> str:
    """The identifier of the record that the ARC record in this place becomes: one for each record, and the same each time."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, place)}>"


def warc_date(arc: str) -> str:
    """YYYYMMDDhhmmss, or fewer digits, as an ISO timestamp."""
    d = (arc + "00000101000000"[len(arc) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record without the two line ends that follow it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block


def converted(place, page_id, url, ip, date, mime, status, head, digest, first, payload) -> bytes:
    """The WARC record of an ARC record; first: place, url and date of the one whose equal payload it revisits, or None. A record
    that has no HTTP head (dns:, ftp:) is a resource of its own media type, and its block is the payload alone."""
    kind = "revisit" if first is not None else "response" if head else "resource"
    media = "application/http; msgtype=response" if head else mime or "application/octet-stream"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", warc_id(place)), ("WARC-Date", warc_date(date)), ("WARC-Target-URI", _field(url)), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", media)]
    if first is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", warc_id(first["place"])), ("WARC-Refers-To-Target-URI", _field(first["url"])), ("WARC-Refers-To-Date", warc_date(first["date"]))]
    return warc_record(fields, (head + CRLF * 2 if head else b"") + (payload if first is None else b""))


def write_warc(records: DataFrame, path: str) -> None:
    """read_arc()'s records with first (place, url, date, or null), as WARC files at path; each begins with a warcinfo record."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")] + ["digest", "first", "payload"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine = f"{TaskContext.get().partitionId()}"
        out = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", warc_id(f"warcinfo:{mine}")), ("WARC-Date", warc_date(ARC_DATE)), ("Content-Type", "application/warc-fields")], b"software: tickloom\r\nformat: WARC File Format 1.1\r\n")]
        for b in batches:
            for row in zip(*(b.column(n) for n in names)):
                *rest, payload = (x.as_py() for x in row)
                out.append(converted(*rest, zlib.decompress(payload)))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array([packed(x + CRLF * 2) for x in out], pa.binary())], ["record"])
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array([packed(x + CRLF * 2) for x in out], pa.binary())], ["record"])

    stored(records.select(*names).mapInArrow(rows, "record binary"), path)


def parse_warc(data: bytes) -> Iterator[tuple]:
    """(header fields, block) of each record."""
    s = Stream(data)
    while not s.ended():
        line = s.line(CRLF)
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:100]!r}")
        fields = {}
        while line := s.line(CRLF):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, s.take(int(fields["content-length"]))


READ = "record_id string, record_type string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to_id string, url string, date string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """READ for each response, resource and revisit below path. A payload's length is that of its bytes, whatever an HTTP header
    says, and its digest must agree with the record's. A revisit names the record that holds its payload, and has no length. A folder
    without files gives no rows."""

    def one(fields: dict[str, str], block: bytes) -> tuple:
        kind = fields["warc-type"]
        _, payload, http, _ = _http(block) if kind != "resource" else (b"", block, {}, None)
        digest, page = fields["warc-payload-digest"].removeprefix("sha256:"), http.get("x-page-id")
        if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} isn't what its headers say")
        return (fields["warc-record-id"], kind, int(page) if page else None, None if kind == "revisit" else len(payload), digest, fields.get("warc-refers-to"), _value(fields["warc-target-uri"]), fields["warc-date"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield table([one(f, block) for f, block in parse_warc(data.as_py()) if f["warc-type"] in ("response", "resource", "revisit")], READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, READ)


def with_targets(read: DataFrame) -> DataFrame:
    """READ with refers_to, the page_id of the record that a revisit names, and that record's payload_bytes. Rows of read_warc(),
    stored: they are read twice, and only revisits are joined."""
    of = read.where("record_type <> 'revisit'")
    named = of.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"))
    back = read.where("record_type = 'revisit'").join(named, "refers_to_id", "left").withColumn("payload_bytes", F.col("size")).drop("size")
    return of.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(back)


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """The ARC files below `arc` as WARC files at `warc`.

    The files are read twice: first without payloads, for a row for each payload that occurs again, by its digest, with the
    record of the smallest page_id. A record with that payload and another id revisits it. Records without id are responses, as
    is all of an equal id (repeated rows). A folder without files is an empty one of WARC files.
    """
    with swept(spark):
        light = kept(read_arc(spark, arc, payloads=False).where(F.col("size") >= LEAST_REVISIT).select("digest", "page_id", "place", "url", "date"), "digests")
        least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place", "url", "date")))
        first = kept(light.groupBy(F.col("digest").alias("same")).agg(least.alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND to IS NOT NULL").drop("n"), "firsts")
        joined = read_arc(spark, arc).join(first, F.col("digest") == F.col("same"), "left")
        write_warc(joined.withColumn("first", F.when(F.col("page_id") > F.col("to.page_id"), F.struct("to.place", "to.url", "to.date"))), warc)


def archive(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> READ's columns and refers_to, a row for each page, by way of ARC files and their
    conversion.

    Null html is an empty payload; a null url or page_id comes back null. Pages however long are one record each. Repeated rows
    stay, each with an identifier of its own; other columns are ignored. No pages: no rows.
    """
    spark = pages.sparkSession
    with swept(spark) as outliving:
        arc, warc = folder(spark, "arc"), folder(spark, "warc")
        write_arc(pages, arc)
        convert(spark, arc, warc)
        read = outliving(read_warc(spark, warc), "read")
    return with_targets(read)


WARC_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
