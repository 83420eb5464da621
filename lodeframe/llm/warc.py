"""Legacy ARC archives and their conversion to WARC.

``write_arc`` stores pages as ARC files (header lines of version 1 or 2, one gzip member for each record).
``convert`` reads such files: a version block says how the header lines after it are laid out, the declared
length bounds each record, and from both it makes the WARC record: identifier, ISO timestamp, type and
SHA-1 digests. Of records with equal payloads the one with the smallest page_id is a response; the others are
revisits with the response's identifier and no payload. ``read_warc`` reads the result back.

Files are written by Spark's own text writer, whose separator is an empty gzip member, and read with the
binaryFile source, so any store that Spark reaches will do.

Defined cases: null html is an empty payload; a null url becomes ``unknown:``; a null page_id is kept, counts
as larger than any other and is never a revisit; repeated rows are all written, and copies with the same
page_id are of the same type; no rows give no files and no rows; further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEVEL, BUNDLE_BYTES, MIN_BYTES, DATE = 5, 2 << 20, 0, "19990101000000"
#: An empty gzip member, as Latin-1 text.
_BETWEEN = (b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)).decode("latin-1")

# The field names of the two versions' header lines, as the version blocks state them.
_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def member(raw: bytes, level: int = LEVEL) -> bytes:
    return zlib.compress(raw, level, wbits=31)


def members(content: bytes):
    """The unpacked gzip members of a file, without the empty ones."""
    view, at = memoryview(content), 0
    while at < len(view):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            piece = view[at : at + 65536]
            if not len(piece):
                raise ValueError("the archive ends inside a record")
            parts.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        if raw := b"".join(parts):
            yield raw


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _save(df: DataFrame, path: str) -> None:
    df.select(F.col("bundle").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", _BETWEEN).option("maxRecordsPerFile", 16).text(path)


# ---------------------------------------------------------------- ARC


def version_block(version: int, date: str = DATE) -> bytes:
    body = f"{version} 0 archive\n{_FIELDS[version]}\n\n".encode()
    extra = " 200 - - 0 pages.arc" if version == 2 else ""
    return f"filedesc://pages.arc 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes, date: str = DATE) -> bytes:
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]|^`{}<>\"\\") if url else "unknown:"
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode() + payload
    extra = f" 200 {hashlib.md5(payload).hexdigest()} - 0 pages.arc" if version == 2 else ""
    return f"{uri} 0.0.0.0 {date} text/html{extra} {len(reply)}\n".encode() + reply + b"\n"


def parse_arc(raw: bytes, version: int) -> tuple[dict[str, str], bytes]:
    """Header fields and the declared number of bytes after the header line."""
    line, _, rest = raw.partition(b"\n")
    names, values = _FIELDS[version].split(" "), line.decode("utf-8", "replace").split(" ")
    if len(values) != len(names):
        raise ValueError(f"a version {version} header line has {len(names)} fields, this one {len(values)}")
    head = dict(zip(names, values))
    length = int(head["Archive-length"])
    if len(rest) < length:
        raise ValueError("the record is shorter than its declared length")
    return head, rest[:length]


def write_arc(pages: DataFrame, path: str) -> None:
    """Bundles of records; every second one is of version 2."""
    common.small_batches(pages.sparkSession)

    def run(it):
        for i, batch in enumerate(common.batches(it, most_bytes=BUNDLE_BYTES)):
            version = 1 + i % 2
            out = [member(version_block(version))]
            for key, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                out.append(member(arc_record(version, key, url, (html or "").encode())))
            yield pa.RecordBatch.from_pydict({"bundle": pa.array([b"".join(out)], pa.binary())})

    _save(pages.select("page_id", "url", "html").mapInArrow(common.tidy(run), "bundle binary"), path)


def read_arc(spark: SparkSession, path: str, with_record: bool) -> DataFrame:
    """page_id, payload digest and, if asked for, the packed record with its version."""
    schema = "page_id long, digest string, version int, record binary" if with_record else "page_id long, digest string, payload_bytes long"

    def rows(content: bytes):
        version = 1
        for raw in members(content):
            if raw.startswith(b"filedesc://"):
                version = int(raw.split(b"\n", 2)[1].split(b" ", 1)[0])
                continue
            _, body = parse_arc(raw, version)
            head, _, payload = body.partition(b"\r\n\r\n")
            key = head.rpartition(b"X-Page-Id: ")[2]
            yield (int(key) if key else None, digest(payload)) + ((version, member(raw, 1)) if with_record else (len(payload),))

    types = [pa.int64(), pa.string()] + ([pa.int32(), pa.binary()] if with_record else [pa.int64()])
    names = ["page_id", "digest"] + (["version", "record"] if with_record else ["payload_bytes"])

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                held = []
                for row in rows(batch.column("content")[i].as_buffer().to_pybytes()):
                    held.append(row)
                    if len(held) == common.BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(common.tidy(run), schema)


# ---------------------------------------------------------------- WARC


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {payload_digest}'.encode()).digest(), version=5)}>"


def warc_record(head: dict[str, str], body: bytes, page_id: int | None, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record; with ``refers_to`` it is a revisit, without payload."""
    reply, sep, payload = body.partition(b"\r\n\r\n")
    d = head["Archive-date"]
    name = digest(payload)
    block = reply + sep if refers_to is not None else body
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, name)),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", head["URL"]),
        ("WARC-IP-Address", head["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{name}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Bytes", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, name)), ("X-Refers-To-Page", str(refers_to))]
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> tuple[dict[str, str], bytes]:
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    return head, rest[: int(head["Content-Length"])]


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_BYTES) -> None:
    """ARC files to WARC files. The ids of copies are found from digests alone; records are dealt out once, by page_id."""
    seen = common.written(read_arc(spark, arc_path, False).distinct(), "arc-digests")
    first = seen.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = seen.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to")
    copies = common.written(copies, "arc-copies")
    records = read_arc(spark, arc_path, True).join(copies, ["page_id", "digest"], "left").select("page_id", "version", "record", "refers_to")

    def run(it):
        for batch in common.batches(it, most_bytes=BUNDLE_BYTES):
            out = []
            for key, version, raw, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "version", "record", "refers_to"))):
                head, body = parse_arc(next(members(raw)), version)
                out.append(member(warc_record(head, body, key, refers)))
            yield pa.RecordBatch.from_pydict({"bundle": pa.array([b"".join(out)], pa.binary())})

    _save(records.mapInArrow(common.tidy(run), "bundle binary"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record. A response's digest is computed from its payload and must equal the stated one."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def row(raw: bytes):
        head, block = parse_warc(raw)
        kind, name, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Bytes"])
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if digest(payload) != name or len(payload) != size:
                raise ValueError("the payload doesn't have the stated digest")
        number = lambda x: int(x) if x else None
        return number(head["X-Page-Id"]), size, name, kind, number(head.get("X-Refers-To-Page"))

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                held = [row(raw) for raw in members(batch.column("content")[i].as_buffer().to_pybytes())]
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(common.tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    arc, warc = common.shared_dir(spark, "arc"), common.shared_dir(spark, "warc")
    write_arc(common.table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM d
"""
