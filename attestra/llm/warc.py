"""WARC archives: a distributed writer with revisit records, and a splittable reader of gzip members."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import broadcast_if_fits

from .common import shared_path, slices, stage

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _urn(page_id: str | None) -> str:
    return f"<urn:page:{'' if page_id is None else quote(page_id, safe='')}>"


def page_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit with only the HTTP headers of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]|^{}\"<>")))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
        return record("revisit", headers, http)
    return record("response", headers, http + payload)


class _Write:
    """Writes rows (page_id, url, payload, refers_to, revisit) to archives of its own; yields (path, bytes, records) of complete ones."""

    def __init__(self, folder: str, archive_bytes: int, date: str):
        self.folder, self.archive_bytes, self.date = folder, archive_bytes, date

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        out, name, size, records = None, "", 0, 0
        for batch in slices(batches, 256):
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    # a task that is run again writes a new file; only listed files are read
                    name, size, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    size += out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(page_id, url, payload, refers_to, revisit, self.date))
                records += 1
                if size >= self.archive_bytes:
                    out.close()
                    out = None
                    yield self.listed(name, size, records)
        if out is not None:
            out.close()
            yield self.listed(name, size, records)

    def listed(self, name: str, size: int, records: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [f"{self.folder}/{name}"], "bytes": [size], "records": [records]})


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z", broadcast_rows: int = 200_000) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the staged list of archives (path, bytes, records).

    Of records with equal payloads of at least ``min_bytes`` bytes, those with the largest page_id are
    responses, the others revisit it. Only digests that occur more than once are joined back. Their list is
    staged and counted: up to ``broadcast_rows`` it is broadcast and payloads do not move; beyond, payloads are
    shuffled by digest and Spark splits hot digests. Ids may have any type that can be ordered and cast to text.
    ``folder`` is a URI or path that executors share, by default in the staging folder.

    Null html is an empty payload; a null url has no target header. A null page_id counts as smaller than
    any; among rows without ids all are responses. Repeated rows are written each. No rows: no archives.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    equal = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("sha")
        .agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha", "newest")
    )
    equal = broadcast_if_fits(stage(equal, "equal"), broadcast_rows)
    revisit = F.coalesce(F.col("page_id") < F.col("newest"), F.col("newest").isNotNull())
    joined = rows.join(equal, "sha", "left").select(
        F.col("page_id").cast("string"), "url", "payload", F.col("newest").cast("string").alias("refers_to"), revisit.alias("revisit")
    )
    return stage(joined.mapInArrow(_Write(folder, archive_bytes, date), "path string, bytes long, records long"), "archives")


class Member:
    """Headers, HTTP headers and payload of the record in the gzip member at ``start``; ``size`` is the member's length in the file."""

    def __init__(self, start: int, size: int, headers: dict[str, str], block: bytes):
        self.start, self.size, self.headers = start, size, headers
        head, _, self.payload = block.partition(b"\r\n\r\n")
        self.http = _fields(head)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def decode_member(read, start: int) -> Member | None:
    """The record at ``start``, or None if no gzip member with a whole WARC record starts there.

    ``read(offset, length)`` gives bytes of the file. A candidate is given up as soon as its data can't be
    inflated, doesn't begin like a record, or ends before its header block does; header blocks may have any length.
    """
    inflate, data, at, step = zlib.decompressobj(31), bytearray(), start, 1 << 12
    headers, body, seen = None, 0, 0
    while not inflate.eof:
        chunk = read(at, step)
        if not chunk:
            return None
        at, step = at + len(chunk), 1 << 16
        try:
            data += inflate.decompress(chunk)
        except zlib.error:
            return None
        if headers is None:
            if not data.startswith(b"WARC/1."[: len(data)]):
                return None
            end = data.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(data)
            if end >= 0:
                headers, body = _fields(bytes(data[:end])), end + 4
                if not headers.get("content-length", "").isdigit():
                    return None
    if headers is None or len(data) != body + int(headers["content-length"]) + 4:
        return None
    return Member(start, at - start - len(inflate.unused_data), headers, bytes(data[body:-4]))


def members(read, start: int, end: int) -> Iterator[Member]:
    """Records that start in [start, end), however far they reach.

    Bytes that look like a member's start inside compressed data fail to decode, and are not even looked
    at once a record was found, as the search goes on at its end.
    """
    window = read(start, end - start + len(MAGIC) - 1)
    at = start
    while (found := window.find(MAGIC, at - start)) >= 0 and start + found < end:
        member = decode_member(read, start + found)
        if member is None:
            at = start + found + 1
        else:
            yield member
            at = member.start + member.size
            if at >= end:
                return


class _Read:
    def __init__(self, payloads: bool):
        self.payloads = payloads

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = arrow_fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    rows = []
                    for m in members(lambda at, n, f=file: f.read_at(n, at), start, end):
                        rows.append(self.row(path, m))
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_pylist(rows, self.schema())
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, self.schema())

    def row(self, path: str, m: Member) -> dict:
        def page(name: str) -> str | None:
            value = m.headers.get(name, "")
            named = value.startswith("<urn:page:") and value != _urn(None)
            return unquote(value.removeprefix("<urn:page:").removesuffix(">")) if named else None

        kind = m.headers.get("warc-type", "")
        stated = m.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        own = kind == "response"
        length = m.http.get("content-length", "")
        return {
            "path": path,
            "start": m.start,
            "record_type": kind,
            "page_id": page("warc-record-id"),
            "url": m.headers.get("warc-target-uri"),
            "payload_bytes": len(m.payload) if own else int(length) if length.isdigit() else None,
            "payload_digest": digest_of(m.payload) if own else stated,
            "intact": not own or digest_of(m.payload) == stated,
            "refers_to": page("warc-refers-to"),
            **({"payload": m.payload if own else None} if self.payloads else {}),
        }

    def schema(self) -> pa.Schema:
        text, number = pa.string(), pa.int64()
        fields = [("path", text), ("start", number), ("record_type", text), ("page_id", text), ("url", text), ("payload_bytes", number), ("payload_digest", text), ("intact", pa.bool_()), ("refers_to", text)]
        return pa.schema([*fields, *([("payload", pa.binary())] if self.payloads else [])])


def read_archives(spark: SparkSession, archives: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """A row per response and revisit of the archives (path, bytes), which tasks read in ranges of ``split_bytes``.

    A record belongs to the range it starts in. Columns: path, start, record_type, page_id, url,
    payload_bytes and payload_digest of the full payload, intact (the digest is the stated one), refers_to, and
    payload (null for revisits) unless ``payloads`` is false. Ids are cast to ``id_type``, null where they can't be.
    Damaged members are passed over (``lost_records`` counts them); other record types are left out. Empty
    archives have no rows.
    """
    ranges = archives.where("bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("from"), "bytes"
    )
    ranges = ranges.select("path", "from", F.least(F.col("from") + split_bytes, F.col("bytes")).alias("to"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = "path string, start long, record_type string, page_id string, url string, payload_bytes long, payload_digest string, intact boolean, refers_to string"
    rows = ranges.repartition(tasks, "path", "from").mapInArrow(_Read(payloads), shape + (", payload binary" if payloads else ""))
    rows = rows.where(F.col("record_type").isin("response", "revisit"))
    return rows.withColumns({c: F.col(c).try_cast(id_type) for c in ("page_id", "refers_to")})


def lost_records(archives: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, records, read) of the archives of which ``rows`` (as ``read_archives`` gives them) has another number of records."""
    read = rows.groupBy("path").agg(F.count(F.lit(1)).alias("read"))
    both = archives.select("path", "records").join(read, "path", "left").withColumn("read", F.coalesce("read", F.lit(0).cast("long")))
    return both.where("records != read")
