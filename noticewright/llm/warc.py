"""WARC archives, index first.

Each task writes the records of its split to archives of its own in the shared folder, one gzip
member per record, and returns offset, length, URL and digest of every record. That index is a
table; reading selects rows of it, sorts them by place and fetches neighbouring records with one
byte-range read. An archive's name holds a random part and only the index says which archives
count, so a task that is run again (a lost executor) leaves no double records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, table, written

#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Payloads under this size are always stored whole.
LEAST_REVISIT = 100
#: Duplicate digests (some 60 bytes a row) that may be broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
#: Records at most this far apart are read together, up to so many bytes a read.
GAP, READ = 64 << 10, 8 << 20

INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "archive string, offset long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _store(uri: str):
    """The store of ``uri``; only the folder that executors share is reached this way."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds no payload, but names digest, size and first record."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if is_revisit else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers and block of one record; a record that isn't whole raises ValueError."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    if not sep or not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
    return headers, rest[:size]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str):
    def run(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = _gzip(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["first"], r["again"]))
                    out.write(data)
                    rows.append((name, at, len(data), r["url"], r["digest"], r["page_id"], "revisit" if r["again"] else "response"))
                    at += len(data)
                names = ["archive", "offset", "length", "url", "digest", "page_id", "record_type"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` to archives in ``folder``; return the index.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the smallest page_id is stored and the
    others refer to it. A null html is an empty payload. Repeated rows with the smallest id are
    stored each; a row without an id refers to the first one that has an id, and is stored if none
    has. Empty tables make no archive and an empty index; further columns are ignored.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    groups = base.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    groups = written(groups, "warc-groups")
    small = groups.count() <= BROADCAST_DIGESTS
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return base.join(F.broadcast(groups) if small else groups, "digest", "left").select("page_id", "url", "html", "digest", "first", again.alias("again")).mapInArrow(_write(folder), INDEX)


def _spans(places):
    """Sorted (offset, length) -> [(start, size, members)], neighbours joined."""
    start = end = None
    held = []
    for i, (offset, length) in enumerate(places):
        if held and (offset - end > GAP or offset + length - start > READ):
            yield start, end - start, held
            held = []
        if not held:
            start = offset
        held.append(i)
        end = offset + length
    if held:
        yield start, end - start, held


def _read(folder: str, with_payload: bool):
    def run(batches):
        store, root = _store(folder)
        name, source = None, None
        try:
            for batch in batches:
                rows = batch.to_pylist()
                lo = 0
                while lo < len(rows):
                    hi = lo
                    while hi < len(rows) and rows[hi]["archive"] == rows[lo]["archive"]:
                        hi += 1
                    if name != rows[lo]["archive"]:
                        if source is not None:
                            source.close()
                        name = rows[lo]["archive"]
                        source = store.open_input_file(f"{root}/{name}")
                    part = rows[lo:hi]
                    for start, size, members in _spans([(r["offset"], r["length"]) for r in part]):
                        data = source.read_at(size, start)
                        out = []
                        for i in members:
                            r = part[i]
                            at = r["offset"] - start
                            headers, block = parse(zlib.decompress(data[at : at + r["length"]], 31))
                            out.append(_row(r, headers, block, with_payload))
                        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                    lo = hi
        finally:
            if source is not None:
                source.close()

    return run


_SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _row(place: dict, headers: dict, block: bytes, with_payload: bool) -> dict:
    number = lambda uri: int(uri[len("<urn:page:") : -1]) if uri and uri != "<urn:page:>" else None
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} doesn't have the digest that it names")
    return {"archive": place["archive"], "offset": place["offset"], "page_id": number(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"] or None, "record_type": headers["WARC-Type"], "payload_digest": digest, "payload_bytes": int(headers["X-Payload-Length"]), "refers_to": number(headers.get("WARC-Refers-To")), "payload": block if with_payload else None}


def read_archives(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records at the index rows ``selected``. The reads are dealt by range of (archive, offset), so
    that a large archive is read by several tasks and each reads forward."""
    places = selected.select("archive", "offset", "length")
    return places.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(_read(folder, with_payload), RECORD)


def round_trip(pages: DataFrame, **columns) -> tuple[DataFrame, str]:
    """Archive ``pages`` and commit the index as a table; return it and the archives' folder."""
    folder = new_path(pages.sparkSession, "warc")
    return written(write_archives(pages, folder, **columns), "warc-index"), folder


def op6_warc(spark, sf_dir: str) -> DataFrame:
    index, folder = round_trip(table(spark, sf_dir, "pages"))
    return read_archives(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""
