"""WARC archives: one gzip member a record, repeated payloads as revisits, and a splittable reader.

The reader deals byte ranges of the archives to tasks. A task looks for gzip magic from its range's start, takes a
candidate for a member only if it inflates to a WARC header, and then owns every record that begins in its range,
reading on past the range's end for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, slices

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry no time of their own; a fixed one makes archives repeatable.
DATE = "2000-01-01T00:00:00Z"
NO_ID = "none"


def digest_label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{NO_ID if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit has the HTTP header, with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: {digest_label(digest)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def decide(pages: DataFrame) -> DataFrame:
    """__id, __digest and __refers_to of the pages that revisit another: equal payloads of REVISIT_BYTES at least, of which the
    one with the largest page_id is the response. Rows that share the largest id are all responses; a null id is
    smaller than any other. Only digests are shuffled."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    seen = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(f"n >= {REVISIT_BYTES}"), "digests")
    groups = seen.groupBy("digest", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("m")).where("m > 1 and kept is not null").drop("m")
    return seen.join(groups, ["digest", "n"]).where("not (page_id <=> kept)").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("kept").alias("__refers_to")).distinct()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder, which executors must share.

    Returns the manifest (path, bytes), which Spark's committer writes, so that it names only what ended well. Null
    html is an empty payload, a null url is left out, repeated rows are records of their own.
    """
    spark = pages.sparkSession
    revisits = decide(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1("html") == F.col("__digest"))
    joined = rows.join(revisits, same, "left").select("page_id", "url", "html", "__refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        store, base = pafs.FileSystem.from_uri(f"{folder}/archives")
        try:
            for batch in slices(batches, 2):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    data = record(page_id, url, html, hashlib.sha1(html).hexdigest(), refers_to, refers_to is not None)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/archives/{name}"]), pa.array([size], pa.int64())], names=["path", "bytes"])

    joined.mapInArrow(run, "path string, bytes long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("path string, bytes long").parquet(f"{folder}/manifest")


@dataclass
class Record:
    offset: int
    type: str
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int
    length: int = field(default=0)


def parse(data: bytes, offset: int) -> Record:
    """A WARC record from a member's bytes. A block that is no HTTP response is all payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    block = rest[: int(headers.get("content-length", len(rest)))]
    size = None
    if headers.get("content-type", "").startswith("application/http"):
        http, _, block = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                size = int(value)
    return Record(offset, headers.get("warc-type", ""), headers, block, len(block) if size is None else size)


class _Window:
    """Bytes of a file from a moving place, read in steps."""

    def __init__(self, source: pa.NativeFile, at: int, size: int) -> None:
        self.source, self.base, self.data, self.size = source, at, bytearray(), size

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.source.seek(at)
        got = self.source.read(min(READ_BYTES, self.size - at))
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        if to - self.base > READ_BYTES:
            self.data, self.base = self.data[to - self.base :], to

    def inflate(self, at: int, limit: int | None = None) -> tuple[bytes, int] | None:
        """The member at an offset and where it ends; with a limit so many bytes of it. None: it is no member."""
        unpack, out, pos = zlib.decompressobj(31), [], at - self.base
        made = 0
        while True:
            if pos >= len(self.data) and not self.more():
                return None
            chunk = self.data[pos : pos + 16384]
            try:
                got = unpack.decompress(chunk, limit - made) if limit else unpack.decompress(chunk)
            except zlib.error:
                return None
            out.append(got)
            made += len(got)
            pos += len(chunk)
            if unpack.eof:
                return b"".join(out), self.base + pos - len(unpack.unused_data)
            if limit and made >= limit:
                return b"".join(out), -1


def records(source: pa.NativeFile, start: int, end: int, size: int) -> Iterator[Record]:
    """Records that begin at start or after and before end. Damaged stretches are passed over to the next good member."""
    window, at = _Window(source, start, size), start
    while at < end:
        found = window.data.find(MAGIC, at - window.base)
        if found < 0:  # the magic may lie across the end of what has been read
            at = max(at, window.base + len(window.data) - len(MAGIC) + 1)
            window.drop(at)
            if not window.more():
                return
            continue
        at = window.base + found
        if at >= end:
            return
        window.drop(at)
        head = window.inflate(at, len(VERSION))
        member = window.inflate(at) if head and head[0].startswith(b"WARC/1.") else None
        if member is None:
            at += 1
            continue
        made = parse(member[0], at)
        made.length = member[1] - at
        yield made
        at = member[1]


READ = "path string, offset long, length long, record_type string, headers map<string,string>, payload binary, payload_bytes long, payload_digest string"


def checked_digest(r: Record) -> str | None:
    """The payload's SHA-1 in hex: of what was read, which must agree with the header; of a revisit, the header's."""
    label = r.headers.get("warc-payload-digest", "")
    named = base64.b32decode(label.partition(":")[2]).hex() if label.startswith("sha1:") else None
    if r.type == "revisit":
        return named
    own = hashlib.sha1(r.payload).hexdigest()
    if named not in (None, own):
        raise ValueError(f"{r.headers.get('warc-record-id')}: its payload isn't what its digest says")
    return own


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of archives (path, bytes), in byte ranges of split_bytes: READ's columns, payload null unless wanted.
    Any WARC file with a gzip member for each record can be read, not only those of write_warc()."""
    spark: SparkSession = files.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]
    names = ["path", "offset", "length", "record_type", "headers", "payload", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                store, path = pafs.FileSystem.from_uri(row["path"])
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for r in records(source, row["start"], min(row["start"] + split_bytes, row["bytes"]), row["bytes"]):
                        digest = checked_digest(r)
                        rows.append((row["path"], r.offset, r.length, r.type, list(r.headers.items()), r.payload if with_payload else None, r.payload_bytes, digest))
                        held += len(r.payload) if with_payload else 0
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    return dealt.mapInArrow(run, READ)


def query(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A response's digest is that of the payload read; a revisit's is its header's."""
    got = read_warc(write_warc(pages, scratch(pages.sparkSession, "warc")), with_payload=False)
    page = lambda header: F.try_element_at("headers", F.lit(header))
    number = lambda urn: F.regexp_extract(urn, r":(-?\d+)>$", 1).try_cast("long")
    return got.select(number(page("warc-record-id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(page("warc-refers-to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to
FROM k
"""
