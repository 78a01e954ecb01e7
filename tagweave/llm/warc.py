"""Deterministic sharded WARC writer and reader.

Records are range-sorted by (page_id, payload digest) and written as gzip members, one
per record, to files that roll once their compressed size reaches ``roll_bytes``.  All
headers are regenerated from the row alone: record ids and digests from the payload, the
date from a parameter, so equal input gives equal bytes.  A file is written under a
temporary name and renamed when whole; the manifest (Parquet, committed last) lists the
files with size, digest and key range, and readers open only what it lists.

Of pages with equal payloads of at least ``min_revisit`` (100) bytes, the smallest
page_id is a response and the others are revisits that refer to it and carry no payload;
smaller payloads are always responses.  Only (page_id, digest) is shuffled to find them,
and each decision travels to its page inside the range sort, as a row just before it.

A null html is an empty payload; a null url is an empty one; a null page_id is written
and read as null; of equal rows one is the response and the others revisit it.  An empty
table gives an empty manifest.

Ids are integers, or text that Spark casts to them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .tokens import file_system, mapped

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(page: int | None, url: str, payload: bytes, size: int, digest: str, refers: int | None, date: str) -> bytes:
    """One WARC record; payload is unused if it revisits."""
    block = _HTTP % size + (b"" if refers is not None else payload)
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page}:{digest}")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        lines[8:8] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers}:{digest}')}>", f"X-Refers-To-Page: {refers}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, digest, refers): pages that revisit another of equal payload."""
    keys = c.stored(pages.filter(F.col("size") >= min_revisit).filter("page_id IS NOT NULL").select("page_id", "digest"), "digests")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers"), F.count("*").alias("n")).filter("n > 1")
    return c.heavy_join(keys, c.stored(first, "repeated"), ["digest"], "n", keys.count()).filter("page_id <> refers").select("page_id", "digest", "refers").distinct()


def write(pages: DataFrame, folder: str, roll_bytes: int = 256 << 20, date: str = "2020-01-01T00:00:00Z", level: int = 6, min_revisit: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives, returns the manifest."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"))
    sized = rows.withColumns({"size": F.octet_length("html"), "digest": F.sha2("html", 256)})
    told = revisits(sized, min_revisit).select("page_id", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit(b"").alias("html"), "refers")
    own = sized.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers"))
    ordered = own.unionByName(told).repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url")

    def run(batches):
        number = TaskContext.get().partitionId()
        out = Rolling(folder, number, roll_bytes)
        told, before = None, None
        for b in batches:
            columns = [x.to_pylist() for x in b.columns]
            for page, digest, kind, url, body, refers in zip(*columns):
                if kind == 0:
                    told = (page, digest, refers)
                    continue
                to = told[2] if told and told[:2] == (page, digest) else None
                if to is None and before == (page, digest) and len(body) >= min_revisit and page is not None:
                    to = page  # a repeated row
                before = (page, digest)
                out.add(page, member(record(page, url, body, len(body), digest, to, date), level))
        yield from out.close()

    done = c.stored(ordered.mapInArrow(c.tidy(run), "file string, n_records long, bytes long, sha256 string, first_id long, last_id long"), "warc-files")
    done.coalesce(1).sortWithinPartitions("file").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class Rolling:
    """Files of one task: temporary names until they are whole."""

    def __init__(self, folder: str, number: int, roll_bytes: int):
        self.folder, self.number, self.roll_bytes = folder, number, roll_bytes
        self.stream, self.rows = None, []

    def add(self, key, data: bytes) -> None:
        if self.stream is None:
            self.name = f"part-{self.number:05d}-{len(self.rows):05d}.warc.gz"
            self.fs, self.path = file_system(f"{self.folder}/{self.name}")
            self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
            self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
            self.stream, self.n, self.size, self.sha, self.first = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256(), key
            self._put(member(b"\r\n".join([b"WARC/1.1", b"WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>".encode(), b"WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Filename: {self.name}".encode(), b"Content-Type: application/warc-fields", b"Content-Length: 0", b"", b"", b"", b""])))
        self._put(data)
        self.n, self.last = self.n + 1, key
        if self.size >= self.roll_bytes:
            self._end()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha.update(data)
        self.size += len(data)

    def _end(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)
        self.rows.append((self.name, self.n, self.size, self.sha.hexdigest(), self.first, self.last))
        self.stream = None

    def close(self):
        if self.stream is not None:
            self._end()
        if self.rows:
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*self.rows), types)], names=["file", "n_records", "bytes", "sha256", "first_id", "last_id"])


def records(data):
    """(headers, block) of each gzip member in a buffer."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            step = view[at : at + (1 << 16)]
            if not len(step):
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(step))
            at += len(step) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the manifest's files; digests are computed anew and must agree with the headers."""
    files = spark.read.parquet(f"{folder}/manifest")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    files = files.repartition(max(1, min(files.count(), 100_000)), "file")

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, path = file_system(f"{folder}/{row['file']}")
                held = []
                for h, block in records(mapped(fs, path, "u1")):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload = block.partition(b"\r\n\r\n")[2]
                    size = int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"a payload of {row['file']} doesn't agree with its headers")
                    held.append((int(h["X-Page-ID"]) if h["X-Page-ID"] else None, size, digest, h["WARC-Type"], int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None, h["WARC-Target-URI"], row["file"]))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)

    return files.mapInArrow(c.tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = c.new_path(spark, "warc")
    write(c.table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to FROM f
"""
