"""WARC archives written and read as streams of chunks.

Payloads travel as rows (record, chunk number, bytes) of at most CHUNK bytes, cut by the JVM where the page is read and
before anything is shuffled; the narrow row that says what becomes of a record travels ahead of its chunks. Writer and
reader carry a SHA-1 from chunk to chunk, so neither holds a whole record. Of records of equal payload that with the least page_id is
a response, the others revisit it. Archives are gzip files, a member for each record, in a folder that driver and
executors share; a task writes under a name of its own, and only files named by tasks that finished are read, so lost
executors and repeated tasks leave nothing that counts.

Defined cases: a null payload is empty; payloads below `least_bytes` are responses whatever their copies; rows that
repeat the least page_id of their payload are all responses; a null page_id sorts last; a null url is written as
urn:page:<id>; an empty table makes no archive and an empty result; other columns are ignored. Archives go to any store
that pyarrow knows (local, HDFS, S3, GCS, Azure); another scheme is refused before anything is written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, batch, cut, new_place, store_of

CHUNK = 256 * 1024
ARCHIVE_BYTES = 256 * 1024 * 1024  # of payload, after which a task begins another archive
READ = 64 * 1024
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _data(payload: str):
    return F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))


def decisions(pages: DataFrame, payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, sha1 (hex), bytes, refers_to: null for responses. Equal payloads meet as their digests alone."""
    marked = cut(pages.select("page_id", F.sha1(_data(payload)).alias("sha1"), F.octet_length(_data(payload)).cast("long").alias("bytes")), "digests")
    first = marked.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"))
    refers = F.when((F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return marked.join(first, "sha1", "left").select("page_id", "sha1", "bytes", refers.alias("refers_to"))


def chunks(pages: DataFrame, payload: str = "html", least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: page_id, sha1, copy, chunk, last, url, bytes, refers_to, data; rows of one payload of a page stand together.

    First comes its decision (copy and chunk are -1, data is null), then the chunks of each row of the table that has it, in order.
    """
    made = decisions(pages, payload, least_bytes).distinct()
    heads = made.select("page_id", "sha1", F.lit(-1).cast("long").alias("copy"), F.lit(-1).alias("chunk"), F.lit(-1).alias("last"), F.lit(None).cast("string").alias("url"), "bytes", "refers_to", F.lit(None).cast("binary").alias("data"))
    own = pages.select("page_id", "url", _data(payload).alias("data"), F.monotonically_increasing_id().alias("copy"))
    last = F.greatest(F.ceil(F.octet_length("data") / chunk) - 1, F.lit(0)).cast("int")
    sized = own.select("page_id", "copy", "url", "data", F.sha1("data").alias("sha1"), F.octet_length("data").cast("long").alias("bytes"), last.alias("last"))
    cut_up = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = cut_up.select("page_id", "sha1", "copy", "chunk", "last", "url", "bytes", F.lit(None).cast("long").alias("refers_to"), F.expr(f"substring(data, chunk * {chunk} + 1, {chunk})").alias("data"))
    return heads.unionByName(rows).repartition("page_id", "sha1").sortWithinPartitions("page_id", "sha1", "copy", "chunk")


def _head(kind: str, page, url, sha1: str, length: int, refers) -> bytes:
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: " + record_id(page).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + " ".join((url or f"urn:page:{page}").split()).encode(),
        b"WARC-Payload-Digest: sha1:" + base32(bytes.fromhex(sha1)).encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % length,
    ]
    if page is not None:
        lines.append(b"Page-ID: %d" % page)
    if kind == "revisit":
        lines += [b"WARC-Refers-To: " + record_id(refers).encode(), b"WARC-Profile: " + _PROFILE, b"Refers-To-Page-ID: %d" % refers]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def open_stream(path: str, mode: str):
    store, inner = store_of(path)
    if mode == "r":
        return store.open_input_stream(inner, compression=None)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)


class Writer:
    """An archive: records begin, take chunks and end; each is a gzip member."""

    def __init__(self, path: str):
        self.path, self.file, self.written = path, open_stream(path, "w"), 0

    def begin(self, page, url, sha1: str, size: int, refers) -> None:
        http = _HTTP % size
        kind = "response" if refers is None else "revisit"
        self.sha1, self.digest, self.kind = sha1, hashlib.sha1(), kind
        self.member = gzip.GzipFile(fileobj=self.file, mode="wb", compresslevel=6, mtime=0)
        self.member.write(_head(kind, page, url, sha1, len(http) + (size if refers is None else 0), refers) + http)

    def chunk(self, data: bytes) -> None:
        self.digest.update(data)
        self.member.write(data)
        self.written += len(data)

    def end(self) -> None:
        self.member.write(b"\r\n\r\n")
        self.member.close()
        if self.kind == "response" and self.digest.hexdigest() != self.sha1:
            raise ValueError("chunks don't make up the record's payload")

    def close(self) -> None:
        self.file.close()


def write(pages: DataFrame, folder: str, payload: str = "html", least_bytes: int = 0, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives below folder; returns the manifest: path, records of each archive."""
    store_of(folder)
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, records, refers = None, 0, None
        for b in batches:
            for page, url, sha1, size, told, data, last, number in zip(*(b.column(c) for c in ("page_id", "url", "sha1", "bytes", "refers_to", "data", "last", "chunk")), strict=True):
                if (at := number.as_py()) < 0:
                    refers = told.as_py()
                    continue
                if at == 0:
                    if writer and writer.written >= archive_bytes:
                        writer.close()
                        yield batch(schema, [writer.path], [records])
                        writer = None
                    if not writer:
                        writer, records = Writer(f"{folder}/part-{uuid.uuid4().hex}.warc.gz"), 0
                    writer.begin(page.as_py(), url.as_py(), sha1.as_py(), size.as_py(), refers)
                if refers is None:
                    writer.chunk(data.as_buffer())
                if at == last.as_py():
                    writer.end()
                    records += 1
        if writer:
            writer.close()
            yield batch(schema, [writer.path], [records])

    return cut(arrow_map(chunks(pages, payload, least_bytes, chunk), run, "path string, records long"), "manifest")


def _fields(stream) -> dict[str, str] | None:
    """Header lines up to the blank one; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    found = {"": line.decode().strip()}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict, dict, Iterator[bytes]]]:
    """(WARC fields, HTTP fields, payload chunks) of each record; what is left of a payload is skipped."""
    while (head := _fields(stream)) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError("not a WARC record")
        left = int(head["content-length"])
        block = _Counted(stream)
        http = (_fields(block) or {}) if left and head.get("content-type", "").startswith("application/http") else {}
        left -= block.read_bytes

        def payload(n=left):
            while n:
                data = stream.read(min(chunk, n))
                if not data:
                    raise EOFError("the archive ends within a record")
                n -= len(data)
                yield data

        body = payload()
        yield head, http, body
        for _ in body:
            pass


class _Counted:
    def __init__(self, stream):
        self.stream, self.read_bytes = stream, 0

    def readline(self) -> bytes:
        line = self.stream.readline()
        self.read_bytes += len(line)
        return line


def read(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The archives' chunked record table: page_id, url, record_type, refers_to, stated_digest, http_bytes, chunk, last, data, bytes, digest.

    bytes and digest (base32 SHA-1) cover the payload up to and with the row's chunk. data: without it only the last
    chunk's row of each record is returned, its data left out.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("http_bytes", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes", pa.int64()), ("digest", pa.string())]
    )
    most = 8 * 1024 * 1024 if data else 4096

    def rows_of(path: str) -> Iterator[tuple]:
        with open_stream(path, "r") as raw, gzip.GzipFile(fileobj=io.BufferedReader(_Raw(raw), READ)) as stream:
            for head, http, body in records(stream, chunk):
                number = lambda x: None if x is None else int(x)
                fixed = (number(head.get("page-id")), head.get("warc-target-uri"), head["warc-type"], number(head.get("refers-to-page-id")), head.get("warc-payload-digest", "").removeprefix("sha1:"), number(http.get("content-length")))
                digest, size, now, at = hashlib.sha1(), 0, next(body, b""), 0
                while True:
                    after = next(body, None)
                    digest.update(now)
                    size += len(now)
                    if data or after is None:
                        yield (*fixed, at, after is None, now if data else None, size, base32(digest.digest()))
                    if after is None:
                        break
                    now, at = after, at + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                held, weight = [], 0
                for row in rows_of(path):
                    held.append(row)
                    weight += len(row[8] or b"") if data else 1
                    if weight >= most:
                        yield batch(schema, *zip(*held, strict=True))
                        held, weight = [], 0
                if held:
                    yield batch(schema, *zip(*held, strict=True))

    files = max(1, manifest.count())
    spread = manifest.select("path").repartitionByRange(min(files, 10_000), "path")
    return arrow_map(spread, run, "page_id long, url string, record_type string, refers_to long, stated_digest string, http_bytes long, chunk int, last boolean, data binary, bytes long, digest string")


class _Raw(io.RawIOBase):
    """A pyarrow stream as a raw file."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def summary(read_back: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record read back; responses' digests are those of the bytes read."""
    full = read_back.where("last")
    response = F.col("record_type") == "response"
    return full.select(
        "page_id",
        F.when(response, F.col("bytes")).otherwise(F.col("http_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame, payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back, and tell of each record."""
    spark = pages.sparkSession
    folder = new_place(spark, "warc")
    return summary(read(spark, write(pages, folder, payload, least_bytes), data=False))
