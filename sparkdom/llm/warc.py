"""WARC archives: a writer and a sequential reader.

Every record is one gzip member, and archives are `.warc.gz` files in the shared folder.
They are written through Spark, so that lost tasks leave nothing behind and any file
system will do: its text writer puts rows of bytes down as they are, each with a last
zero byte, and zero is what a gzip member under 16 MB ends with. The reader inflates a member at a time with an
incremental zlib object, frames the block by Content-Length and checks the block digest,
and the payload digest where the record holds the payload.

Defined cases: a null payload is an empty one; a null id is written as an empty id, is
always a response and is never referred to; rows repeated with the same id and payload
are each a response; an empty table gives no archive and no rows; a damaged record
raises WarcError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdom.llm.common import materialize, new_path

#: A row of members is closed once it has this many compressed bytes; rows of a file.
ARCHIVE_BYTES, FILE_ROWS = 4 << 20, 16
#: Compressed bytes handed to zlib at once.
CHUNK = 1 << 16


EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31).flush()


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, payload = self.block.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str, payload: bytes, ident: str = "", refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> bytes:
    """One record as one gzip member. A revisit carries the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ident + ' ' + uri)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"X-Source-ID: {ident}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-ID: {refers_to}"]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _ending(parts: list[bytes]) -> bytes:
    """The members without the zero byte that they end with; an empty member ends those that have none."""
    data = b"".join(parts)
    return data[:-1] if not data[-1] else data + EMPTY[:-1]


def chunks(data: bytes) -> Iterator[memoryview]:
    view = memoryview(data)
    for i in range(0, len(view), CHUNK):
        yield view[i : i + CHUNK]


def members(stream: Iterable[bytes]) -> Iterator[bytes]:
    """Inflate member after member; one member is held at a time."""
    z, parts, rest = None, [], b""
    for piece in stream:
        rest = bytes(piece)
        while rest:
            z = z or zlib.decompressobj(31)
            try:
                parts.append(z.decompress(rest))
            except zlib.error as e:
                raise WarcError(f"damaged gzip member: {e}") from e
            rest = z.unused_data
            if z.eof:
                if any(parts):
                    yield b"".join(parts)
                z, parts = None, []
            else:
                rest = b""
    if z is not None:
        raise WarcError("the archive ends inside a gzip member")


def parse(data: bytes) -> Record:
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {n}")
    out = Record(headers, rest[:n])
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{digest(out.block)}":
        raise WarcError("block digest differs")
    if out.kind == "response" and (want := headers.get("warc-payload-digest")) and want != f"sha1:{digest(out.http()[1])}":
        raise WarcError("payload digest differs")
    return out


def read_records(stream: Iterable[bytes]) -> Iterator[Record]:
    for m in members(stream):
        yield parse(m)


def plan_records(df: DataFrame, key: str, payload: str, min_revisit: int = 0) -> DataFrame:
    """key, url, payload, kind, refers_to: of equal payloads of at least min_revisit bytes the largest key is the response.

    Digests met more than once are written first, with their largest key. Where they are few
    Spark broadcasts them and no payload moves; else the join deals both sides anew, and
    a digest that many rows have can be split.
    """
    rows = df.select(F.col(key).alias("id"), "url", F.coalesce(F.col(payload), F.lit("")).alias("payload")).withColumn("sum", F.sha1(F.col("payload").cast("binary")))
    met = rows.where(F.col("id").isNotNull() & (F.octet_length("payload") >= min_revisit)).groupBy("sum").agg(F.min("id").alias("low"), F.max("id").alias("top"))
    met, _ = materialize(df.sparkSession, met.where("low < top").select("sum", "top"), "digests")
    revisit = F.col("id") < F.col("top")
    return rows.join(met, "sum", "left").select("id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_archives(plan: DataFrame, path: str) -> None:
    """Write the records as .warc.gz files into the folder path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0
        for b in batches:
            for i, url, payload, kind, ref in zip(*b.columns, strict=True):
                i, url, ref = i.as_py(), url.as_py() or "", ref.as_py()
                parts.append(record(kind.as_py(), url.replace("\r", "%0D").replace("\n", "%0A"), payload.as_py().encode(), "" if i is None else str(i), None if ref is None else str(ref)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"members": pa.array([_ending(parts)], pa.binary())})
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_pydict({"members": pa.array([_ending(parts)], pa.binary())})

    spark = plan.sparkSession
    # a cast changes no byte
    plan.mapInArrow(run, "members binary").select(F.col("members").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_ROWS).text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name[:-4]}.warc.gz"))


def read_archives(archives: DataFrame, content: str = "content", with_block: bool = False) -> DataFrame:
    """One row per record of every archive: id, uri, type, payload length and digest, the id a revisit refers to."""
    schema = "id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", block binary" * with_block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                rows: list[tuple] = []
                for r in read_records(chunks(memoryview(blob.as_buffer()) if blob.is_valid else b"")):
                    h = r.headers
                    http, payload = r.http()
                    size = len(payload) if r.kind == "response" else int(http.get("content-length", 0))
                    rows.append((int(h["x-source-id"]) if h.get("x-source-id") else None, h.get("warc-target-uri"), r.kind, size, h.get("warc-payload-digest", "").removeprefix("sha1:"), int(h["x-refers-to-id"]) if h.get("x-refers-to-id") else None, *([r.block] if with_block else [])))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], ["id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "block"][: len(rows[0])])

    return archives.select(content).mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the .warc.gz files under path; a file is held whole by the task that reads it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return read_archives(files)


def round_trip(spark: SparkSession, df: DataFrame, key: str = "page_id", payload: str = "html", min_revisit: int = 0) -> DataFrame:
    """Write a record for every row into archives in the shared folder and read them back."""
    path = new_path(spark, "warc")
    write_archives(plan_records(df, key, payload, min_revisit), path)
    got = read_warc(spark, path)
    return got.select(F.col("id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
