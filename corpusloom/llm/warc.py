"""WARC writing with a dictionary, and reading back.

A Zstandard dictionary is trained on a bounded sample of the records, stands as a skippable frame at
the head of each archive, and each record is compressed with it as a frame of its own. Records
whose payload is archived elsewhere are revisits.

Which record a payload is kept in is found from (page_id, digest) rows alone; then the pages move once,
by page_id, and each task writes archives of its own to the shared folder. A file gets a
name of its own for each attempt and counts only if the task's row of the manifest does, so lost
executors and retried tasks leave no wrong records.

Defined results: a null payload is empty; a null url is about:blank; of pages with equal payloads
that with the largest page_id is the response, rows that repeat it are responses too; a null page_id
is a response always; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialise, shared_path, table

#: Magic number of the skippable frame that holds a dictionary, and of a zstd frame.
DICTIONARY_FRAME = 0x184D2A5D
ROLL = 256 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page_id."""
    n = (page_id or 0) & (1 << 64) - 1
    value = 0xC0C0 << 112 | 8 << 76 | ((page_id is None) << 11 | n >> 62) << 64 | 2 << 62 | n & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").rpartition(":")[2]).int
    high = value >> 64 & 0xFFF
    n = (high & 3) << 62 | value & (1 << 62) - 1
    return None if high >> 11 else n - (n >> 63 << 64)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page refers_to: its block has the HTTP headers only."""
    uri = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    more = "" if refers_to is None else f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: {record_id(refers_to)}\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: {record_id(page_id)}\r\nWARC-Date: {DATE}\r\n"
        f"WARC-Target-URI: {uri}\r\n{more}WARC-Payload-Digest: sha1:{digest(payload)}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary from records; from too few to train on, their own bytes; from none, nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Writer:
    """Archive files under a folder that every executor reaches; manifest rows are (file, records)."""

    def __init__(self, folder: str, dictionary: bytes, roll: int = ROLL):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.dictionary, self.roll = dictionary, roll
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=known)

    def write(self, records: Iterable[bytes]) -> Iterator[tuple[str, int]]:
        out, count, size, name = None, 0, 0, ""
        for one in records:
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                out = self.store.open_output_stream(f"{self.folder}/{name}", compression=None)  # pyarrow would compress the whole by the name
                out.write(struct.pack("<II", DICTIONARY_FRAME, len(self.dictionary)) + self.dictionary)
            frame = self.zstd.compress(one)
            out.write(frame)
            count, size = count + 1, size + len(frame)
            if size >= self.roll:
                out.close()
                yield name, count
                out, count, size = None, 0, 0
        if out is not None:
            out.close()
            yield name, count


def read(file: BinaryIO, records: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record of an archive, one record in memory at a time; records: how many there must be."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    dictionary = file.read(size)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    stream, held, count = zstd.stream_reader(file, read_across_frames=True), b"", 0
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not (more := stream.read(1 << 16)):
                if held or records not in (None, count):
                    raise ValueError("an archive breaks off")
                return
            held += more
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in held[:end].decode().split("\r\n")[1:])}
        need = end + 8 + int(headers["content-length"])
        parts, have = [held], len(held)
        while have < need:
            more = stream.read(max(1 << 16, need - have))
            if not more:
                raise ValueError("a record breaks off")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        count += 1
        yield headers, held[end + 4 : need - 4]
        held = held[need:]


def parsed(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type, refers_to; a response's payload must have the digest it names."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    named, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError("a payload differs from its digest")
    return page_of(headers["warc-record-id"]), size, named, kind, page_of(headers["warc-refers-to"]) if kind == "revisit" else None


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its store's scheme, so that pyarrow in a task means what Spark means."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to (null for a response)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keys = rows.select("page_id", F.sha2("payload", 256).alias("same"))
    # stored, so that the join has shuffles of its own, which the rows of a very common payload can be split over
    kept = materialise(keys.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-kept")
    revisits = keys.join(kept, "same").where("page_id <> refers_to").select("page_id", "same", "refers_to").distinct()
    # repeated page_ids with other payloads keep their own records
    return rows.withColumn("same", F.sha2("payload", 256)).join(revisits, ["page_id", "same"], "left").drop("same")


def dictionary_of(pages: DataFrame, records: int = 400, most: int = 64 << 10) -> bytes:
    """Trained on at most `records` records of at most `most` bytes of html, those with the smallest hash of the page_id."""
    some = pages.where(F.octet_length("html") <= most).select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    ids = [r.page_id for r in some.select("page_id").dropDuplicates(["page_id"]).orderBy(F.xxhash64("page_id"), "page_id").limit(records).collect()]
    wanted = some.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min(F.struct("url", "html")).alias("r")).select("page_id", "r.*")
    return train([record(r.page_id, r.url, bytes(r.html), None) for r in wanted.orderBy("page_id").collect()])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives under folder; returns the manifest: file, records."""
    folder = qualified(pages.sparkSession, folder)
    jvm, conf = pages.sparkSession.sparkContext._jvm, pages.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).mkdirs(path)
    dictionary = pages.sparkSession.sparkContext.broadcast(dictionary_of(pages))
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (record(*(x.as_py() for x in row)) for batch in batches for row in zip(*batch.columns, strict=True))
        return in_batches(Writer(folder, dictionary.value).write(rows), schema)

    return materialise(planned(pages).select("page_id", "url", "payload", "refers_to").mapInArrow(archive, "file string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the manifest's files."""
    folder = qualified(manifest.sparkSession, folder)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def records(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    yield from (parsed(h, b) for h, b in read(file, count))

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "records").repartition(parts, "file").mapInArrow(lambda b: in_batches(records(b), schema), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)
