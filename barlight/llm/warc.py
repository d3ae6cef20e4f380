"""WARC archives of individually compressed records with an embedded dictionary.

An archive is a file of Zstandard frames: a skippable frame that holds a dictionary trained on the archive's own records, and one frame for
each record. Spark's text writer puts the frames into files, so archives go to any file system that Spark reaches, and its commit protocol
makes lost and repeated tasks harmless. The writer needs a separator after each row; an empty skippable frame is one that decoders ignore.

Payloads move once, evenly over the archives. Which records revisit another is settled on digests alone, so a page that a third of all records
copy costs a few bytes for each copy.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from barlight.llm.common import slices
from barlight.session import checkpoint_folder

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 1000
ARCHIVE_BYTES = 32_000_000
DICTIONARY_BYTES = 64_000
TRAINING_BYTES = 4_000_000
LEVEL = 6


def record_id(page: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page}/{digest}").urn


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page, digest)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers is not None:
        head += [f"WARC-Refers-To: <{record_id(refers, digest)}>", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the archive's records; too few to train on serve as they are."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) >= 16 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8, level=LEVEL)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The archive's frames: dictionary, then records. At most TRAINING_BYTES of records wait for the dictionary."""
    waiting: list[bytes] = []
    held, packer = 0, None
    for body in records:
        if packer is None:
            waiting.append(body)
            held += len(body)
            if held < TRAINING_BYTES:
                continue
            packer, first = opened(waiting)
            yield first
            yield from map(packer.compress, waiting)
            waiting = []
        else:
            yield packer.compress(body)
    if waiting:
        packer, first = opened(waiting)
        yield first
        yield from map(packer.compress, waiting)


def opened(samples: list[bytes]) -> tuple[zstandard.ZstdCompressor, bytes]:
    trained = train(samples)
    content = trained.as_bytes()
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True), struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> tuple[DataFrame, int]:
    """(page_id, digest, refers_to) of the records that revisit another, and the bytes of all payloads."""
    digests = pages.select("page_id", "digest", "size")
    total = digests.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = digests.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = digests.filter(F.col("size") >= min_bytes).join(groups, "digest").filter(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    return later.filter(F.col("refers_to").isNotNull()).select("page_id", "digest", "refers_to").distinct(), total


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every row of *pages* (page_id, url, html) into compressed archives below *path*.

    Of records with equal payloads of at least MIN_REVISIT bytes, those with the largest page_id are responses and the others revisit it; rows
    that repeat that id are responses, too. A null html is an empty payload. A null page_id or url leaves its header out; a null page_id counts
    as smaller than any other, and where all ids of equal payloads are null, all are responses. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    whole = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.length("payload").cast("long")})
    again, total = revisits(whole)
    archives = max(1, -(-total // archive_bytes))
    keyed = whole.select("page_id", "url", "payload", "digest", F.xxhash64("page_id", "digest").alias("key")).repartition(archives, "key")
    again = again.select(F.xxhash64("page_id", "digest").alias("key"), F.col("page_id").alias("page"), F.col("digest").alias("same"), "refers_to")
    match = (keyed["key"] == again["key"]) & F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same"))
    records = keyed.join(again, match, "left")
    records = records.select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bodies() -> Iterator[bytes]:
            for part in slices(batches, "payload"):
                for row in part.to_pylist():
                    yield record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date)

        held, size = [], 0
        for frame in frames(bodies()):
            held.append(frame)
            size += len(frame)
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    records.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def parse(archive: bytes) -> Iterator[dict]:
    """Records of one archive, payload digests verified."""
    magic, length = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    known = zstandard.ZstdCompressionDict(archive[8 : 8 + length])
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(memoryview(archive)[8 + length :], read_across_frames=True), 1 << 17)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        kind, page, refers = head["WARC-Type"], head.get("X-Page-ID"), head.get("X-Refers-To-Page")
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of page {page} differs from its digest")
        yield {
            "page_id": None if page is None else int(page), "url": head.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": None if refers is None else int(refers), "payload": payload if kind == "response" else None,
        }


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """A row for each record of the archives below *path*."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload
    fields += [("payload", pa.binary())] * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for row in parse(content.as_py()) if len(content.as_py()) else ():
                    rows.append(row)
                    held += len(row["payload"] or b"") * keep_payload + 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], [n for n, _ in fields])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], [n for n, _ in fields])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write *pages* into archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    path = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path, keep_payload=False)
