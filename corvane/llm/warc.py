"""WARC archives: a writer of one gzip member for each record, and a splittable reader.

Writing: each partition writes one archive under a temporary name and renames it, so that a retried or
speculative task leaves whole files only. Payloads that occur twice are written once, as a response; the
other records are revisits that refer to it and keep the payload's length and digest in their headers.

Reading: a task gets byte ranges of the archives. In its range it looks for the gzip magic, tries each candidate
by inflating its first bytes and checking for a WARC version line, and reads all members that start
inside the range, whatever byte they end at. Chance matches of the magic inside a member fail the check, or lie
before the end of a member that is already read. Payloads are digested as they are inflated.

Paths go through pyarrow file systems (file, hdfs, s3, ...); archives lie in the folder that driver and
executors share.

Defined cases: a null payload is empty; equal payloads of fewer than `least_bytes` bytes are all
responses; rows that share the smallest id of a payload are all responses; a null id is written as an empty id and
never refers or is referred to, unless all rows of a payload have null ids, which are then responses; an empty
table writes no archive and reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
ID_PREFIX = "urn:x-page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; `payload` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>"]
    head += ["WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if payload is None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def parse(raw: bytes) -> dict:
    """The fields of an inflated record."""
    headers, rest = _headers(raw)
    block = rest[: int(headers.get("content-length", len(rest)))]
    http, payload = _headers(block)
    revisit = headers.get("warc-type") == "revisit"
    number = lambda x: int(d) if (d := headers.get(x, "").strip("<>").removeprefix(ID_PREFIX)).lstrip("-").isdigit() else None
    return {
        "page_id": number("warc-record-id"), "record_type": headers.get("warc-type"), "url": headers.get("warc-target-uri"),
        "payload_bytes": int(http.get("content-length", 0)) if revisit else len(payload),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest_of(payload),
        "refers_to": number("warc-refers-to") if revisit else None, "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> list[tuple[str, int]]:
    """Write one archive for each partition under `folder`; (path, bytes) of the archives.

    What a payload's copies refer to is found from ids and digests alone. Payloads are dealt by id and digest, so that
    the copies of a frequent page go to many archives, and only responses write theirs.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    narrow = rows.select("id", "digest", "length").distinct()
    first = narrow.groupBy("digest", "length").agg(F.min("id").alias("first"), F.count("*").alias("ids")).where("ids > 1").drop("ids")
    refers = F.when((F.col("first") != F.col("id")) | F.col("id").isNull(), F.when(F.col("length") >= least_bytes, F.col("first")))
    copies = narrow.join(first, ["digest", "length"]).select("id", "digest", refers.alias("refers_to")).where("refers_to is not null")
    copies = copies.select(F.col("id").alias("copy"), F.col("digest").alias("copied"), "refers_to")
    same = F.coalesce(F.col("id"), F.lit(-(2**63))) == F.coalesce(F.col("copy"), F.lit(-(2**63)))
    rows = rows.join(copies, same & (F.col("digest") == F.col("copied")), "left")
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        out, temporary, size = None, f"{path}/.{uuid.uuid4().hex}.tmp", 0
        name = None
        for batch in batches:
            for id_, target, payload, hex_digest, length, part, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "length", "part", "refers_to"))):
                if out is None:
                    name, out = f"{path}/part-{part:05d}.warc.gz", fs.open_output_stream(temporary, compression=None)
                digest = base64.b32encode(bytes.fromhex(hex_digest)).decode()
                member = record(id_, target, payload, digest, length, refers_to)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"path": [folder.rstrip("/") + name.removeprefix(path)], "bytes": [size]})

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    named = rows.select("id", "url", "payload", "digest", "length", F.spark_partition_id().alias("part"), "refers_to")
    return [(r[0], r[1]) for r in named.mapInArrow(run, "path string, bytes long").collect()]


def members(read, low: int, high: int, size: int, chunk: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """(start, inflated bytes) of the WARC members that start in [low, high); `read(start, length)` gives bytes."""
    at = low
    while at < high:
        window = read(at, min(chunk, high - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0 or at + found >= high:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        end = None
        if zlib_starts_record(read(at, 512)):
            unpacker, pieces, place = zlib.decompressobj(31), [], at
            try:
                while not unpacker.eof and place < size:
                    data = read(place, chunk)
                    pieces.append(unpacker.decompress(data))
                    place += len(data)
                if unpacker.eof:
                    end = place - len(unpacker.unused_data)
            except zlib.error:
                end = None
        if end is None:
            at += 1
            continue
        yield at, b"".join(pieces)
        at = end


def zlib_starts_record(data: bytes) -> bool:
    """Whether a gzip member starts here whose content starts like a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(VERSION)
    except zlib.error:
        return False


def read_archives(spark: SparkSession, archives: DataFrame, *, range_bytes: int = 16 << 20, with_payload: bool = False) -> DataFrame:
    """Records of the archives named by (path, bytes); any archive of gzip members can be cut at any byte."""
    ranges = archives.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))))
    # a round-robin deal of the ranges, one task for a few
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(int(min(max(n, 1), 100_000)))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if with_payload:
        kinds["payload"] = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))

        for batch in batches:
            for path, size, low in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "low"))):
                fs, inner = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(inner) as source:
                    for _, raw in members(lambda start, length: source.read_at(length, start), low, min(size, low + range_bytes), size):
                        rows.append(parse(raw))
                        held += len(raw) if with_payload else 200
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.select("path", "bytes", "low").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back. The archives stay: they are what is read."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if folder.startswith("file:/"):
        folder = "file:///" + folder.removeprefix("file:").lstrip("/")
    elif folder.startswith("/"):
        folder = f"file://{folder}"
    written = write_archives(pages, folder, **columns)
    return read_archives(spark, spark.createDataFrame(written, "path string, bytes long"))
