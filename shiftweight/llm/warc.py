"""WARC archives with one Zstandard frame per record and a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; each record follows as a frame of its own. Of
records with equal payloads one is a response with the payload, the others are revisits that name it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._features import unit_hash
from ._store import shared_folder, spread_join, written

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
#: Bytes (compressed) after which a task begins another archive.
ARCHIVE_BYTES = 32 << 20
#: Payloads, of at most 64 KB each, that the dictionary is trained on.
SAMPLE_ROWS = 400
DICTIONARY_BYTES = 16 << 10


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary from sample payloads; too few of them give a plain one with the record header."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return record("response", "", "http://example.com/", b"", "A" * 32, None, "1970-01-01T00:00:00Z", 0)


def record(kind: str, page: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, payload_bytes: int) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{RECORD_ID}{page}>"), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(uri, safe="!#$%&'()*+,/:;=?@[]~")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, from its block headers; a frame cut short is an error."""
    if len(data) < at + 5 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    checksum = data[at + 4] >> 2 & 1
    pos = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if pos + 3 > len(data):
            raise ValueError(f"frame at byte {at} is cut short")
        head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)  # a run-length block has one byte
        if head & 1:
            end = pos + 4 * checksum
            if end > len(data):
                raise ValueError(f"frame at byte {at} is cut short")
            return end


def frames(archive: bytes) -> Iterator[bytes]:
    """Records of an archive, decoded with the dictionary from its leading skippable frame."""
    data, at = memoryview(archive), 0
    dictionary = None
    if len(data) >= 8 and struct.unpack_from("<I", data, 0)[0] == DICTIONARY_MAGIC:
        (size,) = struct.unpack_from("<I", data, 4)
        at = 8 + size
        if at > len(data):
            raise ValueError("the dictionary is cut short")
        raw = bytes(data[8:at])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        yield reader.decompress(data[at:end])
        at = end


def parse(raw: bytes) -> dict:
    """Fields of a record; wrong headers, lengths or digests are errors."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing {sorted(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit")
    http, mark, payload = rest[:size].partition(b"\r\n\r\n")
    told = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or not http.startswith(b"HTTP/") or len(told) != 1:
        raise ValueError("not an HTTP response")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != told[0] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("the payload does not fit its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("not a revisit of another record")
    page = lambda name: fields[name].strip("<>").removeprefix(RECORD_ID) if name in fields else None
    return {"page": page("warc-record-id"), "uri": fields.get("warc-target-uri"), "record_type": kind, "payload_digest": digest, "payload_bytes": told[0], "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}


def _write(folder: str, dictionary, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        raw = dictionary.value
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
        task = TaskContext.get()
        part, number, out, size, records, temporary = f"{task.partitionId():06d}-{task.taskAttemptId():09d}", 0, None, 0, 0, ""

        def close() -> pa.RecordBatch:
            """The name holds the attempt: what a lost attempt left behind is in no list and is not read."""
            nonlocal out, number
            out.close()
            name = f"part-{part}-{number:04d}.warc.zst"
            fs.move(temporary, f"{base}/{name}")
            out, number = None, number + 1
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    temporary, size, records = f"{base}/_{uuid.uuid4().hex}", 8 + len(raw), 0
                    out = fs.open_output_stream(temporary)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
                payload = row["payload"]
                kind = "revisit" if row["refers_to"] is not None else "response"
                digest = base64.b32encode(binascii.unhexlify(row["sha1"])).decode()
                frame = writer.compress(record(kind, row["page"], row["uri"], payload, digest, row["refers_to"], date, len(payload)))
                out.write(frame)
                size, records = size + len(frame), records + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row to ``folder`` and return the written archives (archive, records, bytes).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least ``least_bytes`` bytes those
    with the smallest page_id are responses, the others revisits of it; rows with smaller payloads are responses.
    A null url gives no target URI. Null page_ids are allowed; they are responses only if no equal payload has
    a page_id. Rows that repeat a page_id with one payload are responses alike. Other columns are ignored.

    Scale: payload digests are counted with partial sums, so a payload that millions of pages share costs one row per
    task; digests that repeat are joined back, and pages that share one are spread over tasks. Archives have a bounded
    size, whatever a task holds.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("uri"), body.alias("payload")).withColumn("sha1", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= least_bytes)
    first = written(large.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    told = F.when(F.octet_length("payload") >= least_bytes, F.nullif(F.col("first"), F.col("page_id")))
    linked = spread_join(rows, first, ["sha1"], F.xxhash64("page_id", "uri"), "left").select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "uri", "payload", "sha1", told.cast("string").alias("refers_to"))
    # About SAMPLE_ROWS rows by hash: what reaches the driver does not grow with the number of tasks.
    share = min(1.0, SAMPLE_ROWS / max(pages.count(), 1))
    sample = rows.filter((unit_hash(F.col("page_id")) < share) & (F.octet_length("payload") <= 1 << 16)).orderBy(F.xxhash64("page_id"), "sha1").select("payload")
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary([bytes(r.payload) for r in sample.limit(2 * SAMPLE_ROWS).collect()]))
    fs, base = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return written(linked.mapInArrow(_write(folder, dictionary, date), "archive string, records bigint, bytes bigint"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page", "uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()], strict=True)))
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows: list[dict] = []
            held = 0
            for i, raw in enumerate(frames(content.as_py())):
                try:
                    rows.append(parse(raw))
                except ValueError as e:
                    raise ValueError(f"{path}, record {i}: {e}") from e
                held += len(raw)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


RECORDS = "page string, uri string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"


def read_listed(archives: DataFrame, folder: str) -> DataFrame:
    """Records as of ``read_archives``, of the archives that a table (archive) names; others in the folder are not opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as file:  # frames are read one by one
                    content = file.read()
                yield from _read(iter([pa.RecordBatch.from_pydict({"path": [f"{base}/{name}"], "content": pa.array([content], pa.large_binary())})]))

    return archives.select("archive").repartition(max(1, min(archives.count(), 1 << 15)), "archive").mapInArrow(run, RECORDS)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page, uri, record_type, payload_digest, payload_bytes, refers_to, payload) of all records in a folder.

    Every record's headers, lengths and (for responses) digest are validated; a bad record or a frame cut short
    fails the job with the archive's path. A folder without archives gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(_read, RECORDS)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; ``page_id`` has its type again."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    archives = write_archives(pages, folder, page_id, url, html)
    kind = pages.schema[page_id].dataType
    back = lambda c: F.nullif(F.col(c), F.lit("")).cast(kind)
    return read_listed(archives, folder).withColumns({"page_id": back("page"), "refers_to": back("refers_to")}).drop("page")
