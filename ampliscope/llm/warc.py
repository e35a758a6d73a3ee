"""WARC archives in Zstandard: written through Spark, read back frame by frame.

An archive begins with a skippable frame that holds its dictionary; then comes one frame for each record. Spark's text
writer puts the frames out, ROW_BYTES a line; its line separator is an empty skippable frame, which Zstandard allows between frames, so
the files are valid archives and are written to any store that Spark can write. Each line begins with the dictionary, so that a task's
archive can be rolled after ARCHIVE_LINES lines: no archive grows with its partition."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import adopt, prepare, shared_dir

FRAME, DICTIONARY, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
SEPARATOR = struct.pack("<II", SKIPPABLE[0], 0)
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 14
ROW_BYTES, ARCHIVE_LINES = 16 << 20, 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:ampliscope:page:"


class BadArchive(ValueError):
    """An archive, a frame or a record that breaks the format."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{NAME}{page_id}>", "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head |= {"WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": "application/http; msgtype=response"}
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{NAME}{refers_to}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _named(value: str) -> int | None:
    if not value.startswith(f"<{NAME}") or not value.endswith(">"):
        raise BadArchive(f"record name {value!r}")
    value = value[len(NAME) + 1 : -1]
    return None if value == "None" else int(value)


def _headers(raw: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in raw.decode().split("\r\n"):
        name, colon, value = line.partition(": ")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"{what} header {line[:80]!r}")
        out[name.lower()] = value
    return out


def parsed(raw: bytes) -> dict:
    """The record in raw, after checks of version, headers, lengths and digest."""
    first, end = raw.find(b"\r\n"), raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < first:
        raise BadArchive("no WARC version line or no end of headers")
    head = _headers(raw[first + 2 : end], "WARC")
    for need in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"):
        if need not in head:
            raise BadArchive(f"no {need}")
    size, block = int(head["content-length"]), raw[end + 4 : -4]
    if len(block) != size or not raw.endswith(b"\r\n\r\n"):
        raise BadArchive(f"a block of {len(block)} bytes, declared as {size}")
    mid = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or mid < 0:
        raise BadArchive("the block is no HTTP message")
    http = _headers(block[block.find(b"\r\n") + 2 : mid], "HTTP")
    length, payload, revisit = int(http["content-length"]), block[mid + 4 :], head["warc-type"] == "revisit"
    if head["warc-type"] not in ("response", "revisit") or len(payload) != (0 if revisit else length):
        raise BadArchive(f"a {head['warc-type']} of {len(payload)} payload bytes, declared as {length}")
    kind, _, digest = head["warc-payload-digest"].partition(":")
    if kind != "sha1" or not revisit and digest != digest_of(payload):
        raise BadArchive("the payload digest does not match")
    url = head.get("warc-target-uri")
    return {
        "page_id": _named(head["warc-record-id"]), "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "payload": None if revisit else payload,
        "payload_bytes": length, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": _named(head["warc-refers-to"]) if revisit else None,
    }


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\n")


def frames(records) -> list:
    """The dictionary's frame, then each record's. The dictionary comes from the first SAMPLE_BYTES of records."""
    records, held, size = iter(records), [], 0
    for raw in records:
        held.append(raw)
        size += len(raw)
        if size >= SAMPLE_BYTES:
            break
    if not held:
        return
    words = dictionary([x[:16384] for x in held])
    yield struct.pack("<II", DICTIONARY, len(words)) + words
    pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    for raw in held:
        yield pack.compress(raw)
    for raw in records:
        yield pack.compress(raw)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame at `at` ends, by its header and block sizes."""
    head = data[at : at + 18]
    size = zstandard.frame_header_size(head)
    at, checksum = at + size, zstandard.get_frame_parameters(head).has_checksum
    while True:
        if at + 3 > len(data):
            raise BadArchive("a torn frame")
        block = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def read(data) -> list:
    """The records of an archive."""
    data, at, unpack = memoryview(data).cast("B"), 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise BadArchive("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data) or unpack is None and magic != DICTIONARY:
                raise BadArchive("no dictionary frame at the start")
            if magic == DICTIONARY:
                words = bytes(data[at + 8 : at + 8 + size])
                if words[:4] == struct.pack("<I", FRAME):
                    words = zstandard.ZstdDecompressor().decompress(words)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            at += 8 + size
        elif magic == FRAME and unpack:
            end = _frame_end(data, at)
            if end > len(data):
                raise BadArchive("a torn frame")
            try:
                raw = unpack.decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise BadArchive(f"a frame that does not decode: {e}") from e
            yield parsed(raw)
            at = end
        else:
            raise BadArchive("neither a frame nor a dictionary")


def _line(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["frame"])


def _writer(row_bytes: int):
    def write(batches):
        def records():
            for batch in batches:
                for page_id, url, payload, last, revisit in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    yield record(page_id, url, payload, last, revisit)

        found = frames(records())
        head = next(found, b"")
        held, size = [head], len(head)
        for frame in found:
            held.append(frame)
            size += len(frame)
            if size - len(head) >= row_bytes:
                yield _line(held)
                held, size = [head], len(head)
        if len(held) > 1:
            yield _line(held)

    return write


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", row_bytes: int = ROW_BYTES) -> None:
    """Write a record for each row of pages to archives in the folder path, of about ARCHIVE_LINES x row_bytes each.

    The payload is html in UTF-8 (null: empty). Of rows with equal payloads those with the largest id become responses, the
    others revisits of it; a null id is never the largest. Only (digest, id) pairs are gathered, summed up before the
    shuffle, so a page that makes up much of the input costs one row a task."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1").select("digest", "last")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    joined = rows.join(groups, "digest", "left").select("page_id", "url", "payload", "last", revisit.alias("revisit"))
    out = joined.mapInArrow(_writer(row_bytes), "frame binary").select(F.col("frame").cast("string").alias("value"))
    out.write.options(lineSep=SEPARATOR.decode("latin-1"), maxRecordsPerFile=ARCHIVE_LINES).text(path)


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            rows, size = [], 0
            for found in read(batch.column(0)[i].as_buffer()):
                rows.append(found)
                size += len(found["payload"] or b"") + 200
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _RECORD)


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in the folder path: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to. A broken record fails the job with BadArchive."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(_read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, owner: str = "warc") -> DataFrame:
    """Archives written to the shared folder and read back: a row for every row of pages.

    Null html is an empty payload. Rows with equal payloads are told apart by their ids; a row that is there twice is two records,
    both responses if its id is the largest. A null id is read back as null. An empty table gives an empty result."""
    path = f"{shared_dir(pages.sparkSession)}/ampliscope/{owner}-{uuid.uuid4().hex}"
    write_archives(pages, path)
    adopt(owner, path)
    return read_archives(pages.sparkSession, path)
