"""Zstandard web archives: written by Spark's own writer, read record by record.

An archive file starts with a skippable frame that holds the compression dictionary; every record is one frame of its own.
Spark's text writer puts rows of raw bytes one after another, with an empty skippable frame as line separator, so files
are streamed record by record to any store that Spark reaches, and committed task by task; a lost executor only repeats
its tasks. The reader takes the dictionary from the leading frame, decodes one frame at a time within a size limit, and
checks header lines, the declared lengths and the payload digest; damaged records raise an error.

Cases: null payloads are written as empty ones; equal payloads refer to the smallest id; rows that repeat an id are all
written and all come back, each by its own payload: one with the smallest id of its payload is a response, any other a
revisit; payloads below `min_revisit` bytes are always responses;
null ids are written as responses without a reference, however often; urls that are null or hold line ends are escaped; an empty table gives
an empty archive and result; other columns are left alone.
"""
from __future__ import annotations

import base64
import hashlib
import re
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routekit.llm.common import query, table
from routekit.operators.core import checkpoint, scratch_path

# Frame magics of the Zstandard format, and the one that web archives give to the dictionary.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0).decode("latin-1")  # eight bytes under 128: a valid line separator
SAMPLE_PAGES, SAMPLE_BYTES, LEAST_SAMPLE, DICTIONARY_BYTES, LEVEL = 256, 16 << 10, 64, 32 << 10, 3
READ_STEP, READ_BATCH, READ_ROWS = 1 << 20, 4 << 20, 1024
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the starts of SAMPLE_PAGES payloads with the smallest ids: it changes sizes, never contents."""
    ids = [r["id"] for r in pages.where("id IS NOT NULL").select("id").orderBy("id").limit(SAMPLE_PAGES).collect()]
    rows = pages.where(F.col("id").isin(ids)).select("id", F.substring("payload", 1, SAMPLE_BYTES).alias("p")).limit(2 * SAMPLE_PAGES).collect() if ids else []
    samples = sorted(bytes(r["p"]) for r in rows if r["p"] and len(r["p"]) >= LEAST_SAMPLE)
    if len(samples) < 8 or sum(map(len, samples)) < DICTIONARY_BYTES:  # no gain, and the trainer ends the process on tiny samples
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform a sample
        return b""


def record_bytes(kind: str, record_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, whose Content-Length tells the full payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_references(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """`pages` (id, url, payload) with refers_to: the smallest id with an equal payload, null where the row is that one."""
    marks = checkpoint(pages.select("id", F.sha2("payload", 256).alias("sum"), F.octet_length("payload").alias("n")))
    firsts = marks.where((F.col("n") >= min_revisit) & F.col("id").isNotNull()).groupBy("sum", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = marks.join(firsts, ["sum", "n"]).where("id > first").select("id", "sum", "n", F.col("first").alias("refers_to")).distinct()
    named = pages.select("id", "url", "payload", F.sha2("payload", 256).alias("sum"), F.octet_length("payload").alias("n"))  # an id may repeat with another payload
    return named.join(later, ["id", "sum", "n"], "left").drop("sum", "n")


def write_archives(pages: DataFrame, path: str, min_revisit: int = 0) -> None:
    """Write `pages` (id, url, payload) as .zst archives, one for each partition that Spark deals out."""
    data = pages.select("id", "url", F.coalesce(F.col("payload"), F.lit("")).cast("binary").alias("payload"))
    words = data.sparkSession.sparkContext.broadcast(train_dictionary(data))

    def run(batches):
        shared = zstandard.ZstdCompressionDict(words.value) if words.value else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=True)
        yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICTIONARY, len(words.value)) + words.value], pa.binary())], ["frame"])
        for batch in batches:
            for at in range(batch.num_rows):
                record_id, url, payload, refers_to = (batch.column(k)[at].as_py() for k in range(4))
                kind = "response" if refers_to is None else "revisit"
                frame = press.compress(record_bytes(kind, record_id, url, payload, payload_digest(payload), refers_to))
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])

    linked = with_references(data, min_revisit).select("id", "url", "payload", "refers_to")
    frames = linked.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME).text(path)


class DamagedArchive(ValueError):
    pass


def frames_of(data: memoryview):
    """(dictionary, frame start, frame end) walk: yields the byte ranges of record frames after the leading dictionary."""
    at, shared, first = 0, b"", True
    while at < len(data):
        if len(data) - at < 8:
            raise DamagedArchive(f"{len(data) - at} bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 + size > len(data):
                raise DamagedArchive("a skippable frame is cut off")
            if first and magic == DICTIONARY:
                shared = bytes(data[at + 8:at + 8 + size])
                if size >= 4 and struct.unpack_from("<I", shared)[0] == FRAME:  # the dictionary itself may be compressed
                    shared = zstandard.ZstdDecompressor().decompress(shared)
            at, first = at + 8 + size, False
            continue
        if magic != FRAME:
            raise DamagedArchive(f"no frame at byte {at}")
        end = yield shared, at
        at, first = end, False


def read_frame(press: zstandard.ZstdDecompressor, data: memoryview, at: int) -> tuple[bytes, int]:
    """(content, end) of the one frame that starts at `at`."""
    one, out = press.decompressobj(), []
    while not one.eof:
        if at >= len(data):
            raise DamagedArchive("the last frame is cut off")
        part = data[at:at + READ_STEP]
        out.append(one.decompress(part))
        at += len(part) - len(one.unused_data)
    return b"".join(out), at


def parse_head(data: bytes, what: str) -> tuple[str, dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise DamagedArchive(f"{what} without an end of its head")
    first, *lines = data[:end].decode().split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z0-9-]+", name):
            raise DamagedArchive(f"{what} with the line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    return first, fields, end + 4


def parse_record(data: bytes) -> dict:
    """The checked contents of one record."""
    version, fields, start = parse_head(data, "record")
    if not version.startswith("WARC/1."):
        raise DamagedArchive(f"unknown version {version[:20]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise DamagedArchive(f"record without {name}")
    size = int(fields["content-length"])
    if len(data) != start + size + 4 or data[-4:] != b"\r\n\r\n":
        raise DamagedArchive(f"record of {len(data) - start - 4} bytes declares {size}")
    status, http, body = parse_head(data[start:start + size], "HTTP message")
    payload, whole = data[start + body:start + size], int(http["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != whole or payload_digest(payload) != digest):
        raise DamagedArchive("payload and its declared length or digest differ")
    if kind == "revisit" and ("warc-refers-to" not in fields or payload):
        raise DamagedArchive("revisit without reference, or with a payload")
    urn = lambda name: re.fullmatch(r"<urn:page:(.*)>", fields[name])[1] if name in fields else None
    return {"id": urn("warc-record-id") or None, "url": fields.get("warc-target-uri", ""), "record_type": kind, "refers_to": urn("warc-refers-to"), "payload_bytes": whole, "payload_digest": digest,
            "payload": payload if kind == "response" else None}


SCHEMA = "id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
FIELDS = [pa.field("id", pa.string()), pa.field("url", pa.string()), pa.field("record_type", pa.string()), pa.field("refers_to", pa.string()), pa.field("payload_bytes", pa.int64()),
          pa.field("payload_digest", pa.string()), pa.field("payload", pa.binary())]


def read_records(content: bytes):
    data = memoryview(content)
    walk = frames_of(data)
    press = None
    try:
        shared, at = next(walk)
        while True:
            if press is None:
                press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
            record, end = read_frame(press, data, at)
            yield parse_record(record)
            shared, at = walk.send(end)
    except StopIteration:
        return


def read_archives(spark, path: str) -> DataFrame:
    """Every record of the archives in `path`: id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    def packed(records):
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in records], f.type) for f in FIELDS], schema=pa.schema(FIELDS))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in read_records(content.as_py()):
                    held.append(record)
                    size += len(record["payload"] or b"")
                    if size >= READ_BATCH or len(held) >= READ_ROWS:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


@query("op10_warc")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    found = read_archives(spark, path)
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
