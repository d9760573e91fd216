"""WARC archives with Zstandard dictionaries: written, deduplicated and read back by Spark.

An archive is one file: a skippable frame that holds the dictionary, then one frame a record.
Spark's text writer puts the frames into the files, so they reach any file system it can write
and a lost task leaves nothing behind; its line separator is an empty skippable frame, which
Zstandard readers pass over.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorlake.staging import broadcast_if_small, new_folder, small_batches, staged, until_exit


# Fixed values of the Zstandard and WARC formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A dictionary is built from the first records of its archive: so many bytes and records at least, but not more than MOST_BYTES and a record.
DICTIONARY_SAMPLE_BYTES = 1 << 20
DICTIONARY_SAMPLE_RECORDS = 64
MOST_BYTES = 8 << 20
#: Of a long record, so much helps to build it.
DICTIONARY_PIECE = 32 << 10
DICTIONARY_BYTES = 16 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Equal payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 100


def _line(value: object) -> str:
    """A header value: line breaks and other control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def _record_id(page_id: object, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {n_bytes}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(sample: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or one of the records' own bytes where they are too few or too alike to train one."""
    pieces = [r[:DICTIONARY_PIECE] for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(pieces)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive, the dictionary's first; none without records. Holds MOST_BYTES and one record at most."""
    sample, held = [], 0
    for r in records:
        sample.append(r)
        held += len(r)
        if held >= MOST_BYTES or held >= DICTIONARY_SAMPLE_BYTES and len(sample) >= DICTIONARY_SAMPLE_RECORDS:
            break
    if not sample:
        return
    built = dictionary(sample)
    data = built.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=built)
    for r in sample:
        yield packer.compress(r)
    sample.clear()
    for r in records:
        yield packer.compress(r)


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def records() -> Iterator[bytes]:
        for b in batches:
            for page, url, html, digest, n, ref in b.itertuples(index=False, name=None):
                page, ref = (None if pd.isna(x) else int(x) for x in (page, ref))
                yield record(page, url, (html or "").encode(), digest, n, ref)

    some: list[bytes] = []
    held = 0
    for frame in archive(records()):
        some.append(frame)
        held += len(frame)
        if held > 1 << 22:
            yield pd.DataFrame({"frame": some})
            some, held = [], 0
    if some:
        yield pd.DataFrame({"frame": some})


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes one record a row of ``pages`` (page_id, url, html) into archives at ``path``, one a partition.

    Of rows with equal payloads of at least MIN_REVISIT_BYTES bytes, those with the smallest
    page_id are responses and the others revisit records that refer to it. Payloads are compared
    by SHA-256. A null html is an empty payload; a null page_id sorts last, and among payloads
    without any page_id all are responses; rows that repeat the smallest page_id are responses,
    each. Only page_id, url and html are read.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    shared = rows.filter(F.col("n") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    firsts = staged(shared.filter("rows > 1 and first is not null").select("digest", "first"), "warc-firsts")
    joined = rows.join(broadcast_if_small(firsts), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    listed = joined.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "n", refers.alias("refers_to"))
    frames = listed.mapInPandas(_frames, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    start, trained = 0, None
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICTIONARY_MAGIC:
            start, trained = 8 + size, zstandard.ZstdCompressionDict(content[8 : 8 + size])
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(memoryview(content)[start:], read_across_frames=True))
    while line := reader.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts here: {line[:40]!r}")
        head = {}
        while (line := reader.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = reader.read(int(head["Content-Length"]))
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")
        yield head, block


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for b in batches:
        for content in b["content"]:
            rows: list[tuple] = []
            held = 0
            for head, block in read_records(content):
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                payload = block.partition(b"\r\n\r\n")[2]
                revisit = head["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError("a payload doesn't have its digest")
                size = int(head["Payload-Length"]) if revisit else len(payload)
                number = lambda x: int(x) if x is not None else None
                rows.append((number(head.get("Page-ID")), head.get("WARC-Target-URI"), None if revisit else payload.decode(), size, digest, head["WARC-Type"], number(head.get("Refers-To-Page-ID"))))
                held += len(payload)
                if held > 1 << 22:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest, record_type, refers_to of each record at ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(_parsed, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, now, and reads them back when the result is read; see :func:`write_archives`.

    An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    until_exit(spark, path)
    return read_archives(spark, path)
