"""WARC archives in Zstandard: written by tasks, read back with Spark's binary file source.

An archive begins with a skippable frame that holds the compression dictionary, followed by one frame
per record. Of records with equal payloads the one with the smallest id is a ``response``; the others are
``revisit`` records that name it and hold no payload, only its HTTP headers. The reader checks the frames,
version line, required headers, lengths and digests, and fails with the archive's name.

Defined results: null html is an empty payload; a null url leaves the header out; a null id is written as
``none`` and read back as null; of rows with equal id and payload all are responses if their id is the
smallest; line ends in a url are percent-encoded; an empty table gives no archive and no rows; very long
payloads are one record; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.lookup import lookup
from seqloom.session import materialize, scratch_path

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

ARCHIVE_BYTES = 24 << 20  # payload after which a task begins a new archive
SAMPLE_BYTES = 1 << 20  # payload from which an archive's dictionary is trained
DICTIONARY_BYTES = 16 << 10
DATE = "2024-01-01T00:00:00Z"  # the tables hold no capture time


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A ``response`` record, or a ``revisit`` of the page ``refers_to``."""
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response")]
    headers.append(("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"))
    headers.append(("WARC-Date", DATE))
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return _record(headers, http.encode() + (b"" if revisit else payload))


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    samples, size = [], 0
    for record in records:
        samples.append(record[: 64 << 10])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small samples
        return None


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The bytes of one archive, frame by frame."""
    trained = _dictionary(records)
    if trained is not None:
        content = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
        yield struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content
    compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    for record in records:
        yield compressor.compress(record)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the written manifest of archives.

    Every attempt of a task writes files of its own; the manifest, committed by Spark, names those that count.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = own.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html")})
    same = (
        keyed.where(F.col("size") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    joined = lookup(keyed, materialize(same, "payloads"), ["digest"])
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("page_id").isNull()), F.col("first"))
    rows = joined.select("page_id", "url", "html", F.when(F.col("size") >= min_bytes, refers).alias("refers_to"))
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
        store.create_dir(root)
        task = TaskContext.get()
        made: list[tuple[str, int]] = []
        waiting: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if waiting:
                name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.zst"
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for frame in archive(waiting):
                        out.write(frame)
                made.append((name, len(waiting)))
                waiting.clear()
                size = 0

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page_id, url, html, first = (c[i].as_py() for c in columns)
                waiting.append(page_record(page_id, url, html.encode("utf-8"), first))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    flush()
        flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    return materialize(rows.mapInArrow(write, "archive string, records long"), "manifest")


def _frames(data: memoryview, name: str) -> Iterator[bytes]:
    """The content of each frame of an archive."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        (length,) = struct.unpack_from("<I", data, 4)
        content = bytes(data[8 : 8 + length])
        if len(content) != length:
            raise ValueError(f"{name}: the dictionary frame is cut off")
        if content[:4] == FRAME_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        trained, at = zstandard.ZstdCompressionDict(content), 8 + length
    decompressor = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(data):
        if bytes(data[at : at + 4]) != FRAME_MAGIC:
            raise ValueError(f"{name}: no frame at byte {at}")
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            step = data[at : at + (64 << 10)]
            if not len(step):
                raise ValueError(f"{name}: the last frame is cut off")
            out.append(frame.decompress(step))
            at += len(step) - len(frame.unused_data)
        yield b"".join(out)


def parse_record(raw: bytes, name: str = "record") -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ``ValueError`` where it breaks the format."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        raise ValueError(f"{name}: no WARC version line")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"{name}: a header without colon")
        headers[key.decode()] = value.strip().decode()
    if missing := [k for k in REQUIRED if k not in headers]:
        raise ValueError(f"{name}: missing {', '.join(missing)}")
    length = headers["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{name}: the block is not of the stated length")
    return headers, rest[:-4]


def _page_of(urn: str | None) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "none"
    return None if value == "none" else int(value)


def _row(raw: bytes, name: str) -> tuple:
    headers, block = parse_record(raw, name)
    http, found, payload = block.partition(b"\r\n\r\n")
    sizes = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not found or len(sizes) != 1:
        raise ValueError(f"{name}: no HTTP headers with a length")
    size, kind = int(sizes[0]), headers["WARC-Type"]
    stated = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"{name}: the payload does not match its length or digest")
    if kind == "revisit" and payload:
        raise ValueError(f"{name}: a revisit holds a payload")
    page, refers = _page_of(headers["WARC-Record-ID"]), _page_of(headers.get("WARC-Refers-To"))
    return page, headers.get("WARC-Target-URI"), kind, size, stated, refers, payload


_FIELDS = [
    ("page_id", pa.int64(), "long"),
    ("url", pa.string(), "string"),
    ("record_type", pa.string(), "string"),
    ("payload_bytes", pa.int64(), "long"),
    ("payload_digest", pa.string(), "string"),
    ("refers_to", pa.int64(), "long"),
    ("payload", pa.binary(), "binary"),
]


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payload: bool = True) -> DataFrame:
    """A row per record of the archives in ``folder``; with a manifest, of those it names."""
    fields = _FIELDS if payload else _FIELDS[:-1]
    schema = pa.schema([f[:2] for f in fields])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if manifest is not None:
        named = named.join(manifest, "archive", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())
                rows, size = [], 0
                for raw in _frames(data, name):
                    rows.append(_row(raw, name)[: len(fields)])
                    size += len(raw)
                    if size > 8 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return named.mapInArrow(read, ", ".join(f"{f[0]} {f[2]}" for f in fields))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, without the payloads."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_archives(pages, folder, min_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], ", ".join(f"{f[0]} {f[2]}" for f in _FIELDS[:-1]))
    return read_archives(spark, folder, manifest, payload=False)
