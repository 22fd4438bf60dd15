"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes (seed 42) of a document's word
shingles, repeats included. Distinct fingerprints post themselves under keys made of nearby codewords of
their segments (``golay.keys``); any two within four bits share a key. Rows of a key are verified against one
another, and of the links found there a spanning forest is kept, never all pairs. Components over all
links name the documents.

Defined results: null, empty and blank texts have the fingerprint zero, which links like any other; a text of
fewer words than a shingle is one shingle; repeated rows are each returned; an id with several texts joins
their components; rows with a null id link fingerprints like others and get the smallest known id of
their component (null if there is none); other columns are not read; an empty table gives no rows. Texts are
hashed in pieces of 4 MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import golay
from seqloom.llm.buckets import in_runs, whole_runs
from seqloom.llm.common import id_and_text
from seqloom.llm.components import components
from seqloom.operators.lookup import lookup
from seqloom.session import materialize

DISTANCE = 4  # what the keys are made for
SHINGLE_WORDS = 4
SEED = 42
THIRD_FROM = 1 << 26  # distinct fingerprints from which keys name the third segment too; the links are the same
SHORT_RUN = 6
_BLOCK = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words, in pieces cut at spaces."""
    at = 0
    while at < len(data):
        end = at + _BLOCK
        found = _SPACE.search(data, end) if end < len(data) else None
        end = found.end() if found else len(data)
        yield data[at:end].lower().split()
        at = end


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` space-joined words."""
    text = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(text[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)


def fingerprint(data: bytes, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text in UTF-8, as an unsigned number."""
    ones, n, last = np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces(data):
        words = last + piece
        if len(words) >= size:
            hashes = shingle_hashes(words, size)
            n += len(hashes)
            octets = hashes.view(np.uint8).reshape(-1, 8)
            for i in range(8):
                ones[8 * i : 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS
            words = words[len(words) - size + 1 :] if size > 1 else []
        last = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` of every row, ``fp`` a signed long of the 64 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), size) for t in batch.column(1)]
            column = pa.array(np.array(made, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], schema=schema)

    given = id_and_text(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return given.mapInArrow(run, "doc_id long, fp long")


def _post(third: bool):
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy()
                rows, keys = golay.keys(fps.view(np.uint64), third)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], schema=schema)

    return lambda items: items.select("fp").mapInArrow(run, "key long, fp long")


def _forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within ``DISTANCE`` that connect what is connected in one run: each fingerprint is reached once."""
    left, right = [], []
    waiting = fps
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            x = front.pop()
            hit = np.bitwise_count(waiting ^ x) <= DISTANCE
            if hit.any():
                found = waiting[hit]
                left.append(np.full(len(found), x))
                right.append(found)
                front.extend(found)
                waiting = waiting[~hit]
    return left, right


def links(classes: DataFrame, third_from: int = THIRD_FROM) -> DataFrame:
    """``a, b``: links among the distinct fingerprints ``fp`` that connect all within ``DISTANCE`` bits."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_runs(batches):
            fps = table.column("fp").to_numpy().view(np.uint64)
            sizes = np.bincount(number)[number]
            left, right = [], []
            short = sizes <= SHORT_RUN
            f, r = fps[short], number[short]
            for lag in range(1, SHORT_RUN):
                near = (r[lag:] == r[:-lag]) & (f[lag:] != f[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= DISTANCE)
                left.append(f[:-lag][near])
                right.append(f[lag:][near])
            f, r = fps[~short], number[~short]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for part in np.split(f, cuts) if len(f) else ():
                a, b = _forest(np.unique(part))
                left += a
                right += b
            pair = np.stack([np.concatenate(left), np.concatenate(right)])
            pair = np.unique(np.sort(pair.view(np.int64), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], schema=schema)

    n = classes.count()
    posted, _ = in_runs(classes.select("fp"), _post(n >= third_from), "fp", n)
    return posted.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, third_from: int = THIRD_FROM) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = materialize(fingerprints(docs, size), "fingerprints")
    grouped = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = materialize(grouped, "classes")
    by_id = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    several = materialize(by_id.where("a <> b").select("doc_id", "a"), "ids")
    found = links(classes, third_from)
    if not several.isEmpty():  # ids with several fingerprints join them
        found = found.unionByName(lookup(rows, several, ["doc_id"], how="inner").select("a", F.col("fp").alias("b")))
    label = components(found).select(F.col("node").alias("fp"), "component")
    linked = materialize(lookup(label, classes, ["fp"]), "linked")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = lookup(linked, least, ["component"]).select("fp", "least")
    named = lookup(classes, named, ["fp"]).select("fp", F.coalesce("least", "first").alias("component_id"))
    out = lookup(rows, materialize(named, "named"), ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
