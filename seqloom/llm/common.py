"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import fits, scratch_path

SPACES = " \t\n\x0b\x0c\r"  # fixed values: the characters that end a word
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Written tables of one job, removed together once what was made of them is written too."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that no other column can clash; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN, -1), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def by_ids(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join with a written table of ids, which is broadcast only if it is small when measured."""
    return rows.join(F.broadcast(ids) if fits(ids) else ids, on, how)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of Arrow batches ``(doc_id, text)``, in slices of about ``limit`` bytes of text."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        ends = pc.cumulative_sum(pc.binary_length(texts).cast(pa.int64())).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(ids):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield ids.slice(at, to - at).to_pylist(), texts.slice(at, to - at).to_pylist()
            at = to
    release_memory()


def release_memory() -> None:
    """Give freed memory back: a worker lives on after its task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_MULT = np.uint64(0x9E3779B97F4A7C15)
_P = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _P, dtype=np.uint64)
        down = np.full(size, _INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in SPACES]] = True
_BLOCK = 1 << 22


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text in UTF-8, words being runs without ASCII space.

    The hash is a polynomial over the bytes, taken for all words at once from running sums. Texts
    above 4 MB are hashed in pieces cut at spaces; a longer word is hashed by itself.
    """
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        if end < len(data):
            cut = max(data.rfind(c.encode(), at, end) for c in SPACES)
            while cut < 0 and end < len(data):  # one word longer than the block
                ends = [p for p in (data.find(c.encode(), end) for c in SPACES) if p >= 0]
                cut = min(ends) if ends else len(data)
            end = min(len(data), max(cut, at) + 1) if cut >= 0 else len(data)
        out.append(_block_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _block_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    solid[1:-1] = ~_SPACE[raw]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)
