"""Groups of spelling variants by blocked Gram matrices of letter counts.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code point makes
them equal. Then their letter counts differ in at most two letters, by one each: their squared distance is at
most two. Letters fall into five groups, so at least three groups are equal, and a word is posted under the
counts of every three groups. Postings lie in blocks of two adjacent lengths. In a block, squared distances
come from the product of the count matrix with its transpose, pairs at most two apart are kept and
verified by their edit. A pair that meets under several keys counts at the first.

The form of a word is its most frequent near word, if that is frequent enough; forms are followed to the
last by doubling.

Defined results: null and empty texts have no words; a null id counts as the empty text in the hash; repeated
rows count each; runs and words of any length are whole (very long texts are cut between runs); ties go to
the smallest word in code-point order; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.buckets import in_runs, whole_runs
from seqloom.llm.common import id_and_text, mix64
from seqloom.operators.lookup import lookup
from seqloom.session import materialize

LETTERS = r"A-Za-z\u00C0-\u00FF"
MIN_LENGTH, MIN_COUNT, RATIO, DELETE_EVERY = 6, 5, 5, 199
CLASSES, GROUPS = 60, 5  # letters by code point; equal classes only bring words closer
BLOCK = 256  # rows of one Gram product
_PIECE = 1 << 22
_HELD = 200_000  # words that a task counts before it passes them on

_KEPT = list(combinations(range(GROUPS), 3))
_FACTORS = mix64(np.arange(1, len(_KEPT) * CLASSES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(len(_KEPT), CLASSES)
for _i, _groups in enumerate(_KEPT):
    _FACTORS[_i, ~np.isin(np.arange(CLASSES) % GROUPS, _groups)] = 0


def _runs(text: str, pattern: re.Pattern, gap: re.Pattern) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        found = gap.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        end = found.start() if found else len(text)
        yield pattern.findall(text[at:end])
        at = end


def word_counts(docs: DataFrame, letters: str = LETTERS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """``word, n``: the frequent words, after a code point went from every run whose hash says so."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, gap = re.compile(f"[{letters}]+"), re.compile(f"[^{letters}]")
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lowered = text.as_py().lower().decode("utf-8")  # bytes: only A-Z change
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for runs in _runs(lowered, find, gap):
                    for word, n in Counter(runs).items():
                        if len(word) >= min_length:
                            h = zlib.crc32(word.encode("utf-8"), start)
                            if h % delete_every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < min_length:
                                    continue
                            counts[word] += n
                    if len(counts) > _HELD:
                        yield flush()
        if counts:
            yield flush()

    given = id_and_text(docs).select("doc_id", F.col("text").cast("binary"))
    found = given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= min_count)


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts, a row for each word, and lengths."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % CLASSES
    cells = np.repeat(np.arange(len(words)), lengths) * CLASSES + points
    return np.bincount(cells, minlength=len(words) * CLASSES).reshape(-1, CLASSES), lengths


def _post(words: DataFrame) -> DataFrame:
    """``key, word, n, high``: each word in the block of its length, and as the longer one in the block below."""
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("high", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                counts, lengths = letter_counts(part.column(0).to_pylist())
                held = np.stack([(counts.astype(np.uint64) * f).sum(1) for f in _FACTORS], axis=1)
                keys = []
                for high in (False, True):
                    block = (lengths - high).astype(np.uint64)[:, None] * np.uint64(len(_KEPT)) + np.arange(len(_KEPT), dtype=np.uint64)
                    keys.append(mix64(held + mix64(block)).ravel())
                rows = pa.array(np.tile(np.repeat(np.arange(len(lengths)), len(_KEPT)), 2))
                high = np.repeat([False, True], len(lengths) * len(_KEPT))
                columns = [pa.array(np.concatenate(keys).view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array(high)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, high boolean")


def one_edit(a: str, b: str) -> bool:
    """Whether ``a``, not longer than ``b``, becomes ``b`` by one inserted or replaced code point."""
    at = 0
    for x, y in zip(a, b):
        if x != y:
            break
        at += 1
    if len(a) == len(b):
        return at < len(a) and a[at + 1 :] == b[at + 1 :]
    return len(a) + 1 == len(b) and a[at:] == b[at + 1 :]


def _close(counts: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two count matrices whose squared distance is at most two, by their Gram matrix."""
    distance = (counts**2).sum(1)[:, None] + (other**2).sum(1)[None, :] - 2 * (counts @ other.T)
    return np.nonzero(distance <= 2)


def _near_in(table: pa.Table, number: np.ndarray) -> Iterator[tuple[int, int]]:
    """Near words among whole runs, as pairs of row numbers, the first not the longer."""
    words, high = table.column("word").to_pylist(), table.column("high").to_numpy()
    counts, _ = letter_counts(words)
    counts = counts.astype(np.float64)
    first = np.searchsorted(number, number)  # the first row of each row's run
    last = np.searchsorted(number, number, side="right")
    at = 0
    while at < len(words):
        # whole runs up to a block, or a block of the rows of one long run
        to = min(at + BLOCK, len(words))
        if to < len(words) and first[to] > at:
            to = first[to]
        for other in range(at, last[to - 1], BLOCK):
            until = min(other + BLOCK, last[to - 1])
            i, j = _close(counts[at:to], counts[other:until])
            i, j = i + at, j + other
            good = (i < j) & (number[i] == number[j]) & ~(high[i] & high[j])
            for a, b in zip(i[good].tolist(), j[good].tolist()):
                a, b = (b, a) if high[a] else (a, b)
                if one_edit(words[a], words[b]):
                    yield a, b
        at = to


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, other_n``: every two near words, once in each direction."""
    schema = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_runs(batches):
            pairs = np.array(list(_near_in(table, number)), dtype=np.int64).reshape(-1, 2)
            if not len(pairs):
                continue
            a, b = (table.take(pa.array(p)) for p in pairs.T)
            # the pair counts only under the first key that both have, and in one tile
            x, y = (letter_counts(t.column("word").to_pylist()) for t in (a, b))
            same = [((x[0].astype(np.uint64) * f).sum(1) == (y[0].astype(np.uint64) * f).sum(1)) for f in _FACTORS]
            kept = np.argmax(np.stack(same), axis=0)
            held = (x[0].astype(np.uint64) * _FACTORS[kept]).sum(1)
            key = mix64(held + mix64(x[1].astype(np.uint64) * np.uint64(len(_KEPT)) + kept.astype(np.uint64)))
            once = pa.array(key.view(np.int64) == a.column("key").to_numpy())
            a, b = a.filter(once), b.filter(once)
            ends = [(a.column("word"), b.column("word"), b.column("n")), (b.column("word"), a.column("word"), a.column("n"))]
            for columns in ends:
                yield from pa.table(list(columns), schema=schema).combine_chunks().to_batches()

    posted, cut = in_runs(words, _post, "word", words.count())
    found = posted.mapInArrow(run, "word string, other string, other_n long")
    return found.distinct() if cut else found


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words that have a form: forms followed to the last, twice as far in each round."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(lookup(state, onward, ["root"]), "roots")
        if moved.where("next is not null").isEmpty():
            return state
        state = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, ratio: int = RATIO, **counting: str | int) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word of the texts."""
    words = materialize(word_counts(docs, **counting), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    near = materialize(near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "near")
    joined = words.join(near, "word", "left")
    frequent = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    stated = joined.select(
        "word",
        F.when(frequent, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    stated = materialize(stated, "forms")
    out = lookup(stated, _roots(stated.where("form is not null")), ["word"])
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
