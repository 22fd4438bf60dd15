"""Language model scores by deleted interpolation.

The probability of a word after another is a mixture of the bigram's and the word's relative frequency and
of a uniform share. The mixture depends on a bucket of how often the context was seen. Its weights are
learned by expectation-maximisation on the counts of a part of the training texts that is left out of the
frequencies meanwhile (crc32 mod 7 = 3); the scores then use the counts of all training texts.

Texts are read once into chunks of some megabytes. A chunk asks for the counts of its distinct words and
bigrams, as 64-bit hashes in arrays; the requests go to shards by the leading bits of the hash, which
spreads any corpus evenly, and a frequent pair is one request per chunk. A shard adds up the counts that
the requests bring along from training texts, and answers each chunk in the order of its requests.

Defined results: a null or empty text has one token, the end; a null id counts as the empty text in the
folds and stays null; repeated rows are counted and scored as often as they occur; unknown words get the
uniform share; without training texts every score is 0; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import fold, id_and_text, mix64, word_hashes
from seqloom.session import materialize, scratch_path

PARTS, HELD_OUT, DELETED = 7, 2, 3
CHUNK_BYTES = 12 << 20
SHARD_KEYS = 1 << 20
GRID = 4  # steps of the held-out histogram per power of two
ROUNDS = 200

_END, _START = np.uint64(2), np.uint64(4)  # words hash to other values but for chance
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)

_CHUNK = pa.schema(
    [
        ("chunk", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("parts", pa.list_(pa.int32())),
        ("sizes", pa.list_(pa.int64())),
        ("texts", pa.binary()),
        ("tokens", pa.int64()),
    ]
)
_CHUNK_DDL = "chunk long, ids array<long>, parts array<int>, sizes array<long>, texts binary, tokens long"
_REQUEST = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.list_(pa.int64())), ("total", pa.list_(pa.int64())), ("main", pa.list_(pa.int64()))]
)
_REPLY = pa.schema(
    [("chunk", pa.int64()), ("shard", pa.int32()), ("total", pa.list_(pa.int64())), ("main", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))]
)
_SCORE = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunk rows with compressed lower-cased texts; texts of the deleted part form (odd) chunks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        waiting: dict[bool, list[tuple]] = {False: [], True: []}
        size = {False: 0, True: 0}
        made = 0
        pack = zstandard.ZstdCompressor(level=3)

        def flush(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            ids, parts, texts = zip(*waiting[deleted])
            tokens = sum(len(t.split()) + 1 for t in texts)
            row = (first + 2 * made + deleted, ids, parts, [len(t) for t in texts], pack.compress(b"".join(texts)), tokens)
            made += 1
            waiting[deleted].clear()
            size[deleted] = 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNK)], schema=_CHUNK)

        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py().encode("utf-8").lower()
                deleted = parts[i] == DELETED
                waiting[deleted].append((ids[i], parts[i], text))
                size[deleted] += len(text)
                if size[deleted] >= CHUNK_BYTES:
                    yield flush(deleted)
        for deleted in waiting:
            if waiting[deleted]:
                yield flush(deleted)

    return id_and_text(docs).withColumn("part", fold("doc_id", PARTS).cast("int")).mapInArrow(run, _CHUNK_DDL)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(values, return_inverse=True)
    return found, at.astype(np.int32)


class _Tokens:
    """The tokens of a chunk: keys of words (even) and bigrams (odd), and where each token's keys stand."""

    def __init__(self, texts: bytes, sizes: list[int], parts: list[int]) -> None:
        raw = zstandard.ZstdDecompressor().decompress(texts) if sum(sizes) else b""
        word, at = [], 0
        for size in sizes:
            word += [word_hashes(raw[at : at + size]) & ~_ONE, np.array([_END])]
            at += size
        lengths = np.array([len(h) + 1 for h in word[::2]])
        now = np.concatenate(word)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.lengths = lengths
        self.first = np.zeros(len(now), dtype=bool)
        self.first[self.starts] = True
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[self.starts] = _START
        pair = mix64(before * _A + now * _B) | _ONE
        del before, word
        words, at_word = _distinct(now)
        del now
        pairs, at_pair = _distinct(pair)
        del pair
        keys = np.concatenate([words, pairs])
        order = np.argsort(keys)
        rank = np.empty(len(keys), dtype=np.int32)
        rank[order] = np.arange(len(keys), dtype=np.int32)
        self.keys = keys[order]
        self.word, self.pair = rank[at_word], rank[len(words) + at_pair]
        self.part = np.repeat(np.array(parts), lengths)

    def counts(self, keep: np.ndarray) -> np.ndarray:
        n = len(self.keys)
        return np.bincount(self.word[keep], minlength=n) + np.bincount(self.pair[keep], minlength=n)


def _tokens(row: dict) -> _Tokens:
    return _Tokens(row["texts"], row["sizes"], row["parts"])


def _requests(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _tokens(row)
                train = t.part != HELD_OUT
                total, main = t.counts(train), t.counts(train & (t.part != DELETED))
                shards = t.keys >> np.uint64(64 - bits)
                starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))  # of the shards that are asked
                for a, b in zip(starts, np.append(starts[1:], len(shards))):
                    values = (int(shards[a]), row["chunk"], t.keys[a:b].view(np.int64), total[a:b], main[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _REQUEST)], schema=_REQUEST)

    ddl = "shard int, chunk long, keys array<long>, total array<long>, main array<long>"
    return chunks.mapInArrow(run, ddl)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy()


def _answer(rows: pa.Table) -> pa.Table:
    """Counts of one shard, back to each chunk in the order it asked; one reply tells the shard's words."""
    keys = _flat(rows["keys"])
    distinct, place = np.unique(keys, return_inverse=True)
    sums = []
    for name in ("total", "main"):
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, place, _flat(rows[name]))
        sums.append(total)
    words = distinct & 1 == 0
    known = [int((s[words] > 0).sum()) for s in sums] + [int(s[words].sum()) for s in sums]
    ends = np.cumsum([len(k) for k in rows["keys"]])
    out: list[list] = [rows["chunk"].to_pylist(), rows["shard"].to_pylist(), [], [], []]
    for i, end in enumerate(ends):
        at = place[(ends[i - 1] if i else 0) : end]
        out[2].append(sums[0][at])
        out[3].append(sums[1][at])
        out[4].append(known if i == 0 else None)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _REPLY)], schema=_REPLY)


def _aligned(replies: pa.Table, name: str) -> np.ndarray:
    """The answers of all shards in the order of a chunk's keys."""
    return _flat(replies.sort_by("shard")[name])


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one for each power of two."""
    return np.where(count > 0, np.frexp(count.astype(float))[1], 0)


class Frequencies:
    """Relative frequencies of a chunk's tokens under one set of counts."""

    def __init__(self, t: _Tokens, counts: np.ndarray, n_tokens: int, n_docs: int) -> None:
        self.count = counts[t.word]
        context = np.empty_like(self.count)
        context[1:] = self.count[:-1]
        context[t.starts] = n_docs
        self.bucket = bucket(context)
        self.bigram = counts[t.pair] / np.maximum(context, 1)
        self.word = self.count / max(n_tokens, 1)


def _histogram(chunks: DataFrame, replies: DataFrame, facts: dict[str, int]) -> list[tuple[int, int, int, int]]:
    """How often each bucket, bigram frequency and word frequency occur in the deleted part, the frequencies
    on a logarithmic grid relative to the uniform share; -1 stands for a frequency of zero."""
    schema = pa.schema([("bucket", pa.int32()), ("bigram", pa.int32()), ("word", pa.int32()), ("n", pa.int64())])
    uniform = 1 / (facts["main_words"] + 1)

    def grid(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            steps = np.log2(p / uniform) * GRID
        return np.where(p > 0, np.rint(np.where(p > 0, steps, 0)).clip(-400, 400), -1000).astype(np.int64)

    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        if not held.num_rows:
            return schema.empty_table()
        t = _tokens(held.to_pylist()[0])
        f = Frequencies(t, _aligned(answers, "main"), facts["main_tokens"], facts["main_docs"])
        cells = np.stack([f.bucket, grid(f.bigram), grid(f.word)], axis=1)
        cell, n = np.unique(cells, axis=0, return_counts=True)
        columns = [pa.array(cell[:, i], schema[i].type) for i in range(3)]
        return pa.Table.from_arrays([*columns, pa.array(n)], schema=schema)

    held = chunks.where("chunk % 2 = 1").groupBy("chunk").cogroup(replies.where("chunk % 2 = 1").groupBy("chunk"))
    cells = held.applyInArrow(run, "bucket int, bigram int, word int, n long")
    summed = cells.groupBy("bucket", "bigram", "word").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in summed.collect()]  # the grid bounds it: buckets x steps x steps


def mixture(histogram: list[tuple[int, int, int, int]]) -> dict[int, np.ndarray]:
    """Weights of bigram, word and uniform share for each bucket, by expectation-maximisation.

    Each weight starts from and keeps one pseudo count, so that none vanishes.
    """
    cells: dict[int, list] = {}
    for b, *cell in histogram:
        cells.setdefault(b, []).append(cell)
    out = {}
    for b, rows in cells.items():
        steps = np.array([r[:2] for r in sorted(rows)], dtype=float)
        n = np.array([r[2] for r in sorted(rows)], dtype=float)
        ratio = np.where(steps > -1000, 2.0 ** (steps / GRID), 0.0)
        p = np.hstack([ratio, np.ones((len(n), 1))])
        if b == 0:
            p[:, 0] = 0  # an unseen context has no bigram frequency
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            joint = p * w
            share = (joint / joint.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) + [b > 0, 1, 1]
            new = share / share.sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        out[b] = w
    return out


def weights_table(learned: dict[int, np.ndarray], size: int = 80) -> np.ndarray:
    """A row of weights per bucket; a bucket without held-out tokens takes those of the nearest learned one."""
    table = np.zeros((size, 3))
    seen = sorted(b for b in learned if b > 0)
    for b in range(1, size):
        table[b] = learned[min(seen, key=lambda x: (abs(x - b), x))] if seen else (0.4, 0.4, 0.2)
    unseen = learned.get(0, np.array([0.0, *(table[1][1:] / table[1][1:].sum())]))
    table[0] = 0.0, unseen[1] / (unseen[1] + unseen[2]), unseen[2] / (unseen[1] + unseen[2])
    return table


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    chunks = materialize(_chunks(docs), "chunks")
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(5, int(tokens // SHARD_KEYS).bit_length())
    counted = _requests(chunks, bits).groupBy("shard").applyInArrow(
        _answer, "chunk long, shard int, total array<long>, main array<long>, words array<long>"
    )
    path = scratch_path(spark, "replies")
    counted.write.option("compression", "zstd").parquet(path)
    replies = spark.read.schema(counted.schema).parquet(path)
    names = ["words", "main_words", "tokens", "main_tokens"]
    said = replies.where("words is not null").agg(*[F.coalesce(F.sum(F.get("words", i)), F.lit(0)).alias(n) for i, n in enumerate(names)])
    facts = {k: int(v) for k, v in said.first().asDict().items()}
    parts = chunks.select(F.explode("parts").alias("part")).groupBy("part").count().collect()  # seven rows at most
    n_docs = {r["part"]: r["count"] for r in parts}
    facts["docs"] = sum(n for p, n in n_docs.items() if p != HELD_OUT)
    facts["main_docs"] = facts["docs"] - n_docs.get(DELETED, 0)
    table = weights_table(mixture(_histogram(chunks, replies, facts)))

    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        if not held.num_rows:
            return _SCORE.empty_table()
        row = held.to_pylist()[0]
        t = _tokens(row)
        f = Frequencies(t, _aligned(answers, "total"), facts["tokens"], facts["docs"])
        w = table[f.bucket]
        p = w[:, 0] * f.bigram + w[:, 1] * f.word + w[:, 2] / (facts["words"] + 1)
        if not facts["tokens"]:
            p[:] = 1.0
        base = np.log10((f.count + 1) / (facts["tokens"] + facts["words"] + 1))
        sums = [np.add.reduceat(x, t.starts) for x in ((f.count > 0).astype(np.int64), base, np.log10(p))]
        held_out = [part == HELD_OUT for part in row["parts"]]
        columns = [row["ids"], held_out, t.lengths, *sums]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORE)], schema=_SCORE)

    scored = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    columns = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(facts["tokens"]).cast("long").alias("train_tokens")]
    return scored.select(*columns, "base_score", "score")
