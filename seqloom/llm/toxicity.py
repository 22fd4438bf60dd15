"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel counts the letter triples that two strings share as subsequences, each weighted by a decay to
the power of the span it takes, so that gaps and inserted characters cost weight but not the match. A
text is scored by the most toxic of its units and by how many of its distinct words lie on that side. A unit is a word without its punctuation, a stretch of 16 letters of a longer word, or a run of single
letters written apart. Kernel values with a few landmark words, whitened
(Nyström), feed a linear machine; as the kernel is a dot product over triples, the fitted machine is one
table of weights per triple, and scoring a unit is a sum over its own triples.

Labels stand on texts, units have none: words that are significantly more frequent in toxic training
texts, near copies counted once, are the toxic units; words of clean texts, the most similar ones first,
are the other class. A text splits its vote among its toxic units, and a unit counts for either class by the
votes it gets, so that one that alone marks a text outweighs those that clean texts hold now and then. A logistic curve over the training texts turns both figures of a text into a score.

Defined results: null and empty texts have no units and get the score of the lowest margin; equal texts
get equal scores and repeated rows stay; texts are read whole; without both labels every score is 0; an
empty table gives no rows; ``labels``, ``lang``, ``source`` and ids are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import fold, id_and_text, mix64, text_slices, word_hashes
from seqloom.session import materialize

SAMPLE_ROWS = 20_000  # bound of the labelled texts that one fit takes
NEGATIVES = 40_000  # bound of the clean words that one fit collects
HARD = 2_000  # clean words most similar to toxic ones, and as many others, that train the machine
LANDMARKS = 64  # of either class: the rank of the approximation, not a bound of the toxic words
BESIDE = 64  # toxic words that the clean ones are held against at a time
WIDTH, STEP = 16, 8  # letters of a unit; longer words are read in overlapping stretches
DECAY = 0.7
FLOOR = -1.0
THRESHOLD = 0.7
CACHE_UNITS = 600_000  # bound of a worker's memory of margins; beyond it, that memory starts anew
LETTERS = 48  # a to z, and 22 classes for all others by code point

_NOT_LETTERS = re.compile(r"[\W_]+")
_APART = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


def tokens_of(text: str) -> set[str]:
    """Raw tokens: words in lower case, and runs of single characters written apart, joined."""
    low = text.lower()
    found = set(low.split())
    found.update(m.replace(" ", "") for m in _APART.findall(low))
    return found


def units_of(token: str) -> list[str]:
    word = _NOT_LETTERS.sub("", token)
    if len(word) <= WIDTH:
        return [word] if len(word) > 2 else []
    return [word[i : i + WIDTH] for i in range(0, len(word) - STEP, STEP)]


@lru_cache(maxsize=64)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(length), 3)), dtype=np.int64)
    return at, at[:, 2] - at[:, 0] + 1


def _codes(units: list[str]) -> np.ndarray:
    """Triple codes with the span in the low bits, a row per unit; the units have one length."""
    raw = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4").reshape(len(units), -1).astype(np.int64)
    letters = np.where((raw >= 97) & (raw <= 122), raw - 97, 26 + raw % (LETTERS - 26))
    at, span = _triples(raw.shape[1])
    code = (letters[:, at[:, 0]] * LETTERS + letters[:, at[:, 1]]) * LETTERS + letters[:, at[:, 2]]
    return code * 32 + span


_WEIGHT = DECAY ** np.arange(32)


def _norms(codes: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each unit with itself."""
    rows, width = codes.shape
    ordered = np.sort(codes, axis=1)
    weight = _WEIGHT[ordered & 31]
    triple = ordered >> 5
    begins = np.ones((rows, width), dtype=bool)
    begins[:, 1:] = triple[:, 1:] != triple[:, :-1]
    starts = np.flatnonzero(begins.ravel())
    squares = np.add.reduceat(weight.ravel(), starts) ** 2
    first = np.searchsorted(starts, np.arange(rows) * width)
    return np.sqrt(np.add.reduceat(squares, first))


def _grouped(units: list[str], limit: int = 600_000) -> Iterator[tuple[list[int], list[str]]]:
    """Units of one length at a time, in blocks of a bounded number of triples."""
    by: dict[int, list[int]] = {}
    for i, unit in enumerate(units):
        by.setdefault(len(unit), []).append(i)
    for length, places in by.items():
        step = max(1, limit // len(_triples(length)[1]))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            yield part, [units[i] for i in part]


def triples_of(units: list[str]) -> np.ndarray:
    """The distinct triples of some units, ascending."""
    return np.unique(np.concatenate([np.unique(_codes(some) >> 5) for _, some in _grouped(units)]))


def embed(units: list[str], triples: np.ndarray) -> np.ndarray:
    """Normalised weights of the given triples in each unit, a dense row; for small sets only."""
    out = np.zeros((len(units), len(triples)), dtype=np.float32)
    for places, some in _grouped(units):
        codes = _codes(some)
        scaled = _WEIGHT[codes & 31] / _norms(codes)[:, None]
        at = np.searchsorted(triples, codes >> 5).clip(max=len(triples) - 1)
        known = triples[at] == codes >> 5
        rows = np.repeat(np.array(places), codes.shape[1]).reshape(codes.shape)
        np.add.at(out, (rows[known], at[known]), scaled[known])
    return out


def kernel(units: list[str], basis: list[str], step: int = 500) -> np.ndarray:
    """Normalised kernel of each unit with each of a few others."""
    triples = triples_of(basis)
    right = embed(basis, triples).T
    return np.concatenate([embed(units[i : i + step], triples) @ right for i in range(0, len(units), step)])


@dataclass
class Model:
    """Weight of each triple, bias, and the logistic curve over a text's features."""

    table: np.ndarray
    bias: float
    curve: np.ndarray | None = None
    constant: float | None = None

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.empty(len(units))
        for places, some in _grouped(units):
            codes = _codes(some)
            raw = (self.table[codes >> 5] * _WEIGHT[codes & 31]).sum(axis=1)
            out[places] = raw / _norms(codes) + self.bias
        return np.maximum(out, FLOOR)

    def features(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """The largest margin of each text and the logarithm of one plus its tokens of positive margin.

        ``known`` remembers the margins of tokens."""
        split = [tokens_of(t) for t in texts]
        wanted = set().union(*split)
        new = [t for t in wanted if t not in known]
        if len(known) + len(new) > CACHE_UNITS:
            known.clear()
            new = list(wanted)
        cut = [(t, u) for t in new for u in units_of(t)]
        known.update(dict.fromkeys(new, FLOOR))
        if cut:
            distinct = list(dict.fromkeys(u for _, u in cut))
            margin = dict(zip(distinct, self.margins(distinct).tolist()))
            for token, unit in cut:
                if margin[unit] > known[token]:
                    known[token] = margin[unit]
        out = np.empty((len(texts), 2))
        for i, tokens in enumerate(split):
            found = [known[t] for t in tokens]
            out[i] = max(found, default=FLOOR), sum(m > 0 for m in found)
        out[:, 1] = np.log1p(out[:, 1])
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None or self.curve is None:
            return np.full(len(features), self.constant or 0.0)
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -50, 50)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps; the last column is the bias."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] *= 1e-3
    for _ in range(40):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(xa.T @ (xa * wa[:, None]) + ridge, xa.T @ (wa * y[active]))
        if np.allclose(new, w, atol=1e-10):
            break
        w = new
    return w


def spread(names: list[str], count: int) -> list[str]:
    """``count`` of the names, each the one least similar to those before it; the first name begins."""
    if len(names) <= count:
        return names
    chosen, nearest = [0], np.full(len(names), -np.inf)
    while len(chosen) < count:
        nearest = np.maximum(nearest, kernel(names, [names[chosen[-1]]])[:, 0])
        nearest[chosen[-1]] = np.inf
        chosen.append(int(np.argmin(nearest)))
    return [names[i] for i in chosen]


def train_machine(toxic: dict[str, tuple[float, float]], clean: dict[str, int]) -> Model:
    """Fit on units with the votes of the toxic and clean texts that hold them; of the clean units, those
    most similar to toxic ones are all used, the others thinned out."""
    names, others = list(toxic), list(clean)
    nearest = np.max([kernel(others, names[i : i + BESIDE]).max(axis=1) for i in range(0, len(names), BESIDE)], axis=0)
    order = np.argsort(-nearest, kind="stable")
    picked = [others[i] for i in np.concatenate([order[:HARD], order[HARD :: max(1, len(order) // HARD)]])]
    landmarks = spread(names, LANDMARKS) + picked[:: max(1, len(picked) // LANDMARKS)][:LANDMARKS]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    keep = values > 1e-6
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    units = names + picked
    x = np.hstack([kernel(units, landmarks) @ whiten, np.ones((len(units), 1))])
    positive = np.array([toxic[u][0] for u in names], dtype=float)
    negative = np.array([toxic[u][1] for u in names] + [clean[u] for u in picked], dtype=float)
    y = np.concatenate([np.ones(len(names)), -np.ones(len(units))])
    weight = np.concatenate([positive, negative]) / positive.sum()  # a vote is a vote
    w = _machine(np.concatenate([x[: len(names)], x]), y, weight)
    triples = triples_of(landmarks)
    table = np.zeros(LETTERS**3)
    table[triples] = embed(landmarks, triples).T.astype(np.float64) @ (whiten @ w[:-1])
    return Model(table=table, bias=float(w[-1]))


def logistic(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve and its shift, by damped Newton steps with a slight pull to zero.

    More of either feature never lowers a score: one with a negative weight is left out.
    """
    w = _curve(features, labels)
    if (w[:-1] < 0).any():
        keep = w[:-1] > 0 if (w[:-1] > 0).any() else np.arange(len(w) - 1) == 0
        part = _curve(features[:, keep], labels)
        w = np.append(np.zeros(len(w) - 1), part[-1])
        w[:-1][keep] = part[:-1]
    return w


def _curve(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + 1e-2 * w
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _gain(a: np.ndarray, b: np.ndarray, base: float) -> np.ndarray:
    """Log likelihood gain of a word's own toxic share over the base share; negative below the base."""
    n = np.maximum(a + b, 1e-9)
    p = a / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a * np.log(np.where(a > 0, p / base, 1)) + b * np.log(np.where(b > 0, (1 - p) / (1 - base), 1))
    return np.where(p > base, gain, -gain)


def significant(a: np.ndarray, b: np.ndarray, base: float, n_units: int) -> np.ndarray:
    """Places of the words whose toxic share is beyond what chance gives among so many words, the clearest first.

    ``a`` and ``b`` count the toxic and the other texts that hold a word."""
    gain = _gain(a, b, base)
    order = np.argsort(-gain, kind="stable")
    return order[gain[order] >= np.log(max(n_units, 2)) + 2]


def _sketch(text: str) -> list[int]:
    """Four minima of hashes over runs of five words; near copies share most of them."""
    h = word_hashes(text.encode("utf-8", "replace"))
    n = max(1, len(h) - 4)
    runs = np.zeros(n, dtype=np.uint64)
    for i in range(5):
        part = h[i : i + n]
        runs[: len(part)] += part * _ODD[i]
    return [int((mix64(runs ^ _ODD[i]) >> np.uint64(1)).min()) for i in range(4)]


_ODD = mix64(np.arange(11, 16, dtype=np.uint64)) | np.uint64(1)


def apart(sketches: list[tuple[int, ...]]) -> list[int]:
    """Places left when, for each value of the sketch in turn, one of those that share it stays."""
    left = list(range(len(sketches)))
    for k in range(4):
        first: dict[int, int] = {}
        for i in left:
            first.setdefault(sketches[i][k], i)
        left = sorted(first.values())
    return left


def _unit_rows(texts: DataFrame) -> DataFrame:
    """``row`` and each distinct unit of its text."""
    schema = pa.schema([("row", pa.int64()), ("unit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, some in text_slices(batches, 1 << 20):
            out_rows, out_units = [], []
            for row, text in zip(rows, some):
                found = {u for t in tokens_of(text) for u in units_of(t)}
                out_rows += [row] * len(found)
                out_units += found
            yield pa.RecordBatch.from_arrays([pa.array(out_rows, pa.int64()), pa.array(out_units, pa.string())], schema=schema)

    return texts.select("row", "text").mapInArrow(run, "row long, unit string")


def _sketches(texts: DataFrame) -> DataFrame:
    schema = pa.schema([("row", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, some in text_slices(batches):
            made = [pa.array(rows, pa.int64()), pa.array(list(map(_sketch, some)), schema[1].type)]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    return texts.select("row", "text").mapInArrow(run, "row long, sketch array<long>")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled texts outside the held-out fold (crc32 mod 3 = 1).

    An id with contradicting labels counts as toxic; of near copies one text counts.
    """
    nothing = Model(np.zeros(LETTERS**3), 0.0, constant=0.0)
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
        .groupBy(F.col("doc_id").alias("row"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("row"), "row")
        .limit(sample_rows)
    )
    own = id_and_text(docs).withColumnRenamed("doc_id", "row")
    texts = materialize(own.join(F.broadcast(chosen), "row"), "toxic-sample")  # at most sample_rows ids
    labelled = {r["row"]: r["toxic"] for r in texts.select("row", "toxic").collect()}  # bounded by sample_rows
    found = sorted((r["row"], tuple(r["sketch"])) for r in _sketches(texts).collect())
    label = {found[i][0]: labelled[found[i][0]] for i in apart([s for _, s in found])}
    toxic_ids = {r for r, t in label.items() if t}
    if not toxic_ids or len(toxic_ids) == len(label):
        return nothing
    session = docs.sparkSession
    kept = session.createDataFrame(sorted(label.items()), "row long, toxic int")
    once = texts.drop("toxic").join(F.broadcast(kept), "row")
    units = materialize(_unit_rows(once).join(F.broadcast(kept), "row"), "units")
    base = len(toxic_ids) / len(label)
    counts = materialize(units.groupBy("unit").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")), "counts")
    b = F.col("n") - F.col("a")
    share = F.col("a") / F.col("n")
    gain = F.col("a") * F.log(share / base) + F.when(b > 0, b * F.log((1 - share) / (1 - base))).otherwise(0.0)
    n_units = counts.count()
    # The gate of ``significant`` up to rounding: what passes it here is bounded by the words of sample_rows texts.
    passed = counts.where((share > base) & (F.col("a") >= 3) & (gain >= float(np.log(max(n_units, 2))) + 1.99))
    top = sorted((r["unit"], r["a"], r["n"]) for r in passed.collect())
    a_of, n_of = (np.array([r[k] for r in top], dtype=float) for k in (1, 2))
    chosen_names = [top[i][0] for i in significant(a_of, n_of - a_of, base, n_units)]
    holders: dict[str, set[int]] = {u: set() for u in chosen_names}
    names = session.createDataFrame([(u,) for u in chosen_names], "unit string")
    for r in units.join(F.broadcast(names), "unit").select("row", "unit").collect():  # rows of toxic words in sample_rows texts
        holders[r["unit"]].add(r["row"])
    units_in = Counter(r for u in chosen_names for r in holders[u])
    votes = {u: [(r in toxic_ids, 1 / units_in[r]) for r in sorted(holders[u])] for u in chosen_names}
    toxic = {u: (sum(v for t, v in vs if t), sum(v for t, v in vs if not t)) for u, vs in votes.items()}
    clean = counts.where(b > 0).join(F.broadcast(names), "unit", "left_anti")
    orders = (F.desc("b"), F.asc("unit")), (F.xxhash64("unit"), F.asc("unit"))  # the frequent ones, and others
    halves = [clean.select("unit", b.alias("b")).orderBy(*o).limit(NEGATIVES // 2).collect() for o in orders]
    others = {r["unit"]: r["b"] for half in halves for r in half}
    if not toxic or not others:
        return nothing
    model = train_machine(toxic, others)
    seen = scores(once.withColumnRenamed("row", "doc_id"), model).collect()  # bounded by sample_rows
    features = np.array([[r["margin"], r["weight"]] for r in seen])
    model.curve = logistic(features, np.array([label[r["doc_id"]] for r in seen], dtype=float))
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, margin, weight, score`` of every text."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.float64()) for c in ("margin", "weight", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for ids, texts in text_slices(batches):
            features = model.features(texts, known)
            columns = [features[:, 0].copy(), features[:, 1].copy(), model.score(features)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, margin double, weight double, score double")


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with the columns they had."""
    model = fit(docs, labels)
    names = docs.columns
    schema_in = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            mask = []
            text = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(names.index("text"))], ["i", "t"])
            for _, texts in text_slices([text.set_column(1, "t", text.column(1).fill_null(""))]):
                mask += (model.score(model.features(texts, known)) < threshold).tolist()
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, schema_in)
