import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.text import sentence_marks, tokens
from seqloom.operators import decode
from seqloom.operators import language_model as lm


def make_lines(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "line_id long, text string")
    return df.withColumn("toks", sentence_marks(tokens("text")))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    texts = [" ".join(rng.choice("aaabbcdefgh") for _ in range(rng.randrange(0, 7))) for _ in range(40)]
    return texts + ["a b c"] * 15 + ["rare1", "rare2 a"]


@pytest.fixture(scope="module")
def model(spark, corpus):
    return lm.train(lm.pair_rows(make_lines(spark, corpus), ["line_id"]), ("line_id", "pos"))


class ByHand:
    """The model counted line by line."""

    def __init__(self, texts, weight=0.7):
        words = [t.split() for t in texts]
        counts = collections.Counter(w for line in words for w in line)
        self.kept = [w for w in dict.fromkeys(w for line in words for w in line) if counts[w] > 1]
        names = ["<UNK>", "<EOS>", "{*}", "<s>", "</s>", *self.kept]
        self.ids = {w: i for i, w in enumerate(names)}
        self.names = names
        self.pairs, self.before, self.after = collections.Counter(), collections.Counter(), collections.Counter()
        for line in words:
            row = self.row(line)
            for a, b in zip(row, row[1:]):
                self.pairs[a, b] += 1
                self.before[a] += 1
                self.after[b] += 1
        self.size = sum(self.after.values()) + len(self.kept) + 2
        self.weight = weight
        self.targets = [0, 4, *range(5, len(names))]
        self.states = [0, 3, *range(5, len(names))]

    def row(self, line):
        return [3, *[self.ids.get(w, 0) for w in line], 4]

    def p(self, a, b):
        base = (self.after[b] + 1) / self.size
        if not self.before[a]:
            return base
        return self.weight * self.pairs[a, b] / self.before[a] + (1 - self.weight) * base

    def top(self, a, k):
        return sorted(self.targets, key=lambda b: (-round(math.log(self.p(a, b)), 9), b))[:k]

    def greedy(self, a, limit):
        path = []
        while len(path) < limit and (not path or path[-1] != 4):
            a = self.top(a, 1)[0]
            path.append(a)
        return path

    def beam(self, state, beam, limit):
        live, done, room = [((), 0.0)], [], min(beam, len(self.targets))
        for step in range(1, limit + 1):
            grown = []
            for path, score in live:
                last = path[-1] if path else state
                grown += [(path + (b,), score + math.log(self.p(last, b) + 1e-6)) for b in self.top(last, room)]
            grown.sort(key=lambda h: (-round(h[1], 9), h[0]))
            kept = grown[:room]
            if step == limit:
                live = kept
                break
            ended = [h for h in kept if h[0][-1] == 4]
            done += ended
            room -= len(ended)
            live = [h for h in kept if h[0][-1] != 4] if room > 0 else []
            if not live:
                break
        pool = done or live
        return list(min(pool, key=lambda h: (-round(h[1] / len(h[0]), 9), h[0]))[0])


@pytest.fixture(scope="module")
def hand(corpus):
    return ByHand(corpus)


def test_ids_and_probabilities(model, hand):
    assert {r["tok"]: r["id"] for r in model.vocabulary.collect()} == hand.ids
    rows = lm.with_probability(model, model.bigrams, "prev", "next").collect()
    assert {(r["prev"], r["next"]): r["n"] for r in rows} == dict(hand.pairs)
    assert all(r["p"] == pytest.approx(hand.p(r["prev"], r["next"])) for r in rows)
    for a in hand.states:
        assert sum(hand.p(a, b) for b in hand.targets) == pytest.approx(1)


def test_losses(spark, model, hand):
    texts = ["a b", "", "new words a", "a b c", "a b c"]
    lines = make_lines(spark, texts).withColumn("share", 1 / (F.size("toks") - 1)).withColumn("g", F.lit("all"))
    nll = {}
    for i, t in enumerate(texts):
        row = hand.row(t.split())
        nll[i] = [-math.log(hand.p(a, b)) for a, b in zip(row, row[1:])]
    got = lm.sentence_loss(model, lm.pair_rows(lines, ["line_id"]), ["line_id"]).collect()
    assert {r["line_id"]: r["n_tok"] for r in got} == {i: len(v) for i, v in nll.items()}
    for r in got:
        assert r["loss"] == pytest.approx(sum(nll[r["line_id"]]) / len(nll[r["line_id"]]))
        assert r["ppl"] == pytest.approx(math.exp(r["loss"]))
    whole = lm.corpus_loss(model, lm.pair_rows(lines, ["g", "share"]), ["g"], F.col("share")).first()
    assert whole["loss"] == pytest.approx(sum(sum(v) / len(v) for v in nll.values()) / len(nll))
    assert whole["token_loss"] == pytest.approx(sum(map(sum, nll.values())) / sum(map(len, nll.values())))


@pytest.mark.parametrize("k", [1, 3, 50])
def test_successors(model, hand, k):
    got = collections.defaultdict(list)
    for r in decode.top_successors(model, k).orderBy("prev", "rank").collect():
        got[r["prev"]].append(r["next"])
    assert got == {a: hand.top(a, k) for a in hand.states}


def test_brevity(model):
    plain = {(r["prev"], r["next"]): r["p"] for r in decode.top_successors(model, 50).collect()}
    for r in decode.top_successors(model, 50, 0.25).collect():
        factor = 0.75 if r["next"] == 4 else 1.0
        assert r["p"] == pytest.approx(plain[r["prev"], r["next"]] * factor)


@pytest.mark.parametrize("limit", [1, 5, 12])
def test_greedy(model, hand, limit):
    got = {r["state"]: r["path"] for r in decode.greedy_paths(model, limit).collect()}
    assert got == {a: hand.greedy(a, limit) for a in hand.states}


@pytest.mark.parametrize("beam, limit", [(2, 4), (3, 6), (99, 3), (3, 50)])
def test_beam(model, hand, beam, limit):
    want = {a: hand.beam(a, beam, limit) for a in hand.states}
    for bounded in (True, False):
        got = {r["state"]: r["path"] for r in decode.beam_paths(model, beam, limit, bounded).collect()}
        assert got == want


def test_long_hypotheses_are_found(spark):
    """Lines of a fixed chain of twenty words: the best hypothesis ends far beyond the first block of steps."""
    chain = " ".join(f"w{i:02d}" for i in range(20))
    model = lm.train(lm.pair_rows(make_lines(spark, [chain] * 200), ["line_id"]), ("line_id", "pos"), weight=0.999)
    paths = {r["state"]: r["path"] for r in decode.beam_paths(model, 2).collect()}
    start = lm.BOS_ID
    assert len(paths[start]) == 21 and paths[start][-1] == lm.END_ID
    unbounded = {r["state"]: r["path"] for r in decode.beam_paths(model, 2, bounded=False).collect()}
    assert paths == unbounded


def test_beam_of_one_is_greedy(model):
    greedy = {r["state"]: r["path"] for r in decode.greedy_paths(model, 6).collect()}
    beam = {r["state"]: r["path"] for r in decode.beam_paths(model, 1, 6).collect()}
    assert greedy == beam


def test_prompts(spark, model, hand):
    texts = ["b a", "", "unheard"]
    prompts = spark.createDataFrame(list(enumerate(texts)), "line_id long, text string").withColumn("toks", tokens("text"))
    paths = decode.path_text(model, decode.greedy_paths(model, 4)).select("state", "output")
    got = {r["line_id"]: r["output"] for r in decode.continue_prompts(model, prompts, paths).collect()}
    for i, state in enumerate((hand.ids["a"], 3, 0)):
        path = hand.greedy(state, 4)
        words = path[: path.index(4)] if 4 in path else path
        assert got[i] == " ".join(hand.names[w] for w in words)
