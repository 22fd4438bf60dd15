"""Steps that must not grow faster than their input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.text import sentence_marks, tokens
from seqloom.operators import decode, elements, lookup, tagger
from seqloom.operators import language_model as lm
from seqloom.operators import vocabulary as voc
from seqloom.plans import translation
from seqloom.sources import corpus


def make_lines(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "line_id long, text string")
    return df.withColumn("toks", sentence_marks(tokens("text")))


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(5)
    return make_lines(spark, [" ".join(rng.choice("aaabbcdefgh") for _ in range(rng.randrange(0, 9))) for _ in range(60)] + ["a b"] * 5)


@pytest.fixture(scope="module")
def model(lines):
    return lm.train(lm.pair_rows(lines, ["line_id"]), ("line_id", "pos"))


def test_beam_steps_are_few_joins(model, monkeypatch):
    """Fifty words are not fifty joins; without room for the followers in a worker each step is one, with one result."""
    calls, step = [], decode._beam_step
    monkeypatch.setattr(decode, "_beam_step", lambda *args: calls.append(1) or step(*args))
    walked = {r["state"]: (r["path"], r["score"]) for r in decode.beam_paths(model, 3, 50).collect()}
    assert len(calls) < 5
    monkeypatch.setattr(decode, "BROADCAST_BYTES", 0)
    short = {r["state"]: (r["path"], r["score"]) for r in decode.beam_paths(model, 3, 6).collect()}
    monkeypatch.undo()
    again = {r["state"]: (r["path"], r["score"]) for r in decode.beam_paths(model, 3, 6).collect()}
    assert short.keys() == walked.keys()
    assert {k: v[0] for k, v in short.items()} == {k: v[0] for k, v in again.items()}
    assert all(short[k][1] == pytest.approx(again[k][1]) for k in short)


def test_a_word_meets_the_vocabulary_once_per_unit(spark, monkeypatch):
    """Encoding and decoding shuffle a word once per unit of lines and not at each place, whatever the table's size."""
    monkeypatch.setattr("seqloom.operators.elements.fits", lambda table: False)
    met = []
    real = elements.materialize
    monkeypatch.setattr(elements, "materialize", lambda df, name: met.append(real(df, name)) or met[-1])
    fitted = spark.createDataFrame([("a", 7, 1), ("b", 8, 1)], "tok string, id int, n long")
    lines = spark.createDataFrame([(1, 0, ["a", "b", None, "zz"] * 50), (1, 1, []), (2, 0, None), (3, 0, ["b"])], "doc_id long, line_no int, toks array<string>")
    encoded = voc.encode_lines(lines.coalesce(1), ["doc_id", "line_no"], fitted)
    got = {(r[0], r[1]): r[2] for r in encoded.collect()}
    assert got == {(1, 0): [7, 8, 0, 0] * 50, (1, 1): [], (2, 0): [], (3, 0): [8]}
    assert met[0].select(F.sum(F.size(F.coalesce("_held", F.array())))).first()[0] == 3
    decoded = voc.decode_lines(encoded, ["doc_id", "line_no"], fitted).collect()
    assert {(r[0], r[1]): r[2] for r in decoded} == {(1, 0): " ".join(["a b <UNK> <UNK>"] * 50), (1, 1): "", (2, 0): "", (3, 0): "b"}


def test_units_of_elements(spark, monkeypatch):
    monkeypatch.setattr(elements, "UNIT_ELEMENTS", 4)
    rows = spark.createDataFrame([(i, [j % 5 for j in range(i)]) for i in range(12)], "k int, a array<int>")
    table = spark.range(4).select(F.col("id").cast("int").alias("x"), (F.col("id") * 10).cast("string").alias("y"))
    got = dict(elements.look_up_elements(rows.coalesce(2), ["k"], "a", table, None, "b").collect())
    assert got == {i: [None if j % 5 == 4 else str(j % 5 * 10) for j in range(i)] for i in range(12)}


def test_hot_keys_are_looked_for_once(lines, model, monkeypatch):
    """Lookups by several keys read their facts once for hot keys, and not again behind each join."""
    passes, search = [], lookup._hot_keys
    monkeypatch.setattr(lookup, "_hot_keys", lambda facts, ons: passes.append((facts.columns, ons)) or search(facts, ons))
    monkeypatch.setattr(lookup, "fits", lambda table, limit: False)
    pairs = lm.pair_rows(lines, [])
    numbered = lm.to_ids(pairs, model.vocabulary)
    assert passes == [(pairs.columns, [["prev"], ["next"]])]
    got = numbered.groupBy("prev_id", "next_id").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(r[0], r[1]): r[2] for r in model.bigrams.collect()}


def test_training_on_ids(lines, model):
    """Counting pairs of ids gives the model that counting pairs of words gives."""
    vocabulary = lm.fit_words(lines, ["line_id"])
    encoded = lm.encode(lines, ["line_id"], vocabulary)
    by_ids = lm.train_encoded(encoded, vocabulary)
    for name in ("vocabulary", "bigrams", "unigrams"):
        assert sorted(map(tuple, getattr(by_ids, name).na.fill(-1).collect())) == sorted(map(tuple, getattr(model, name).na.fill(-1).collect()))
    assert (by_ids.targets, by_ids.types) == (model.targets, model.types)
    words = lm.corpus_loss(model, lm.pair_rows(lines.withColumn("g", F.lit(1)), ["g"]), ["g"], F.lit(1.0)).first()
    ids = lm.corpus_loss(by_ids, lm.pair_rows(encoded.withColumn("g", F.lit(1)), ["g"], "ids"), ["g"], F.lit(1.0)).first()
    assert ids["loss"] == pytest.approx(words["loss"]) and ids["n_tok"] == words["n_tok"]


def test_pairs_of_ids_travel_in_sorted_runs(spark, monkeypatch):
    """Pairs are counted before they are shuffled, in order, and none reaches across sentences; the model lies in order."""
    monkeypatch.setattr(lm, "RUN_IDS", 6)
    sentences = [[3, 4], [], [3, 5, 6, 4], [7], [3, 5, 6, 5, 6, 4], [], [3, 4], [3, 5, 4]]
    batches = [lm.pa.RecordBatch.from_arrays([lm.pa.array(part, lm.pa.list_(lm.pa.int32()))], ["ids"]) for part in (sentences[:3], [], sentences[3:])]
    runs = [r.to_pydict() for r in lm._counted_runs()(iter([b.slice(0) for b in batches]))]
    found = collections.Counter()
    for r in runs:
        pairs = list(zip(r["prev"], r["next"]))
        assert pairs == sorted(set(pairs))
        found.update(dict(zip(pairs, r["n"])))
    assert len(runs) == 1 and found == collections.Counter(p for s in sentences for p in zip(s, s[1:]))
    sliced = lm.pa.RecordBatch.from_arrays([lm.pa.array(sentences, lm.pa.list_(lm.pa.int32()))], ["ids"]).slice(2, 3)
    assert sum(sum(r.to_pydict()["n"]) for r in lm._counted_runs()(iter([sliced]))) == 8
    encoded = spark.createDataFrame([(s,) for s in sentences * 3], "ids array<int>")
    vocabulary = spark.createDataFrame([(t, i, 1) for i, t in enumerate("abcdefgh")], "tok string, id int, n long")
    model = lm.train_encoded(encoded, vocabulary)
    assert {(r["prev"], r["next"]): r["n"] for r in model.bigrams.collect()} == {p: 3 * n for p, n in found.items()}
    laid = model.bigrams.withColumn("file", F.input_file_name()).collect()
    for name in {r["file"] for r in laid}:
        of_file = [(r["prev"], r["next"]) for r in laid if r["file"] == name]
        assert of_file == sorted(of_file)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_successors_stand_once(model, k):
    """A seen word of the short list is ranked once, with its count."""
    rows = decode.top_successors(model, k).collect()
    assert len({(r["prev"], r["next"]) for r in rows}) == len(rows)
    assert sorted((r["prev"], r["rank"]) for r in rows) == [(s, i) for s in sorted({r["prev"] for r in rows}) for i in range(1, min(k, model.types) + 1)]
    exact = {(r["prev"], r["next"]): r["p"] for r in lm.with_probability(model, model.bigrams, "prev", "next").collect()}
    assert all(r["p"] == pytest.approx(exact[r["prev"], r["next"]]) for r in rows if (r["prev"], r["next"]) in exact)


def test_saved_models_and_scores_join_no_occurrence(spark, monkeypatch):
    """Neither counts pairs of words nor looks each place of a word up."""
    from seqloom.plans import models

    def refuse(*args, **kwargs):
        raise AssertionError("a row for each place of a word met a table")

    monkeypatch.setattr(lm, "to_ids", refuse)
    monkeypatch.setattr(voc, "lookup", refuse)
    assert models.model_roundtrip(spark, "/root/testdata/sf0.001").count()
    assert models.score_with_udf(spark, "/root/testdata/sf0.001").count()


def test_feature_lines_are_parsed_once(spark):
    """Label and entries of a line are found under the generator; above it, each entry would split the whole line again."""
    df = spark.createDataFrame([(0, "yes\tred_:_1.5 big_:_2"), (1, "no"), (2, "no\t"), (3, "no\tbig_:_1")], "line_id long, text string")
    parsed = corpus.parse_features(df.where("line_id <> 1"), ["line_id"])
    above, below = parsed._jdf.queryExecution().optimizedPlan().toString().split("Generate")
    assert "\t" not in above and below.count("split(text") == 1 and below.count("\\s") == 1
    assert sorted(map(tuple, parsed.collect())) == [(0, "yes", 0, "red", 1.5), (0, "yes", 1, "big", 2.0), (3, "no", 0, "big", 1.0)]


@pytest.mark.parametrize("part_words", [16 << 20, 5])
def test_lexicon_counts_shuffle_no_cells(spark, monkeypatch, part_words):
    """Words that meet are counted in the blocks of their target word, also where a word's sentences are cut by pair."""
    from seqloom.operators import translation
    from seqloom.plans.translation import lexicon_lines
    from seqloom.sources.corpus import parse_lexicon

    def refuse(*args, **kwargs):
        raise AssertionError("a row for each pair of words")

    monkeypatch.setattr(translation, "cells", refuse)
    monkeypatch.setattr(translation, "PART_WORDS", part_words)
    rng = random.Random(3)
    texts = [tuple(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 6))) for _ in "st") for _ in range(30)] * 2 + [("A b", "x\ny x")]
    want, total = {}, {}
    for src, trg in texts:
        for s in set(src.lower().split()):
            for t in set(trg.lower().split()):
                want[t, s] = want.get((t, s), 0) + 1
                total[s] = total.get(s, 0) + 1
    rows = parse_lexicon(lexicon_lines(spark.createDataFrame(texts, "src string, trg string")), []).collect()
    assert {(r["trg"], r["src"]): r["prob"] for r in rows} == {k: n / total[k[1]] for k, n in want.items()} and len(rows) == len(want)


def in_file_order(table, *keys):
    """Whether the rows of each file of a written table are in the order of ``keys``."""
    rows = table.select(F.input_file_name().alias("file"), *keys).collect()
    files = [[tuple(r[1:]) for r in rows if r["file"] == name] for name in {r["file"] for r in rows}]
    return len(rows) > len(files) and all(f == sorted(f) for f in files)


def test_tagger_lies_in_the_order_of_contexts(spark):
    words = [f"w{i * 7919 % 101}" for i in range(600)]
    docs = spark.createDataFrame([(1, words[:300], ["x"] * 300), (2, words[300:], ["y"] * 300)], "k int, words array<string>, tags array<string>")
    model = tagger.train_tagger(tagger.with_context(docs, ["k"], tags="tags"))
    assert in_file_order(model, "prev", "word")
    assert model.agg(F.sum("n")).first()[0] == 600


def test_following_words_lie_in_order(spark, monkeypatch):
    met, real = {}, translation.materialize
    monkeypatch.setattr(translation, "materialize", lambda df, name: met.setdefault(name, real(df, name)))
    text = " ".join(f"w{i * 7919 % 101}" for i in range(600))
    shares = translation.next_word_shares(spark.createDataFrame([(text,), ("w1 w2",)], "text string"))
    assert in_file_order(met["following"], "prev", "next")
    assert shares.where("prev = '<s>'").agg(F.sum("p")).first()[0] == pytest.approx(1.0)
