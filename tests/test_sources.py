import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.functions.text import TRANSLATION_MARKERS
from seqloom.operators import features, tagger
from seqloom.operators.scorer import score_batches
from seqloom.operators.vocabulary import encode_lines
from seqloom.sources import model_dir
from seqloom.sources.corpus import (
    parallel,
    parse_features,
    parse_labelled_text,
    parse_lexicon,
    read_lines,
    scale_vectors,
    split_by_position,
    tokenize,
)
from seqloom.streaming.encode import counting_hook, read_encoded, run_encoder, text_stream


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, text string")


def test_lines_in_file_order(spark, tmp_path):
    want = []
    for f in range(3):
        part = [f"file {f} line {i}" for i in range(400)]
        (tmp_path / f"part{f}.txt").write_text("\n".join(part) + "\n", encoding="utf-8")
        want += part
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = read_lines(spark, str(tmp_path))
        got = read.orderBy("line_id").collect()
        plan = read._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert read.rdd.getNumPartitions() > 1 and "Exchange hash" not in plan and "Exchange range" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["text"] for r in got] == want
    assert [r["line_id"] for r in got] == list(range(len(want)))


def test_parallel_drops_lines_without_partner(spark):
    got = parallel(lines(spark, "a", "b", "c"), lines(spark, "x", "y"), ["line_id"]).orderBy("line_id").collect()
    assert [(r["src"], r["trg"]) for r in got] == [("a", "x"), ("b", "y")]


def test_weighted_features(spark):
    df = lines(spark, "yes\tred_:_1.5 big_:_2 red_:_0.5", "no\tbig_:_1")
    matrix = features.feature_matrix(parse_features(df, ["line_id"]), ["line_id", "label"])
    assert {(r["line_id"], r["label"], r["feat"]): r["score"] for r in matrix.collect()} == {
        (0, "yes", "red"): 2.0, (0, "yes", "big"): 2.0, (1, "no", "big"): 1.0,
    }
    known = spark.createDataFrame([("red", 3, 2)], "tok string, id int, n long")
    rows = features.known_features(parse_features(lines(spark, "red_:_1 blue_:_9"), ["line_id"], labelled=False), known)
    assert [(r["feat"], r["id"], r["score"]) for r in rows.collect()] == [("red", 3, 1.0)]
    vectors = features.feature_vectors(matrix.withColumn("id", F.length("feat")).where("line_id = 1"), ["line_id"], 5)
    assert vectors.first()["features"].toArray().tolist() == [0, 0, 0, 1.0, 0]
    parts = vectors.select(features.vector_parts("features").alias("v")).select("v.*").first()
    assert (parts["size"], parts["indices"], parts["values"]) == (5, [3], [1.0])
    with pytest.raises(Exception):
        parse_features(lines(spark, "yes\tred_:_abc"), ["line_id"]).collect()


def test_labelled_text(spark):
    parsed = parse_labelled_text(lines(spark, "1\ta b a", "7\tc"), ["line_id"])
    bag = features.presence(parsed, ["line_id", "label"])
    assert sorted((r["line_id"], r["label"], r["feat"]) for r in bag.collect()) == [(0, 1, "a"), (0, 1, "b"), (1, 0, "c")]


def test_vectors(spark):
    df = spark.createDataFrame([(i, [255.0, 0.0]) for i in range(5)], "id long, v array<float>")
    got = split_by_position(scale_vectors(df, "v", 255.0), "id", 3).orderBy("id").collect()
    assert [r["part"] for r in got] == ["train"] * 3 + ["test"] * 2
    assert got[0]["v"] == [1.0, 0.0]


def test_spec(spark, tmp_path):
    spec = {"name": "m", "alpha": 0.1, "size": 7, "flag": False}
    path = str(tmp_path / "spec")
    model_dir.write_spec(model_dir.spec_rows(spark, spec), path)
    assert sorted(r["value"] for r in spark.read.text(path).collect())[0] == "alpha\tfloat\t%.30f" % 0.1
    assert model_dir.spec_dict(model_dir.read_spec(spark, path)) == spec
    with pytest.raises(TypeError, match="list"):
        model_dir.spec_rows(spark, {"x": [1]})
    spark.range(1).selectExpr("'x\tlist\t1' AS value").write.text(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="unknown type"):
        model_dir.read_spec(spark, str(tmp_path / "bad")).collect()


def test_tagger(spark):
    rows = [(0, ["the", "can"], ["D", "N"]), (1, ["can"], ["V"]), (2, ["can"], ["V"]), (3, [], [])]
    train = spark.createDataFrame(rows, "line_id long, words array<string>, tags array<string>")
    contexts = tagger.with_context(train, ["line_id"], tags="tags")
    model = tagger.train_tagger(contexts)
    asked = spark.createDataFrame([(0, ["the", "can", "can", "new"])], "line_id long, words array<string>")
    got = tagger.predict(model, tagger.with_context(asked, ["line_id"])).orderBy("pos").collect()
    # Seen after "the"; seen only elsewhere; never seen: the most frequent tag.
    assert [r["tag"] for r in got] == ["D", "N", "V", "V"]
    accuracy = tagger.tag_accuracy(model, contexts.withColumn("g", F.lit(1)), ["g"]).first()
    assert (accuracy["n_tok"], accuracy["accuracy"]) == (4, 1.0)
    assert accuracy["loss"] == pytest.approx(0, abs=1e-5)
    other = spark.createDataFrame([(0, ["can", "the", "new"], ["N", "D", "Q"])], "line_id long, words array<string>, tags array<string>")
    scorer = tagger.TaggerScorer(["line_id"]).train(contexts)
    judged = scorer.evaluate(tagger.with_context(other, ["line_id"], tags="tags")).first()
    # After <s>, "can" is a verb in both; "the" is a determiner wherever it was seen; "new" and Q never were.
    want = [0.0, 1.0, 0.0]
    assert judged["loss"] == pytest.approx(sum(-math.log(p + 1e-6) for p in want) / 3)
    assert judged["accuracy"] == pytest.approx(1 / 3)
    assert scorer.classify(tagger.with_context(asked, ["line_id"])).count() == 4
    levels = {r["level"]: r["c"] for r in tagger.back_off_counts(model).groupBy("level").agg(F.sum("n").alias("c")).collect()}
    assert levels == {0: 4, 1: 4, 2: 4}


def test_tag_accuracy_shuffles_each_context_seldom(spark, monkeypatch):
    rows = [(0, ["the", "can"], ["D", "N"]), (1, ["can", "can"], ["V", "N"])]
    lines_ = spark.createDataFrame(rows, "line_id long, words array<string>, tags array<string>")
    contexts = tagger.with_context(lines_, ["line_id"], tags="tags")
    model, plans = tagger.train_tagger(contexts), []
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    store = tagger.materialize
    monkeypatch.setattr(tagger, "materialize", lambda df, name="table": plans.append(shuffles(df)) or store(df, name))
    judged = tagger.tag_accuracy(model, contexts, ["line_id"])
    assert sum(plans) + shuffles(judged) <= 8
    assert {r["line_id"]: r["accuracy"] for r in judged.collect()} == {0: 1.0, 1: 1.0}


def test_tag_accuracy_joins_the_longest_contexts_once(spark, monkeypatch):
    lines_ = spark.createDataFrame([(0, ["a", "b"], ["D", "N"]), (1, ["a", "b"], ["D", "V"]), (2, ["a", "b"], ["D", "V"])], "line_id long, words array<string>, tags array<string>")
    contexts = tagger.with_context(lines_, ["line_id"], tags="tags")
    model, plans, store = tagger.train_tagger(contexts), {}, tagger.materialize
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    monkeypatch.setattr(tagger, "materialize", lambda df, name="table": plans.update({name: joins(df)}) or store(df, name))
    judged = {r["line_id"]: r for r in tagger.tag_accuracy(model, contexts, ["line_id"]).collect()}
    assert plans["longest"] == 1
    assert [judged[i]["accuracy"] for i in range(3)] == [0.5, 1.0, 1.0]
    assert judged[0]["loss"] == pytest.approx(-(math.log(1 + 1e-6) + math.log(1 / 3 + 1e-6)) / 2)


def test_lexicon_lines_are_split_once(spark):
    """However many columns are read and whatever filters a join adds."""
    text = spark.createDataFrame([("x  a 0.5",), (" y b 1",)], "text string").repartition(2)
    known = spark.createDataFrame([("x", 1), ("y", 2)], "trg string, id int").repartition(2)
    named = parse_lexicon(text, []).join(known, "trg").where("src is not null")
    assert named._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(map(tuple, named.collect())) == [("x", "a", 0.5, 1), ("y", "b", 1.0, 2)]


def test_scorer(spark):
    def length(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["line_id"]].assign(score=batch["text"].str.len().astype(float))

    got = score_batches(lines(spark, "abc", "d"), length, "line_id long, score double").orderBy("line_id").collect()
    assert [r["score"] for r in got] == [3.0, 1.0]


def test_stream_equals_batch(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(w, i, 1) for i, w in enumerate((*TRANSLATION_MARKERS, "a", "b"))]
    vocabulary = spark.createDataFrame(rows, "tok string, id int, n long")
    totals = []
    stored = []
    for number, texts in enumerate((["a b", "c"], ["b", ""])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{number}.txt").write_text("\n".join(texts) + "\n")
        stored += texts
        stream = tokenize(text_stream(spark, folder)).select(F.col("text").alias("line"), "toks")
        run_encoder(stream, ["line"], vocabulary, out, state, counting_hook(totals))
    batch = tokenize(spark.createDataFrame([(t, t) for t in stored], "line string, text string"))
    want = sorted((r["line"], r["ids"]) for r in encode_lines(batch, ["line"], vocabulary).collect())
    assert sorted((r["line"], r["ids"]) for r in read_encoded(spark, out).collect()) == want
    assert totals == [(0, 2), (1, 2)]


def test_custom_tokenizer(spark):
    got = tokenize(lines(spark, "a-b"), tokenizer=lambda text: F.split(text, "-")).first()["toks"]
    assert got == ["a", "b"]
