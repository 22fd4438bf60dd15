"""The stages' own input and output, the registered queries, and SQL."""

import collections
import itertools
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from seqloom.llm import packing, quality, toxicity
from seqloom.llm.minhash import shingle_set
from seqloom.llm.queries import SQL, tokenizer
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark, tmp_path, monkeypatch):
    """The five stages on planted cases: short, toxic, exact and near copies, repeated lines, and odd rows; columns of
    any name stay. The learned verdicts have tests of their own: here no rule is learned, one word is toxic."""

    class OneWord:
        def features(self, texts, known):
            return texts

        def score(self, texts):
            return np.array([0.9 if "badword" in t else 0.1 for t in texts])

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rules = quality.fit(spark.createDataFrame([], "doc_id long, text string"), labels.where("false"))
    monkeypatch.setattr(quality, "fit", lambda *given: rules)
    monkeypatch.setattr(toxicity, "fit", lambda *given: OneWord())
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(4, 9))) for _ in range(4000)]
    line = lambda: " ".join(rng.choice(words, 25).tolist())
    a, b, c, d, e = ([line() for _ in range(4)] for _ in range(5))
    other = line()
    texts = {
        1: a, 2: a, 3: a[:3] + [other], 4: b + ["badword"], 5: ["too short"], 6: c + [a[1].upper() + "!"], 7: d,
        8: [" ".join(d[0].split() + ["more"]), *e[1:]], 9: [None], 10: [""],
    }
    rows = [(i, None if lines == [None] else "\n".join(lines)) for i, lines in texts.items()] + [(None, "\n".join(e))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for name in ("_own", "_key", "own", "key", "kept", "removed"):
        docs = docs.withColumn(name, F.lit("as it was"))
    columns, after = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
            assert {tuple(r) for r in docs.select("_own", "_key", "own", "key", "kept", "removed").collect()} == {("as it was",) * 6}
            after.append({r[0]: r[1] for r in docs.select("doc_id", "text").collect()})
    assert set(after[0]) == {1, 2, 3, 4, 6, 7, 8, None} and set(after[1]) == {1, 2, 3, 6, 7, 8, None}
    lines = after[2]
    assert lines[1] == "\n".join(a) and 2 not in lines and lines[3] == other and lines[6] == "\n".join(c)
    assert lines[None] == "\n".join(e) and lines.get(8, "more").split()[-1] == "more"  # a word more may go as a near copy
    everything = [re.sub(r"\W+", " ", x.lower()).strip() for text in lines.values() for x in text.split("\n")]
    assert max(collections.Counter(x for x in everything if x).values()) == 1
    sets = [shingle_set(text, 5) for text in after[3].values()]
    assert not any(x and 100 * len(x & y) >= 80 * len(x | y) for x, y in itertools.combinations(sets, 2))
    want = packing.pieces(before, tokenizer("word_bpe_49k.json")).select("doc_id", "piece", "ids_crc32")
    assert sorted(map(tuple, want.collect()), key=str) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()), key=str)


def test_stages_of_an_empty_table(spark, monkeypatch):
    none = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, none, FOLDER).count() == 0


def test_registered_with_sql(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert len({n.split("_")[0] for n in names}) == 13 and "pipeline" in entry.queries()
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    for name, statement in SQL.items():
        result = compare(entry.queries()[name](spark, FOLDER).toPandas(), con.execute(statement).df())
        assert result.startswith("ok"), (name, result)
