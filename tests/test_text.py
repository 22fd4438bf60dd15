import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import text as tx


def value(spark, column, **cells):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("gap", [" ", "\t", "\u3000", "\u00a0", "\x1c", "\u2003", " \t "])
def test_tokens_split_at_unicode_space(spark, gap):
    line = f"{gap}Ein{gap}Zwei{gap}"
    assert value(spark, tx.tokens("a"), a=line) == ["ein", "zwei"]
    assert value(spark, tx.tokens("a", lowercase=False), a=line) == ["Ein", "Zwei"]


def test_blank_line(spark):
    assert value(spark, tx.tokens("a"), a="  ") == []
    assert value(spark, tx.sentence_marks(tx.tokens("a")), a="") == ["<s>", "</s>"]
    pairs = value(spark, tx.next_pairs(tx.sentence_marks(tx.tokens("a"))), a="")
    assert [tuple(p) for p in pairs] == [("<s>", "</s>")]


def test_until(spark):
    words = F.array(F.lit("a"), F.lit("<EOS>"), F.lit("b"), F.lit("<EOS>"))
    assert value(spark, tx.until(words, "<EOS>")) == ["a"]
    assert value(spark, tx.until(words, "<EOS>", inclusive=True)) == ["a", "<EOS>"]
    assert value(spark, tx.until(words, "z")) == ["a", "<EOS>", "b", "<EOS>"]


def test_bag_and_places(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(6) for _ in range(rng.randrange(12))],) for _ in range(30)]
    df = spark.createDataFrame(rows, "w array<int>")
    for r in df.select("w", tx.bag(F.col("w")).alias("b"), tx.places(F.col("w")).alias("p")).collect():
        assert {x["key"]: x["n"] for x in r["b"]} == {k: r["w"].count(k) for k in r["w"]}
        assert {x["key"]: x["at"] for x in r["p"]} == {k: [i for i, v in enumerate(r["w"]) if v == k] for k in r["w"]}


def test_sequence_key_orders_like_tuples(spark):
    rng = random.Random(4)
    top = [2**63 - 1, 2**31 - 1, 2**31 - 1]
    rows = [tuple(rng.choice([0, 1, rng.randrange(m), m]) for m in top) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b int, c int").select("*", tx.sequence_key("a", "b", "c").alias("k"))
    got = [(r["a"], r["b"], r["c"]) for r in df.orderBy("k").collect()]
    assert got == sorted(rows)
    assert len({r["k"] for r in df.collect()}) == len(set(rows))
