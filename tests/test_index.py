import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.operators import batching
from seqloom.operators.index import dense_index, following
from seqloom.operators.lookup import hot_keys, lookup


def test_dense_index_is_the_sorted_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice([7, 7, 7, rng.randrange(50)]), i) for i in range(2000)]  # one length holds most lines
    df = spark.createDataFrame(rows, "n int, line_id long").repartition(7)
    got = dense_index(df, F.desc("n"), "line_id", start=3).orderBy("row_index").collect()
    assert [(r["n"], r["line_id"]) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [r["row_index"] for r in got] == list(range(3, 2003))


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.createDataFrame([], "a int"), "a").collect() == []


def test_following_crosses_runs(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0, 0, 0, 1, 2]), at, str(rng.randrange(9))) for at in rng.sample(range(5000), 800)]
    df = spark.createDataFrame(rows, "g int, at int, v string")
    got = following(df, "g", F.floor(F.col("at") / 40), ["at"], "v")
    want = df.withColumn("next", F.lead("v").over(Window.partitionBy("g").orderBy("at")))
    assert sorted(got.select("g", "at", "v", "next").collect(), key=str) == sorted(want.collect(), key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_above_the_broadcast_limit(spark, how):
    rng = random.Random(7)
    words = ["the"] * 400 + ["absent"] * 300 + [f"w{rng.randrange(300)}" for _ in range(600)] + ["x" * 300] * 5 + [None] * 50
    facts = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, tok string").repartition(5)
    known = sorted({w for w in words if w and w < "w5"} - {"absent"} | {"the", "x" * 300})
    table = spark.createDataFrame([(w, j) for j, w in enumerate(known)], "tok string, id int")
    want = sorted(facts.join(table, "tok", how).select("i", "tok", "id").collect(), key=str)
    for limit in (0, 10**9):
        got = lookup(facts, table, ["tok"], how=how, limit=limit)
        assert got.columns == ["tok", "i", "id"]
        assert sorted(got.select("i", "tok", "id").collect(), key=str) == want
    two = lookup(facts.withColumn("k", F.lit(1)), table.withColumn("k", F.lit(1)), ["tok", "k"], how=how, limit=0)
    assert sorted(two.select("i", "tok", "id").collect(), key=str) == want
    assert lookup(facts.where("i < 0"), table, ["tok"], how=how, limit=0).collect() == []


def test_hot_absent_and_null_keys_do_not_meet_in_one_task(spark):
    """A word that a third of the facts hold and the table lacks, and null keys, spread over the shuffle partitions."""
    words = [["absent", None, f"w{i}"][i % 3] for i in range(6000)]
    facts = spark.createDataFrame([(w,) for w in words], "tok string").repartition(16)
    table = spark.createDataFrame([(f"w{i}", i) for i in range(6000)], "tok string, id int")
    hashed = spark.createDataFrame([("absent",)], "tok string").select(F.xxhash64("tok")).first()[0]
    assert hot_keys(facts, ["tok"]) == [hashed]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for key, value in zip(before, ("false", "-1", "16")):
        spark.conf.set(key, value)
    try:
        joined = lookup(facts, table, ["tok"], limit=0)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.expr("count_if(tok = 'absent')").alias("hot"), F.expr("count_if(tok IS NULL)").alias("none"))
        rows = parts.collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(r["hot"] for r in rows) == sum(r["none"] for r in rows) == 2000
    assert max(r["hot"] for r in rows) < 700 and max(r["none"] for r in rows) < 700


def test_one_user_with_all_events(spark):
    """Runs by row number: a group of any size spreads over windows, ties go by the last order column."""
    rows = [(1, i // 4, i, f"v{i}") for i in range(1000)] + [(2, 7, 5000, "only")]
    df = spark.createDataFrame(rows, "g int, at int, id int, v string").repartition(8)
    placed = dense_index(df, "g", "at", "id")
    got = following(placed, "g", F.floor(F.col("row_index") / 50), ["row_index"], "v", first="opens").orderBy("row_index").collect()
    assert [r["next"] for r in got] == [f"v{i}" for i in range(1, 1000)] + [None, None]
    assert [r["id"] for r in got if r["opens"]] == [0, 5000]


def test_batches(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(6)) for i in range(150)]
    batches = batching.length_batches(spark.createDataFrame(rows, "line_id long, n int"), "n", ["line_id"], 64)
    got = batches.orderBy("row_index").collect()
    assert [r["line_id"] for r in got] == [i for i, n in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r["batch_id"] for r in got] == [i // 64 for i in range(150)]
    progress = batching.batch_progress(batches).orderBy("batch_id").collect()
    assert [(r["n"], r["done"]) for r in progress] == [(64, 64), (64, 128), (22, 150)]


@pytest.mark.parametrize("n, size, want", [(10, 4, 12), (8, 4, 8), (3, 5, 5)])
def test_fill(spark, n, size, want):
    filled = batching.fill_last_batch(dense_index(spark.range(n), "id"), size).orderBy("row_index").collect()
    assert [r["row_index"] for r in filled] == list(range(want))
    assert [r["id"] for r in filled] == [i % n for i in range(want)]


def test_seeded_order(spark):
    rows = spark.range(40)
    first, again, other = (
        [r["id"] for r in batching.seeded_order(rows, "id", 1, epoch).orderBy("place").collect()] for epoch in (1, 1, 2)
    )
    assert first == again != other
    assert sorted(first) == list(range(40))
