import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import scores
from seqloom.operators import attention, metrics
from seqloom.operators.softmax import group_softmax


@pytest.mark.parametrize(
    "targets, normalize, loss",
    [([0, 1], True, 0.490415), ([0, -1], True, 0.693147), ([0, -1], False, 0.346574), ([-1, -1], True, 0.0)],
)
def test_cross_entropy(spark, targets, normalize, loss):
    rows = [([0.5, 0.5], targets[0]), ([0.25, 0.75], targets[1])]
    df = spark.createDataFrame(rows, "p array<double>, t int")
    assert metrics.cross_entropy(df, [], "p", "t", normalize).first()["loss"] == pytest.approx(loss, abs=1e-6)


@pytest.mark.parametrize("target", [-2, 3])
def test_target_out_of_range(spark, target):
    df = spark.createDataFrame([(target,)], "t int")
    with pytest.raises(Exception, match="out of range"):
        df.select(metrics.checked_target(F.col("t"), 2)).collect()


def test_loss_of_softmax(spark):
    rng = random.Random(1)
    rows = [([rng.uniform(-5, 5) for _ in range(4)], rng.randrange(4)) for _ in range(25)]
    df = spark.createDataFrame(rows, "x array<double>, t int").withColumn("p", scores.softmax(F.col("x")))
    want = sum(math.log(sum(map(math.exp, x))) - x[t] for x, t in rows) / len(rows)
    assert metrics.cross_entropy(df, [], "p", "t").first()["loss"] == pytest.approx(want, abs=1e-9)
    assert all(abs(sum(r["p"]) - 1) < 1e-12 for r in df.collect())


def test_softmax_of_large_scores(spark):
    p = spark.range(1).select(scores.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p")).first()["p"]
    assert p == [0.5, 0.5]


@pytest.mark.parametrize("w, x, y, want", [(0.0, 0.2, 0.6, 0.4), (1.5, 0.2, 0.6, 0.272970)])
def test_interpolation(spark, w, x, y, want):
    got = spark.range(1).select(scores.interpolate(F.lit(w), F.lit(x), F.lit(y)).alias("v")).first()["v"]
    assert got == pytest.approx(want, abs=1e-6)


def test_argmax_and_top_k(spark):
    a = F.array(*[F.lit(v) for v in (1.0, 3.0, 3.0, 2.0)])
    row = spark.range(1).select(scores.argmax(a).alias("m"), scores.top_k(a, 3).alias("t"), scores.top_k(a, 9).alias("all")).first()
    assert (row["m"], row["t"], len(row["all"])) == (1, [1, 2, 3], 4)


def test_nan(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan")]), (0, [2.0])], "g int, a array<double>")
    row = metrics.nan_counts(df, ["g"], "a").first()
    assert (row["n_values"], row["n_nan"]) == (3, 1)
    with pytest.raises(Exception, match="loss is not a number"):
        df.select(metrics.guard_nan(F.explode("a"), "loss is not a number")).collect()


def test_group_softmax_and_pool(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, g int, v array<double>")
    soft = group_softmax(df.withColumn("s", F.col("v")[0]), ["g"], "s", "p")
    for r in soft.groupBy("g").agg(F.sum("p").alias("one")).collect():
        assert r["one"] == pytest.approx(1)
    got = {r["g"]: r["pooled"] for r in attention.pool(attention.attend(df, "g", "k", "v"), "g", "v", 5).collect()}
    for g in range(3):
        members = [v for _, gg, v in rows if gg == g]
        e = [math.exp(sum(a * b for a, b in zip(members[0], m))) for m in members]
        want = [sum(w * m[d] for w, m in zip(e, members)) / sum(e) for d in range(5)]
        assert got[g] == pytest.approx(want)


def test_accuracy(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 1, 2), ("y", 3, 3)], "g string, p int, r int")
    assert {r["g"]: r["accuracy"] for r in metrics.accuracy(df, ["g"], "p", "r").collect()} == {"x": 0.5, "y": 1.0}
