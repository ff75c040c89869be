"""Order statistics, running sums and row numbers against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import entity, features, order, profile
from gaugeflow.plans import pipelines


def grouped(spark, n, seed):
    random.seed(seed)
    rows = []
    for _ in range(n):
        key = random.choice(["a", "a", "a", "b", None, "tiny"] if random.random() < 0.02 else ["a", "a", "b", None])
        rows.append((key, random.choice([None, float(random.randint(0, 9)), random.gauss(0, 1), random.random() * 1e6])))
    return rows, spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize(("n", "margin"), [(3, None), (40, None), (3000, None), (3000, 0.0), (60_000, None)])
def test_percentiles(spark, monkeypatch, n, margin):
    if margin is not None:
        monkeypatch.setattr(order, "MARGIN", margin)
    rows, df = grouped(spark, n, n)
    shares = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    out = {r.k: (r._n, r._q) for r in order.percentiles(df.repartition(5), ["k"], "v", shares).collect()}
    for k in {k for k, v in rows if v is not None}:
        values = [v for key, v in rows if key == k and v is not None]
        assert out[k][0] == len(values) and np.allclose(out[k][1], np.quantile(values, shares), rtol=1e-12, atol=1e-9)
    assert set(out) == {k for k, v in rows if v is not None}
    whole = order.percentiles(df, [], "v", [0.5]).collect()
    assert np.isclose(whole[0]._q[0], np.median([v for _, v in rows if v is not None]))


def test_a_place_outside_the_bracket_is_an_error(spark, monkeypatch):
    """Never a wrong value: a sketch that is off is found out."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="bracket"):
        order.order_statistics(df, [], "v", [(0.5, [lambda n: F.floor(n * 0.9)])]).collect()


def test_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert order.percentiles(none, ["k"], "v", [0.5]).count() == 0 and order.percentiles(none, [], "v", [0.5]).count() == 0
    nulls = spark.createDataFrame([("a", None)], "k string, v double")
    assert order.percentiles(nulls, ["k"], "v", [0.5]).count() == 0
    assert features.winsorize(nulls, ["v"]).collect()[0].v is None and features.quantile_bins(nulls, "v").collect()[0].v_bin is None
    assert profile.describe_by(nulls, ["k"], "v").collect()[0].p25 is None


def test_running_and_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("i"), F.lit(2).alias("w"))
    out = order.running(df, ["i"], F.col("w") * F.col("i"), "before").collect()
    assert all(r.before == r.i * (r.i - 1) for r in out) and len(out) == 1000
    assert all(r.i == r.place for r in order.numbered(df, ["i"], "place").collect())
    split = features.ordered_split(df, ["i"], 0.8)
    assert {r.split: r.n for r in split.groupBy("split").agg(F.count("*").alias("n"), F.max("i").alias("m")).collect()} == {"train": 800, "test": 200}
    assert split.where("split = 'train'").agg(F.max("i")).first()[0] == 799


def test_best_by_takes_the_first_name(spark):
    df = spark.createDataFrame([("t", m, 0.5) for m in "hgfedcba"] + [("t", "z", 0.4), ("t", "y", None), ("u", "b", float("nan")), ("u", "a", -1.0)], "target string, model string, r2 double")
    assert sorted(tuple(r) for r in features.best_by(df, ["target"], "model", "r2").collect()) == [("t", "a", 0.5), ("u", "a", -1.0)]


def test_predicates_keep_literals(spark):
    df = spark.createDataFrame([(1, "A & B"), (2, "A"), (3, "x == y | z")], "i int, n string")
    ids = lambda p: [r.i for r in pipelines.query(df, p).orderBy("i").collect()]
    assert ids("n == 'A & B'") == [1] and ids("n == 'x == y | z' | i == 2") == [2, 3] and ids("~(i == 2) & i != 3") == [1]
    assert pipelines.sql_predicate("a <= 1 && b >= 2 || c <> 3") == "a <= 1  AND  b >= 2  OR  c <> 3"


def test_grid_registry_of_a_long_chain(spark):
    df = spark.range(300).select("id", F.lit("Ghat").alias("name"), (20 + F.col("id") * 0.005).alias("lat"), F.lit(80.0).alias("lon"))
    assert {r.canonical_id for r in entity.grid_registry(df).collect()} == {0}
