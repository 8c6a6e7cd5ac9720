import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgrid.operators import accuracy, binning, ordering


def shapes(n=6000):
    rng = np.random.default_rng(1)
    return {
        "log-normal": np.round(rng.lognormal(0, 3, n), 4),
        "zeros": np.where(rng.random(n) < 0.9, 0.0, np.round(rng.normal(0, 100, n), 4)),
        "signs": rng.integers(-3, 4, n).astype(float),
    }


@pytest.fixture(scope="module")
def both(spark):
    rows = [(k, float(v), float(i % 17)) for k, x in shapes().items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, v double, w double").repartition(5).cache()


def test_parts_are_even(both):
    counts = both.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = ordering.parted(counts, ["k"], "v").groupBy("k", "_part").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    for name, x in shapes().items():
        own = sorted((r["_part"], r["m"], r["lo"], r["hi"]) for r in parts.where(F.col("k") == name).collect())
        kinds = len(np.unique(x))
        assert sum(m for _, m, _, _ in own) == kinds
        assert max(m for _, m, _, _ in own) <= 2 * max(1, kinds / 64)
        assert all(a[3] < b[2] for a, b in zip(own, own[1:]))  # in order


def test_running_and_ranks(both):
    counts = both.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["k"], r["v"]): r["before"] for r in ordering.running(counts, ["k"], "v").collect()}
    ranked = accuracy.average_rank(both, ["k"], "v", "r")
    assert ranked.columns[:2] == ["k", "v"] and ranked.count() == both.count()
    ranks = {(r["k"], r["v"]): r["r"] for r in ranked.select("k", "v", "r").distinct().collect()}
    for name, x in shapes().items():
        values, n = np.unique(x, return_counts=True)
        start = np.cumsum(n) - n
        for v, a, m in zip(values, start, n):
            assert got[name, v] == a and ranks[name, v] == a + (m + 1) / 2


def test_quantiles_of_skewed_values(spark):
    for x in shapes().values():
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        q = [0, 0.01, 0.3, 0.5, 0.91, 0.99, 1]
        np.testing.assert_allclose(binning.weighted_quantiles(binning.value_counts(df, "v"), q), np.quantile(x, q))


def test_common_values_are_spread(both):
    counts = both.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    table = counts.withColumn("t", F.col("n") * 2).drop("n")
    got = ordering.with_common_spread(both, table, counts, ["k"], "v")
    assert got.count() == both.count() and got.where("v = 0 and k = 'zeros'").select("t").distinct().count() == 1


def test_spearman(spark):
    rng = np.random.default_rng(3)
    o, p = np.where(rng.random(900) < 0.7, 0, rng.integers(0, 40, 900)).astype(float), np.where(rng.random(900) < 0.7, 0, rng.integers(0, 40, 900)).astype(float)
    p[:300] = o[:300]
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    rows = [("a", float(a), float(b)) for a, b in zip(o, p)] + [("zero", 0.0, float(b)) for b in p] + [("same", 2.0, float(b)) for b in p] + [("a", None, 3.0), ("a", 3.0, None)]
    got = {r["k"]: r["spearman_r"] for r in accuracy.spearman(spark.createDataFrame(rows, "k string, observed double, predicted double"), ["k"]).collect()}
    assert got["a"] == pytest.approx(np.corrcoef(rank(o), rank(p))[0, 1], abs=1e-12) and got["zero"] == 0 and got["same"] is None
    assert accuracy.spearman(spark.createDataFrame([], "k string, observed double, predicted double"), ["k"]).count() == 0
