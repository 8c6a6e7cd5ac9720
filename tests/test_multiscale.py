"""Several k and levels at once equal one k and one level at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgrid.operators import accuracy, impute
from mossgrid.plans import diagnostics

STATS = ["gmfr_a", "gmfr_b", "ac", "ac_sys", "ac_uns", "ks_max", "ks_mean"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    n = 60
    o = spark.createDataFrame([(i, float(rng.normal()), float(rng.gamma(2)), None if i % 9 == 0 else 1.0 * i) for i in range(n)], "id long, a double, b double, holes double")
    near = [(i, q, r, int(rng.integers(0, n)), 0.0 if r == 1 and i % 7 == 0 else float(r) * 0.3 + q) for i in range(n) for q in (1, 2) for r in range(1, 6)]
    near = spark.createDataFrame(near, "id long, pixel_number int, rank int, neighbor_id long, distance double")
    hexes = spark.createDataFrame([(i, i % 6, None if i % 5 == 0 else f"h{i % 3}") for i in range(n - 4)], "id long, HEX_A long, HEX_B string")
    cross = spark.createDataFrame([(i, i // 6) for i in range(n)], "id long, loc_id long")
    return {"observed": o.cache(), "neighbors": near.cache(), "hex": hexes.cache(), "crosswalk": cross.cache()}


def one_at_a_time(c, names):
    out = {}
    for k in c.k_values:
        weights = c.k_weights.get(k, c.weights if k == c.k else "INVERSE_DISTANCES")
        predicted = impute.predict(c.tables["neighbors"], c.tables["observed"], names, k, weights, c.tables.get("crosswalk")).fillna(0.0)
        pairs = accuracy.long_pairs(c.tables["observed"], predicted, "id", names)
        levels = [("plot", pairs.select("variable", "observed", "predicted"))]
        for level, least in c.hex_levels.items():
            sums = pairs.join(c.tables["hex"].select("id", F.col(level).alias("hex")), "id").groupBy("hex", "variable").agg(F.avg("observed").alias("mo"), F.avg("predicted").alias("mp"), F.stddev_pop("observed").alias("so"), F.stddev_pop("predicted").alias("sp"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
            levels += [(f"{level}_MEAN", sums.select("variable", F.col("mo").alias("observed"), F.col("mp").alias("predicted"))), (f"{level}_STD", sums.select("variable", F.col("so").alias("observed"), F.col("sp").alias("predicted")))]
        for level, table in levels:
            both = accuracy.agreement(table, "variable", "observed", "predicted").join(accuracy.ks(table, "variable", "observed", "predicted"), "variable")
            out |= {(level, k, r["variable"], s.upper()): r[s] for r in both.collect() for s in STATS}
    return out


@pytest.mark.parametrize("crosswalk", [False, True])
def test_equals_one_at_a_time(tables, crosswalk):
    own = tables if crosswalk else {k: v for k, v in tables.items() if k != "crosswalk"}
    c = diagnostics.Context(own, ["a", "b"], k=3, weights="EQUAL", k_values=[1, 3, 4], k_weights={4: [4.0, 2.0, 1.0, 1.0]}, hex_levels={"HEX_A": 3, "HEX_B": 10})
    got = {(r["level"], r["k"], r["variable"], r["statistic"]): r["value"] for r in diagnostics.multiscale(c)["multiscale_accuracy"].collect()}
    want = one_at_a_time(c, ["a", "b"])
    assert got.keys() == want.keys() and len(got) == 3 * 5 * 2 * 7
    for key, value in want.items():
        assert got[key] == (value if value is None else pytest.approx(value, rel=1e-9, abs=1e-12)), key


def test_each_k_equals_predict(tables):
    weights = {1: "EQUAL", 2: "INVERSE_DISTANCES", 5: [5.0, 4.0, 3.0, 2.0, 1.0]}
    got = {(r["id"], r["k"]): r for r in impute.predict_each_k(tables["neighbors"], tables["observed"], ["a", "holes"], weights, tables["crosswalk"]).collect()}
    for k, w in weights.items():
        for r in impute.predict(tables["neighbors"], tables["observed"], ["a", "holes"], k, w, tables["crosswalk"]).collect():
            for name in ("a", "holes"):
                assert got[r["id"], k][name] == (None if r[name] is None else pytest.approx(r[name])), (r["id"], k)
    assert len(got) == 180
    with pytest.raises(ValueError):
        impute.predict_each_k(tables["neighbors"], tables["observed"], ["a"], {3: [1.0]})


def test_without_hexes_or_rows(tables):
    c = diagnostics.Context(tables, ["a"], k_values=[2])
    assert diagnostics.multiscale(c)["multiscale_accuracy"].count() == 7
    c = diagnostics.Context(tables | {"observed": tables["observed"].limit(0)}, ["a"], k_values=[2], hex_levels={"HEX_A": 1})
    assert diagnostics.multiscale(c)["multiscale_accuracy"].count() == 0


def test_neighbors_are_joined_once(tables):
    c = diagnostics.Context(tables, ["a", "b"], k_values=[1, 2, 3, 4], hex_levels={"HEX_A": 3, "HEX_B": 3})
    each = impute.predict_each_k(tables["neighbors"], tables["observed"], ["a", "b"], {k: "EQUAL" for k in c.k_values})
    plan = each._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("Window ") == 1
