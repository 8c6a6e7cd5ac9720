import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgrid.operators import accuracy, binning, classify, impute, neighbors, rasters


def points(spark, n=60, d=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (n, d)).astype(float)  # many ties
    return x, spark.createDataFrame([(i, 1, [float(v) for v in r]) for i, r in enumerate(x)], "id long, pixel_number int, scores array<double>")


@pytest.mark.parametrize("rows", [1000, 7])
def test_knn_exact_with_ties(spark, rows):
    x, df = points(spark)
    got = {(r["id"], r["rank"]): r["neighbor_id"] for r in neighbors.knn(df, df, 5, block_rows=rows).collect()}
    for i in range(len(x)):
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        want = sorted(range(len(x)), key=lambda j: (d2[j], j != i, j))[:5]
        assert [got[i, k + 1] for k in range(5)] == want
        assert want[0] == i


def test_knn_nulls_and_empty(spark):
    _, df = points(spark, 5)
    odd = df.unionByName(spark.createDataFrame([(99, 1, None), (98, 1, [1.0, None, 2.0])], df.schema))
    assert neighbors.knn(odd, odd, 3).select("id").distinct().count() == 5
    assert neighbors.knn(df.limit(0), df, 3).count() == 0
    assert neighbors.knn(df, df.limit(0), 3).count() == 0


def test_independent_and_weights(spark):
    _, df = points(spark)
    cross = df.select("id", F.floor(F.col("id") / 4).alias("loc_id"))
    near = neighbors.knn(df, df, 20)
    left = neighbors.top_k(neighbors.independent(near, cross), 4)
    assert left.where(F.floor(F.col("id") / 4) == F.floor(F.col("neighbor_id") / 4)).count() == 0
    for w in ("INVERSE_DISTANCES", "EQUAL", [4.0, 3.0, 2.0, 1.0]):
        sums = impute.weigh(left, 4, w).groupBy("id").agg(F.sum("w").alias("s")).collect()
        assert all(r["s"] == pytest.approx(1) for r in sums)
    with pytest.raises(ValueError):
        impute.weigh(left, 4, [1.0])
    far = impute.predict(near.where("id = neighbor_id"), df.select("id", F.lit(1.0).alias("a")), ["a"], 1, crosswalk=cross)
    assert far.where("a is not null").count() == 0 and far.count() == 60


def test_majority_takes_least_on_ties(spark):
    near = spark.createDataFrame([(1, p, 1, n, 0.0) for p, n in ((1, 10), (2, 11), (3, 10), (4, 11))], "id long, pixel_number int, rank int, neighbor_id long, distance double")
    values = spark.createDataFrame([(10, 7), (11, 3)], "id long, c int")
    assert impute.predict_categorical(near, values, ["c"]).first()["c"] == 3


def test_quantile_edges_collapse(spark):
    rng = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.6, 0.9):
        v = np.where(rng.random(500) < share, 0.0, np.round(rng.random(500) * 40))
        left, bins, taken = np.sort(v), 10, []
        while True:
            if len(left) <= bins:
                want = sorted([*left, *taken])
                break
            q = np.quantile(left, np.linspace(0, 1, bins + 1)).tolist()
            twice = sorted({e for e in q if q.count(e) > 1})
            if not twice or bins <= 1:
                want = sorted(set(q) | set(taken))
                break
            taken.append(twice[0])
            left, bins = left[left != twice[0]], bins - 1
        df = spark.createDataFrame([(float(a),) for a in v], "v double")
        np.testing.assert_allclose(binning.quantile_edges(df, "v", 10), want)


def test_jenks_is_optimal():
    from itertools import combinations

    rng = np.random.default_rng(4)
    v = np.unique(rng.integers(0, 60, 12)).astype(float)
    n = rng.integers(1, 5, len(v)).astype(float)

    def cost(cuts):
        out = 0.0
        for a, b in zip((0, *cuts), (*cuts, len(v))):
            m = np.average(v[a:b], weights=n[a:b])
            out += (n[a:b] * (v[a:b] - m) ** 2).sum()
        return out

    edges = binning.jenks(v, n, 4)
    cuts = tuple(int(np.searchsorted(v, e, side="right")) for e in edges[1:-1])
    assert cost(cuts) == pytest.approx(min(cost(c) for c in combinations(range(1, len(v)), 3)))
    assert binning.jenks(np.array([1.0, 2.0]), np.array([1.0, 1.0]), 4) == [1.0, 2.0, 2.0, 2.0]


def test_digitize_and_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 2.0, 3.0, None)], "v double")
    got = [(r[0], r[1]) for r in df.select(binning.digitize(F.col("v"), [0, 1, 2]), binning.histogram_bin(F.col("v"), [0, 1, 2])).collect()]
    assert got == [(None, None), (1, 1), (2, 2), (2, 2), (None, None), (None, None)]
    assert binning.custom_edges([5]) == [5.0, 5.0]
    with pytest.raises(ValueError):
        binning.custom_edges([2, 1])
    assert binning.code_edges([3, 1, 7]) == [1.0, 3.0, 7.0, 8.0]


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(8)
    v, n = rng.random(40).round(3), rng.integers(1, 6, 40)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, n)], "value double, n long").groupBy("value").agg(F.sum("n").alias("n"))
    q = [0, 0.1, 0.37, 0.5, 0.99, 1]
    np.testing.assert_allclose(binning.weighted_quantiles(df, q), np.quantile(np.repeat(v, n), q))


def test_classes(spark):
    cases = [(0.0, 0.0, 5.0, 1), (10.0, 0.9, 20.0, 2), (10.0, 0.7, 50.0, 3), (30.0, 0.7, 50.0, 4), (10.0, 0.3, 90.0, 5), (30.0, 0.3, 90.0, 6), (60.0, 0.3, 90.0, 7), (10.0, 0.1, 90.0, 8), (40.0, 0.1, 90.0, 9), (60.0, 0.1, 90.0, 10), (80.0, 0.1, 90.0, 11), (None, 0.1, 90.0, None)]
    df = spark.createDataFrame(cases, "s double, h double, c double, want int")
    for r in df.withColumn("got", classify.vegclass(F.col("s"), F.col("h"), F.col("c"))).collect():
        assert r["got"] == r["want"]
    sets = classify.FUZZY
    assert all(c in own and all(c in sets[f] for f in own) for c, own in sets.items())
    listed = [(o, p) for own in classify.SEVERITY.values() for o, ps in own.items() for p in ps]
    assert len(listed) == len(set(listed))
    assert all(o != p for o, p in listed)


def test_kappa_on_identity_and_one_class(spark):
    same = spark.createDataFrame([(k % 3, k % 3) for k in range(30)], "observed int, predicted int")
    m = classify.error_matrix(same)
    assert classify.kappa(m).first()["kappa"] == pytest.approx(1)
    assert all(r["kappa"] == pytest.approx(1) for r in classify.kappa_by_class(m).collect())
    one = classify.error_matrix(spark.createDataFrame([(1, 1)] * 4, "observed int, predicted int"))
    assert classify.kappa(one).first()["kappa"] == 0
    assert classify.error_matrix(same.limit(0)).count() == 0


def test_adjusted_area_keeps_total(spark):
    rng = np.random.default_rng(1)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(1, 5, (200, 2))], "observed int, predicted int")
    areas = spark.createDataFrame([(k, 10.0 * k) for k in range(1, 5)], "class int, area double")
    out = classify.adjusted_area(classify.error_matrix(pairs), areas).agg(F.sum("mapped").alias("m"), F.sum("adjusted").alias("a")).first()
    assert out["m"] == pytest.approx(out["a"])


def test_accuracy_without_variation(spark):
    df = spark.createDataFrame([("v", 1.0, 2.0), ("v", 1.0, 2.0)], "variable string, observed double, predicted double")
    row = accuracy.local_accuracy(df).first()
    assert row["pearson_r"] is None and row["spearman_r"] is None and row["rmse"] == 1
    ac = accuracy.agreement(df, "variable", "observed", "predicted").first()
    assert ac["ac"] is not None
    ks = accuracy.ks(df, "variable", "observed", "predicted").first()
    assert ks["ks_max"] == pytest.approx(1)


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", x) for x in (3.0, 1.0, 3.0, 2.0)], "k string, v double")
    got = sorted((r["v"], r["r"]) for r in accuracy.average_rank(df, ["k"], "v", "r").collect())
    assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_footprints(spark):
    f = rasters.Footprint("k", ((0, 1, 0), (1, 3, 1)), 30.0)
    assert f.index == (1, 1)
    assert f.kernel() == [[0, 1, 0], [1, 3, 1]]
    assert f.coordinates(100, 100) == [(100, 130), (70, 100), (130, 100)]
    assert f.window(100, 100) == (70, 130, 3, 2)
    with pytest.raises(ValueError):
        rasters.Footprint("k", ((1, 1),), 1.0).index
    plots = spark.createDataFrame([(1, 45.0, 45.0, "k")], "id long, x double, y double, key string")
    g = rasters.Geometry(0.0, 90.0, 30.0)
    whole = rasters.plot_pixels(plots, rasters.footprint_table(spark, [f]), g)
    assert whole.count() == 6
    assert rasters.plot_pixels(plots, rasters.footprint_table(spark, [f], True), g).count() == 3
    stack = spark.createDataFrame([(0, 1, 5.0), (1, 1, None)], "row int, col int, v double")
    assert [tuple(r) for r in rasters.extract(whole, stack, ["v"]).select("row", "col", "v").collect()] == [(0, 1, 5.0)]


def test_raster_rounds_half_to_even(spark):
    near = spark.createDataFrame([(0, 0, 1, 7), (0, 1, 1, 8)], "row int, col int, rank int, neighbor_id long")
    values = spark.createDataFrame([(7, 0.5), (8, 1.5)], "id long, value double")
    mask = spark.createDataFrame([(0, 0, True), (0, 1, True), (0, 2, True), (0, 3, False)], "row int, col int, forest boolean")
    got = {r["col"]: r["value"] for r in impute.attribute_raster(near, values, mask, [1.0]).collect()}
    assert got == {0: 0, 1: 2, 2: -32768, 3: -1}
