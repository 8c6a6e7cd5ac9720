import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgrid.functions.labels import natural_key
from mossgrid.operators import binning
from mossgrid.plans import diagnostics
from mossgrid.sources import tables


def test_systematic_sample(spark):
    values = sorted((k * 37) % 101 / 2 for k in range(250))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted(r["v"] for r in binning.systematic_sample(df, "v", 40).collect())
    step = 250 // 40
    want = values[::step] + ([values[-1]] if (len(values) - 1) % step else [])
    assert got == sorted(want)
    assert sorted(r["v"] for r in binning.systematic_sample(df, "v", 1000).collect()) == values
    assert binning.systematic_sample(df.limit(0), "v", 10).count() == 0
    assert binning.unique_values(df, "v").count() == len(set(values))


def test_natural_key(spark):
    df = spark.createDataFrame([(x,) for x in ("b10", "b9", "a2", "b", "a10")], "s string")
    assert [r["s"] for r in df.orderBy(natural_key(F.col("s"))).collect()] == ["a2", "a10", "b", "b9", "b10"]


def test_domain_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("NAME,Y,X\na,2,1\n")
    assert tuple(tables.domain_points(spark, path=f"file://{tmp_path}/p.csv").first()) == (1.0, 2.0)
    assert tables.domain_points(spark, [(3, 4)]).count() == 1
    with pytest.raises(ValueError):
        tables.domain_points(spark)


def test_natural_edges_of_many_values(spark):
    values = [float(k) / 7 for k in range(3000)] + [100.0] * 4000 + [300.0 + k / 9 for k in range(50)] * 90
    df = spark.createDataFrame([(v,) for v in values], "v double")
    own, n = np.unique(values, return_counts=True)
    want = binning.jenks(own, n.astype(float), 5)

    def within(edges):
        at = np.searchsorted(np.array(edges[1:]), np.array(values))
        return sum(((np.array(values)[at == k] - np.array(values)[at == k].mean()) ** 2).sum() for k in set(at.tolist()))

    got = binning.natural_edges(df, "v", 5)
    assert within(got) == pytest.approx(within(want), rel=1e-9) and got[0] == want[0] and got[-1] == want[-1]
    assert within(binning.natural_edges(df, "v", 5, exact=1000)) == pytest.approx(within(want), rel=0.01)


def test_regional_natural_breaks_use_both_sides(spark):
    area = spark.createDataFrame([(k, float(k), 1.0) for k in range(1, 30)] + [(-10001, None, 5.0), (-10002, None, 7.0)], "id long, a double, HECTARES double")
    plots = area.where("id > 0").select("id", "a")
    raster = spark.createDataFrame([("a", 1000.0 + k, 1.0) for k in range(30)], "variable string, value double, area double")
    c = diagnostics.Context({"observed": plots, "independent": plots, "area": area, "raster": raster}, ["a"], bins=2, bin_method="NATURAL_BREAKS")
    got = diagnostics.regional(c)["regional_accuracy"].where("bin > 0").collect()
    assert {(r["dataset"], r["bin"]): r["area"] for r in got if r["area"]} == {("OBSERVED", 1): 28.0, ("OBSERVED", 2): 1.0, ("PREDICTED", 2): 30.0}  # an edge begins the next bin


def test_conventions_at_zero(spark):
    from pyspark.sql import functions as F

    from mossgrid.operators import accuracy

    pairs = spark.createDataFrame([("zero", 0.0, 1.0), ("zero", 0.0, 2.0), ("zero", 0.0, 4.0), ("some", 1.0, 2.0), ("some", 2.0, 3.0), ("some", 3.0, 5.0), ("never", 1.0, 0.0), ("never", 2.0, 0.0), ("never", 0.0, 0.0)], "variable string, observed double, predicted double")
    got = {r["variable"]: r for r in accuracy.local_accuracy(pairs).collect()}
    assert got["zero"]["pearson_r"] == 0 and got["zero"]["spearman_r"] == 0 and got["never"]["spearman_r"] == 0
    assert round(got["some"]["spearman_r"], 9) == 1
    power = {r["variable"]: r["positive_predictive_power"] for r in accuracy.species_accuracy(pairs, "variable", "observed", "predicted").select("variable", F.col("positive_predictive_power")).collect()}
    assert power == {"zero": 0.0, "some": 1.0, "never": 1.0}


def test_bin_names_at_zero():
    from mossgrid.operators import binning

    assert binning.labels([0, 5e4, 1e5]) == ["0.0-5.0e4", "5.0e4-1.0e5"]
    assert binning.labels([-0.01, 0.0, 2]) == ["0.0-0.0", "0.0-2.0"]


def test_raster_pixels_that_lack_a_neighbor(spark):
    from mossgrid.operators import impute

    pixels = spark.createDataFrame([(0, 0, 1, 7), (0, 0, 2, 7), (0, 1, 1, 7), (0, 2, 1, 7), (0, 2, 2, None)], "row int, col int, rank int, neighbor_id long")
    mask = spark.createDataFrame([(0, 0, True), (0, 1, True), (0, 2, True), (0, 3, False)], "row int, col int, forest boolean")
    values = spark.createDataFrame([(7, 10.0)], "id long, value double")
    got = {r["col"]: r["value"] for r in impute.attribute_raster(pixels, values, mask, [0.5, 0.5]).collect()}
    assert got == {0: 10, 1: -32768, 2: -32768, 3: -1}


def test_bins_from_a_file(spark, tmp_path):
    from mossgrid.plans import diagnostics
    from mossgrid.sources import tables

    o = spark.createDataFrame([(k, float(k)) for k in range(20)], "id long, a double")
    c = diagnostics.Context({"observed": o, "independent": o}, ["a"], bins=3)
    first = diagnostics.error_matrices(c)
    tables.write_bins(first["bins"], f"file://{tmp_path}/bins")
    c.given_bins = tables.read_bins(spark, f"file://{tmp_path}/bins")
    assert len(c.given_bins["a"]) == 4
    assert sorted(map(tuple, diagnostics.error_matrices(c)["error_matrix"].collect())) == sorted(map(tuple, first["error_matrix"].collect()))


def test_classes_without_plots(spark):
    from mossgrid.operators import classify
    from mossgrid.plans import diagnostics

    pairs = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 2)], "id long, observed int, predicted int")
    out = diagnostics.class_accuracy(pairs, classify.fuzzy_table(spark))
    assert out["class_matrix"].count() == 121 and out["kappa_by_class"].count() == 11
    assert out["class_matrix"].agg({"n": "sum"}).first()[0] == 3
