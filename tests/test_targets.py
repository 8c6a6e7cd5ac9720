"""New targets, requested ids, and predictions of all groups at once."""

import csv
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgrid.operators import impute, neighbors
from mossgrid.plans import commands
from mossgrid.sources import small_files, tables


@pytest.fixture(scope="module")
def near(spark):
    rng = np.random.default_rng(3)
    x = spark.createDataFrame([(i, p, [float(v) for v in rng.normal(size=3)]) for i in range(20) for p in (1, 2, 3)], "id long, pixel_number int, scores array<double>")
    ref = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(20)], "id long, scores array<double>")
    return neighbors.knn(x, ref, 9).cache()


@pytest.fixture(scope="module")
def attrs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), float(rng.normal()), int(rng.integers(0, 3)), float(rng.integers(0, 2)), None if i % 4 else 5.0) for i in range(20)]
    return spark.createDataFrame(rows, "id long, rank double, b double, code int, spp double, holes double")


@pytest.mark.parametrize("independent", [False, True])
@pytest.mark.parametrize("weights", ["INVERSE_DISTANCES", "EQUAL", [3.0, 2.0, 1.0, 1.0]])
def test_all_groups_equal_single_ones(spark, near, attrs, independent, weights):
    cross = attrs.select("id", F.floor(F.col("id") / 5).alias("loc_id")) if independent else None
    got = impute.predict_all(near, attrs, 4, weights, ["rank", "b", "holes"], ["code"], ["spp"], cross)
    one = impute.predict(near, attrs, ["rank", "b", "holes"], 4, weights, cross)
    want = one.join(impute.predict_categorical(near, attrs, ["code"], cross), "id", "left").join(impute.predict(near, attrs, ["spp"], 1, "EQUAL", cross), "id", "left")
    a, b = ({r["id"]: r.asDict() for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) == 20
    for i in a:
        for c in ("rank", "b", "code", "spp", "holes"):
            assert a[i][c] == (b[i][c] if b[i][c] is None else pytest.approx(b[i][c])), (i, c)


def test_all_groups_without_neighbors(spark, near, attrs):
    got = impute.predict_all(near.where("id < 3 and neighbor_id = id"), attrs, 2, "EQUAL", ["b"], ["code"], ["spp"], attrs.select("id", F.lit(1).alias("loc_id"))).collect()
    assert all(r["b"] is None and r["code"] is None and r["spp"] is None for r in got)
    assert impute.predict_all(near.limit(0), attrs, 2, "EQUAL", ["b"], ["code"], ["spp"]).count() == 0


def test_requested_ids_keep_order_and_repeats(spark, tmp_path):
    path = tmp_path / "wanted.csv"
    wanted = [7, 3, 7, 99, 1, 3, 7]
    path.write_text("FCID,other\n" + "".join(f"{i},x\n" for i in wanted))
    listed = tables.positioned(tables.read_table(spark, str(path), "FCID long, other string", ["FCID"]), "FCID")
    df = spark.createDataFrame([(i, p, float(i * p)) for i in range(10) for p in (1, 2)], "FCID long, pixel int, v double")
    got = tables.requested(df, listed, "FCID").orderBy("place", "pixel").collect()
    assert [(r["FCID"], r["pixel"]) for r in got] == [(i, p) for i in wanted if i < 10 for p in (1, 2)]
    assert tables.requested(df, listed.limit(0), "FCID").count() == 0


def test_new_targets(spark, tmp_path):
    rng = np.random.default_rng(9)
    n = 30
    env = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(n)], "FCID long, v0 double, v1 double")
    spp = spark.createDataFrame([(i, *(float(rng.integers(1, 9)) for _ in range(3))) for i in range(n)], "FCID long, a double, b double, c double")
    p = small_files.from_dict({"ordination": {"variables": ["v0", "v1"]}, "imputation": {"k": 3, "axes": 2, "max_neighbors": 12}})
    model = commands.build_model(p, spp, env)
    attrs = spp.withColumnRenamed("FCID", "id").withColumn("code", (F.col("id") % 3).cast("int"))
    cross = attrs.select("id", F.floor(F.col("id") / 3).alias("loc_id"))
    targets = spark.createDataFrame([(4, 0), (2, 1), (4, 2), (11, 3)], "id long, place long")
    t = commands.new_targets(p, model, env.withColumn("id", F.col("FCID")), targets, attrs, ["a"], cross, ["code"], ["c"])
    assert set(t) == {"neighbors", "independent", "dependent", "zonal_independent", "zonal_dependent", "predicted"}
    assert [r["id"] for r in t["independent"].orderBy("place").collect()] == [4, 2, 11]
    assert t["zonal_dependent"].where("neighbor = 1 and id = neighbor_id").count() == 3
    locs = {r["id"]: r["loc_id"] for r in cross.collect()}
    assert all(locs[r["id"]] != locs[r["neighbor_id"]] for r in t["zonal_independent"].collect()) and t["zonal_independent"].count() == 9
    own = {r["id"]: r for r in attrs.collect()}
    near = {}
    for r in t["zonal_independent"].collect():
        near.setdefault(r["id"], []).append((r["neighbor"], r["neighbor_id"], r["distance"]))
    for r in t["independent"].collect():
        best = sorted(near[r["id"]])
        w = np.array([1 / x[2] for x in best])
        assert r["a"] == pytest.approx((w / w.sum()) @ [own[x[1]]["a"] for x in best])
        assert r["code"] == own[best[0][1]]["code"] and r["c"] == own[best[0][1]]["c"]
    commands.write_new_targets(t, str(tmp_path / "prd"), str(tmp_path / "zonal"))
    for name, count in (("prd_independent", 3), ("prd_dependent", 3), ("zonal_pixel_independent", 9), ("zonal_pixel_dependent", 9)):
        rows = [r for f in sorted(glob.glob(f"{tmp_path}/{name}.csv/part*")) for r in csv.DictReader(open(f))]
        assert len(rows) == count, name
        if name.startswith("prd"):
            assert [r["FCID"] for r in rows] == ["4", "2", "11"] and set(rows[0]) == {"FCID", "a", "code", "c"}
        else:
            assert set(rows[0]) == {"FCID", "PIXEL_NUMBER", "NEIGHBOR", "NEIGHBOR_ID", "DISTANCE"}
    t["neighbors"].unpersist()
    alone = commands.new_targets(p, model, env.withColumn("id", F.col("FCID")), targets.select("id"), attrs, ["a"])
    assert "independent" not in alone and alone["dependent"].count() == 3
