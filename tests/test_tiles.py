import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgrid.operators import impute, rasters, tiles

GEOMETRY = rasters.Geometry(0.0, 0.0, 1.0)
PRINTS = [rasters.Footprint("f", ((1, 1, 1), (1, 2, 1), (0, 1, 1)), 1.0), rasters.Footprint("g", ((2,),), 1.0), rasters.Footprint("h", tuple(tuple(2 if (r, c) == (4, 2) else 1 for c in range(9)) for r in range(9)), 1.0)]


@pytest.fixture(scope="module")
def stack(spark):
    rng = np.random.default_rng(1)
    rows = [(r, c, float(rng.normal()), float(rng.normal()) if rng.random() < 0.9 else None) for r in range(-3, 40) for c in range(50) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "row int, col int, a double, b double").repartition(4).cache()


@pytest.fixture(scope="module")
def plots(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 150, float(rng.random() * 52 - 1), float(-rng.random() * 42 + 2), "fgh"[k % 3]) for k in range(200)]
    rows += [(k, 10.5, -10.5, "f") for k in range(1000, 1040)]  # many at one place
    rows += [(7, None, -3.0, "f"), (8, 3.0, -3.0, None), (9, 3.0, -3.0, "no")]
    return spark.createDataFrame(rows, "id long, x double, y double, key string").repartition(3).cache()


@pytest.mark.parametrize("tile,pack", [(64, 256), (8, 256), (8, 3), (1, 2)])
@pytest.mark.parametrize("use_kernel", [False, True])
def test_equals_the_join_by_cells(spark, stack, plots, monkeypatch, tile, pack, use_kernel):
    monkeypatch.setattr(tiles, "PACK", pack)
    got = tiles.extract(plots, tiles.to_tiles(stack, ["a", "b"], tile), ["a", "b"], PRINTS, GEOMETRY, use_kernel, tile)
    pixels = rasters.plot_pixels(plots.dropna(subset=["x", "y"]), rasters.footprint_table(spark, PRINTS, use_kernel), GEOMETRY)
    want = rasters.extract(pixels, stack, ["a", "b"]).select(got.columns)
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert len(a) > 1000 and a == b


def test_tiles_round_trip(stack):
    back = tiles.from_tiles(tiles.to_tiles(stack, ["a", "b"], 16), ["a", "b"], 16)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, stack.collect()), key=repr)
    twice = tiles.to_tiles(stack.unionByName(stack.withColumn("a", F.col("a") - 1)), ["a", "b"], 16)
    assert sorted(map(tuple, tiles.from_tiles(twice, ["a", "b"], 16).collect()), key=repr) == sorted(map(tuple, stack.collect()), key=repr)
    assert tiles.to_tiles(stack.limit(0), ["a"]).count() == 0


def test_by_year_equals_the_join_by_cells(spark, stack, plots):
    years = plots.select("id", (2000 + F.col("id") % 3).cast("int").alias("year")).distinct()
    dated = stack.withColumn("year", F.explode(F.array(F.lit(2000), F.lit(2001), F.lit(None)))).withColumn("a", F.col("a") + F.coalesce(F.col("year"), F.lit(0)))
    cut = tiles.to_tiles(dated, ["a", "b"], 16, "year")
    got = tiles.extract_by_year(plots.join(years, "id"), cut, ["a", "b"], PRINTS, GEOMETRY, tile=16)
    pixels = rasters.plot_pixels(plots.dropna(subset=["x", "y"]), rasters.footprint_table(spark, PRINTS), GEOMETRY)
    want = rasters.extract_by_year(pixels, years, dated, ["a", "b"]).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 1000


def test_shuffle_is_by_tile(spark, stack, plots):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tiles.extract(plots, tiles.to_tiles(stack, ["a"], 16), ["a"], PRINTS, GEOMETRY, tile=16)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [x for x in plan.splitlines() if " Exchange hashpartitioning" in x or "- Exchange hashpartitioning" in x]
    assert len(shuffles) == 2 and all("hashpartitioning(tile_row" in x for x in shuffles)


def test_bucketed_rasters_join_without_exchange(spark, stack, tmp_path):
    a, b = (stack.select("row", "col", F.col(v).alias("value")).dropna() for v in ("a", "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = {n: tiles.save_bucketed(df, f"raster_{n}", 4, str(tmp_path / n)) for n, df in (("a", a), ("b", b))}
        both = rasters.aligned(kept)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        want = rasters.aligned({"a": a, "b": b})
        assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect())) and both.count() > 1000
        near = stack.select("row", "col", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).withColumn("neighbor_id", (F.col("row") * F.col("rank") % 5 + 5).cast("long"))
        mask = stack.select("row", "col", (F.col("col") % 3 != 0).alias("forest"))
        values = spark.createDataFrame([(k, float(k)) for k in range(12)], "id long, value double")
        kept_near, kept_mask = tiles.save_bucketed(near, "raster_near", 4, str(tmp_path / "near")), tiles.save_bucketed(mask, "raster_mask", 4, str(tmp_path / "mask"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        out = impute.attribute_raster(kept_near, F.broadcast(values), kept_mask, [2.0, 1.0])
        shown = out._jdf.queryExecution().executedPlan().toString()
        assert shown.replace("BroadcastExchange", "").count("Exchange") == 0
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, impute.attribute_raster(near, values, mask, [2.0, 1.0]).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("a", "b", "near", "mask"):
            spark.sql(f"DROP TABLE IF EXISTS raster_{n}")


def test_other_raster_functions(spark, stack):
    """Alignment keeps what all have; bands part the rows for writing."""
    a, b = (stack.select("row", "col", F.col(v).alias("value")).dropna() for v in ("a", "b"))
    assert rasters.aligned({"a": a, "b": b}).count() == stack.dropna().count()
    banded = rasters.by_row_band(a, 8)
    parts = banded.withColumn("p", F.spark_partition_id()).groupBy("band").agg(F.count_distinct("p").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi")).collect()
    assert all(r["n"] == 1 and r["hi"] - r["lo"] < 8 for r in parts)
