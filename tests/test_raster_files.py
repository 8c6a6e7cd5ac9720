import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgrid.operators import rasters
from mossgrid.sources import raster_files
from mossgrid.sources.raster_files import Raster, describe, read_raster, write_raster

GEOMETRY = {"x_min": 1000.0, "y_max": 5000.0, "cell_size": 30.0}


def pixels(spark, rows=40, cols=23, bands=2, seed=1):
    rng = np.random.default_rng(seed)
    values = rng.integers(-5, 200, (bands, rows, cols)).astype(float)
    there = rng.random(values.shape) < 0.9
    out = [(int(r), int(c), int(b) + 1, float(values[b, r, c])) for b, r, c in zip(*np.nonzero(there))]
    return spark.createDataFrame(out, "row int, col int, band int, value double").repartition(5), out


def shown(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dtype", ["int16", "int32", "float32", "float64"])
def test_round_trip(spark, tmp_path, dtype):
    df, want = pixels(spark)
    path = str(tmp_path / "r")
    write_raster(df, path, Raster(40, 23, 2, dtype=dtype, block_rows=7, scalar=100.0, **GEOMETRY))
    got = read_raster(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    own = describe(path)
    assert (own.scalar, own.rows, own.x_min) == (100.0, 40, 1000.0) and [f for f, _, _ in own.files] == list(range(0, 40, 7)) and own.files[-1][1] == 5
    vrt = open(f"{path}/{raster_files.MOSAIC}").read()
    assert vrt.count("<SimpleSource>") == 2 * len(own.files) and "rasterXSize=\"23\"" in vrt


def test_only_wanted_blocks_are_read(spark, tmp_path):
    df, want = pixels(spark)
    path = str(tmp_path / "r")
    write_raster(df, path, Raster(40, 23, 2, block_rows=8, **GEOMETRY))
    assert read_raster(spark, path).rdd.getNumPartitions() == 10
    part = read_raster(spark, path, rows=(8, 17), bands=[2])
    assert part.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, part.collect())) == sorted(x for x in want if 8 <= x[0] < 17 and x[2] == 2)
    for condition, n, keep in (
        ((F.col("row") >= 8) & (F.col("row") < 17) & (F.col("band") == 2), 2, lambda x: 8 <= x[0] < 17 and x[2] == 2),
        (F.col("row").isin(1, 9) & (F.col("col") > 3), 4, lambda x: x[0] in (1, 9) and x[1] > 3),
        ((F.col("row") == 39), 2, lambda x: x[0] == 39),
        ((F.col("row") > 38) & (F.col("row") <= 39) & F.col("band").isin(1, 7), 1, lambda x: x[0] == 39 and x[2] == 1),
        ((F.col("row") > 99), 1, lambda x: False),
    ):
        own = read_raster(spark, path).where(condition)
        assert own.rdd.getNumPartitions() == n
        assert sorted(map(tuple, own.collect())) == sorted(filter(keep, want))
    # a block that is not wanted is not opened
    os.remove(f"{path}/{describe(path).files[0][2]}")
    assert read_raster(spark, path).where("row >= 8").count() == len([x for x in want if x[0] >= 8])


def test_strips_and_geotransform():
    values = np.arange(2 * 40 * 5, dtype=np.int32).reshape(2, 40, 5)
    raw = raster_files.encode_tiff(values, Raster(100, 5, 2, dtype="int32", **GEOMETRY), 40)
    for band, a, b in ((1, 0, 40), (2, 15, 17), (2, 31, 40)):
        assert (raster_files.decode_tiff(io.BytesIO(raw), band, a, b) == values[band - 1, a:b]).all()
    tags = raster_files._tags(io.BytesIO(raw))
    assert tags[raster_files._TIEPOINT][3:5] == [1000.0, 5000.0 - 40 * 30]
    with pytest.raises(ValueError):
        raster_files._tags(io.BytesIO(b"MM\0*" + raw[4:]))


def test_writes_are_whole_or_nothing(spark, tmp_path):
    df, want = pixels(spark)
    path, shape = str(tmp_path / "r"), Raster(40, 23, 2, block_rows=8, **GEOMETRY)
    write_raster(df, path, shape)
    with pytest.raises(Exception, match="there is a raster"):
        write_raster(df, path, shape)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="outside the raster"):
        write_raster(df.unionByName(df.limit(1).withColumn("row", F.lit(40))), path, shape, overwrite=True)
    assert sorted(map(tuple, read_raster(spark, path).collect())) == sorted(want) and set(before) <= set(os.listdir(path))
    write_raster(df.where("row < 20"), path, shape, overwrite=True)
    assert sorted(map(tuple, read_raster(spark, path).collect())) == sorted(x for x in want if x[0] < 20)
    assert not set(x for x in before if x.endswith(".tif")) & set(os.listdir(path))


def test_odd_tables(spark, tmp_path):
    schema = "row int, col int, value double"
    path, shape = str(tmp_path / "e"), Raster(10, 10, 1, **GEOMETRY)
    write_raster(spark.createDataFrame([], schema), path, shape)
    assert read_raster(spark, path).count() == 0 and describe(path).files == []
    rows = [(1, 1, None), (2, 2, float("nan")), (3, 3, 5.0), (3, 3, 7.0), (9, 9, 0.0)]
    write_raster(spark.createDataFrame(rows, schema).withColumn("block", F.lit("clash")), str(tmp_path / "o"), shape)
    assert sorted(map(tuple, read_raster(spark, str(tmp_path / "o")).collect())) == [(3, 3, 1, 7.0), (9, 9, 1, 0.0)]


def test_predicted_raster(spark, tmp_path):
    """Areas and values of a written raster, with its own scale factor."""
    df, want = pixels(spark, bands=1)
    path = str(tmp_path / "p")
    write_raster(df, path, Raster(40, 23, 1, dtype="int16", scalar=10.0, **GEOMETRY))
    own = describe(path)
    area, values = rasters.nonforest_and_values(read_raster(spark, path, bands=[1]), own.scalar, rasters.Geometry(own.x_min, own.y_max, own.cell_size))
    assert area.first()["nonforest"] == pytest.approx(sum(x[3] < 0 for x in want) * 0.09)
    assert sorted(r["value"] for r in values.collect()) == pytest.approx(sorted(x[3] / 10 for x in want if x[3] >= 0))
