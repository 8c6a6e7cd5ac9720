import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mossgrid.operators import neighbors

SCHEMA = "id long, pixel_number int, scores array<double>"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), 1, [float(v) for v in r]) for i, r in zip(ids, x)], SCHEMA)


def brute(x, xid, y, yid, k):
    out = {}
    for i, t in zip(xid, x):
        d2 = ((y - t) ** 2).sum(axis=1)
        best = sorted(range(len(y)), key=lambda j: (d2[j], yid[j] != i, yid[j]))[:k]
        out[int(i)] = [int(yid[j]) for j in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbor_id"])
        assert len(out[r["id"]]) == r["rank"]
    return out


@pytest.mark.parametrize("cells,blocks", [(4096, 65_536), (25, 65_536), (25, 7)])
def test_equals_brute_force(spark, cells, blocks):
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(size=(300, 4)), 50 + rng.integers(0, 3, (200, 4))])  # a cloud, and a grid with ties
    x = np.concatenate([y[::7], rng.normal(size=(60, 4)) * 3, 50 + rng.normal(size=(40, 4)), [[1e6, 0, 0, 0]]])
    xid = [*range(0, 500, 7), *range(1000, 1000 + len(x) - len(y[::7]))]
    got = found(neighbors.knn(table(spark, x, xid), table(spark, y).repartition(3), 6, cell_rows=cells, block_rows=blocks))
    assert got == brute(x, xid, y, np.arange(len(y)), 6)


def test_many_equal_plots(spark):
    rng = np.random.default_rng(2)
    y = np.concatenate([np.zeros((200, 3)), rng.normal(size=(100, 3))])
    ref = table(spark, y)
    index = neighbors.build_index(ref, 5, cell_rows=20, block_rows=10)
    assert index.others is not None and index.rows.where("scores[0] = 0").count() == 5 and index.sizes.sum() == 105
    got = found(neighbors.search(ref, index, 5))
    assert got == brute(y, np.arange(300), y, np.arange(300), 5)
    assert got[150] == [150, 0, 1, 2, 3]


def test_hot_targets_are_spread(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "COPY_TARGETS", 10)
    rng = np.random.default_rng(3)
    y = rng.normal(size=(200, 3))
    x = np.concatenate([np.repeat(y[:1], 300, axis=0), y])
    xid = np.arange(5000, 5000 + len(x))
    index = neighbors.build_index(table(spark, y), 4, cell_rows=30)
    copies = neighbors._copies(neighbors._whole(table(spark, x, xid), "scores", "id", "pixel_number"), neighbors._Bounds(index, 4), index.blocks())
    assert copies.max() > 10
    assert found(neighbors.search(table(spark, x, xid), index, 4)) == brute(x, xid, y, np.arange(200), 4)


def test_few_cells_are_searched():
    """In few dimensions a target goes to a small part of the cells."""
    rng = np.random.default_rng(4)
    y = rng.random((20_000, 2))
    pivots = neighbors._pivots(y, 200)
    own = neighbors._nearest_pivot(y, pivots)
    far = neighbors._to_pivot(y, pivots, own)
    stat = lambda f: np.array([f(far[own == c]) if (own == c).any() else 0 for c in range(len(pivots))])
    index = neighbors.Index(None, None, 5, pivots, y[:4000], np.bincount(own, minlength=len(pivots)), stat(np.min), stat(np.max), 65_536)
    rows, cells = neighbors._Bounds(index, 5).cells(rng.random((500, 2)))
    assert len(rows) / 500 < 5 and set(rows.tolist()) == set(range(500))


def test_plan_reads_the_reference_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    for name, n in (("ref", 300), ("own", 40)):
        table(spark, rng.normal(size=(n, 3))).write.parquet(str(tmp_path / name))
    ref, own = (spark.read.parquet(str(tmp_path / name)) for name in ("ref", "own"))
    near = neighbors.knn(own, ref, 3, cell_rows=50)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/ref]") == 1 and plan.count("/own]") == 1 and "LocalTableScan" not in plan and "BroadcastExchange" not in plan
    kept = neighbors.build_index(ref, 3, cell_rows=50, path=str(tmp_path / "kept"))
    again = neighbors.search(own, kept, 3)
    assert "/ref]" not in again._jdf.queryExecution().executedPlan().toString()
    assert found(again) == found(near)


def test_nulls_few_rows_and_limits(spark):
    rng = np.random.default_rng(6)
    ref = table(spark, rng.normal(size=(3, 2)))
    odd = ref.unionByName(spark.createDataFrame([(9, None, [0.0, 0.0]), (10, 1, None), (11, 1, [None, 1.0])], SCHEMA))
    got = neighbors.knn(odd, ref.unionByName(spark.createDataFrame([(7, 1, [None, 0.0])], SCHEMA)), 5)
    assert got.count() == 4 * 3 and got.where("pixel_number is null").count() == 3
    assert got.schema == neighbors.knn(odd, ref.limit(0), 5).schema or got.columns == neighbors.knn(odd, ref.limit(0), 5).columns
    assert neighbors.knn(odd.limit(0), ref, 5).count() == neighbors.knn(odd, ref.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        neighbors.search(odd, neighbors.build_index(ref, 2), 3)
    assert neighbors.knn(ref, ref, 2).where(F.col("rank") == 1).where("id <> neighbor_id").count() == 0


def test_small_cells_are_packed(spark, monkeypatch):
    """A target is sent once to many small cells, and large units are still cut."""
    rng = np.random.default_rng(5)
    y, x = rng.normal(size=(600, 6)), rng.normal(size=(80, 6))
    monkeypatch.setattr(neighbors, "CELL_ROWS", 90)
    index = neighbors.build_index(table(spark, y), 5, cell_rows=20, block_rows=4)
    unit, blocks = neighbors._units(index)
    assert len(index.sizes) >= 25 and len(blocks) <= 12 and np.bincount(unit, index.sizes).max() <= 90
    sent = neighbors._Bounds(index, 5, unit).cells(x)
    cells = neighbors._Bounds(index, 5).cells(x)
    assert set(zip(*sent)) == {(r, unit[c]) for r, c in zip(*cells)} and len(sent[0]) < len(cells[0]) / 2
    got = found(neighbors.search(table(spark, x, range(1000, 1080)), index, 5))
    assert got == brute(x, range(1000, 1080), y, np.arange(600), 5)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 8)
    assert neighbors._units(index)[1].max() > 1
    assert found(neighbors.search(table(spark, x, range(1000, 1080)), index, 5)) == got


def test_memory_is_bounded():
    """What a worker makes at once does not grow with the rows that it meets."""
    import tracemalloc

    rng = np.random.default_rng(6)
    y, x = rng.normal(size=(40_000, 8)), rng.normal(size=(1500, 8))
    tracemalloc.start()
    rows = sum(b.num_rows for b in neighbors._best(np.arange(1500) + 10**6, pa.nulls(1500, pa.int32()), x, np.arange(40_000), y, 24))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1500 * 24 and peak < 100 << 20


def test_matrices_of_a_worker_stay_small():
    rng = np.random.default_rng(5)
    matrix, x = rng.standard_normal((60_000, 8)), rng.standard_normal((256, 8))
    best = lambda m: sum(b.num_rows for b in neighbors._best(np.arange(m), pa.array([1] * m, pa.int32()), x[:m], np.arange(60_000), matrix, 24))
    best(1)  # what it imports is not counted
    tracemalloc.start()
    rows = best(256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 256 * 24 and peak < 32e6
