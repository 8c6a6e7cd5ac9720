"""Exact nearest neighbors in an ordination (or any Euclidean) space, as a partitioned join.

The reference is dealt into cells by nearest pivot. Of each cell its size and the least and
greatest distance to its pivot are known; pivots, these figures and a sample of the reference,
all of fixed greatest size, are what is broadcast. The distance to the k-th row of the sample
bounds a target's k-th distance from above; the triangle inequality and the plane halfway
between two pivots bound the distance to any row of a cell from below. A target is sent only
to the cells that these bounds leave. There it meets the reference: rows of both sides are
shuffled by cell, the reference first, so that a task holds one block of a cell while targets
stream by. The best of every cell are merged by a window.

Small cells that are near each other are packed into units, so that a target and what it finds
are sent once for all of them; larger cells are units of their own. Large units are cut into
blocks, each of which gets the unit's targets; units that many targets go to (as a sample of targets tells) are repeated, and each copy gets some of them. Of
reference rows with equal scores the k lowest ids are kept, and a target's own row besides, as
no other can be among its k nearest. So neither many equal plots nor many targets at one place
make a large group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Reference rows of a cell and of a block that a task holds; most cells; rows of the samples of
#: the reference and the targets (all on the driver); targets that one copy of a cell gets.
CELL_ROWS, BLOCK_ROWS, MOST_CELLS, SAMPLE_ROWS, TARGET_SAMPLE, COPY_TARGETS = 4096, 65_536, 8192, 16_384, 4096, 200_000
_COPIES = 1024
#: Numbers of a matrix, and rows, that a Python worker makes at once (whatever the table's size).
_AT_ONCE, _ROWS_OUT = 500_000, 8192

_OUT = "id long, pixel_number int, neighbor_id long, distance double"
_PLACED = "cell int, block int, copy int, target boolean, id long, pixel_number int, scores array<double>"


def project(env: Column, means: Sequence[float], coefficients: np.ndarray, axis_weights: Sequence[float] | None, n_axes: int) -> Column:
    """Scores of a covariate array: (env - means) . coefficients, first axes, each times the
    root of its weight. Unrolled, so generated code evaluates it."""
    axes = min(n_axes, coefficients.shape[1])
    out = []
    for a in range(axes):
        terms = [(env[k] - F.lit(float(m))) * F.lit(float(coefficients[k, a])) for k, m in enumerate(means)]
        score = terms[0]
        for t in terms[1:]:
            score = score + t
        # weighted last, as the scores of plots are: equal covariates have equal scores
        out.append(score if axis_weights is None else score * F.lit(float(axis_weights[a]) ** 0.5))
    return F.array(*out)


@dataclass(frozen=True)
class Index:
    """A reference in cells. ``rows`` (id, scores) has at most ``most`` rows of equal scores,
    ``others`` (None if there are none) the rest; what else is here is small."""

    rows: DataFrame
    others: DataFrame | None
    most: int
    pivots: np.ndarray
    sample: np.ndarray
    sizes: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    block_rows: int

    def blocks(self) -> np.ndarray:
        return -(-self.sizes // self.block_rows)


def _whole(df: DataFrame, scores: str, *columns: Column) -> DataFrame:
    """Rows with scores, none of them null."""
    return df.where(F.col(scores).isNotNull() & ~F.exists(scores, lambda x: x.isNull())).select(*columns, F.col(scores).cast("array<double>").alias("scores"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sampled(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """Scores of about ``most`` rows, by a hash of the row."""
    some = rows if n <= most else rows.where(F.pmod(F.xxhash64("id", "scores"), F.lit(1 << 30)) < int(most / n * (1 << 30)) + 1)
    found = some.select("scores").limit(2 * most).collect()
    return np.array([r["scores"] for r in found], dtype=np.float64).reshape(len(found), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances; off by about 1e-15 times the squared lengths."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def _pivots(sample: np.ndarray, m: int) -> np.ndarray:
    """``m`` places at most: a draw from the sample, moved to the middle of their rows twice."""
    places = np.unique(sample, axis=0)
    places = places[np.random.default_rng(7).permutation(len(places))[:m]]
    for _ in range(2 if len(places) > 1 else 0):
        own = _squares(sample, places).argmin(axis=1)
        count = np.bincount(own, minlength=len(places))
        sums = np.zeros_like(places)
        np.add.at(sums, own, sample)
        places = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], places)
    return np.unique(places, axis=0)


def build_index(reference: DataFrame, most: int, scores: str = "scores", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, path: str | None = None) -> Index | None:
    """Deals a reference (id, scores) into cells, for searches of up to ``most`` neighbors; None
    if it has no rows. With a ``path`` the reference is read once and kept there as Parquet for
    this and later searches; otherwise it is read again by each."""
    spark = reference.sparkSession
    ref = _whole(reference, scores, F.col("id").cast("long").alias("id"))
    ranked = ref.withColumn("nth", F.row_number().over(Window.partitionBy("scores").orderBy("id")))
    if path is not None:
        ranked.write.mode("overwrite").parquet(path)
        ranked = spark.read.parquet(path)
    n = (ref if path is None else ranked).count()
    if not n:
        return None
    sample = _sampled(ref if path is None else ranked, n, SAMPLE_ROWS)
    pivots = _pivots(sample, min(MOST_CELLS, -(-n // cell_rows)))
    rows = ranked.where(F.col("nth") <= most).drop("nth")
    kept, shared = rows.select("scores"), spark.sparkContext.broadcast(pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                own = _nearest_pivot(x, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(_to_pivot(x, shared.value, own))], names=["cell", "far"])

    figures = kept.mapInArrow(measured, "cell int, far double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("a"), F.max("far").alias("b")).collect()  # a row for each cell
    sizes, nearest, farthest = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in figures:
        sizes[r["cell"]], nearest[r["cell"]], farthest[r["cell"]] = r["n"], r["a"], r["b"]
    others = ranked.where(F.col("nth") > most).drop("nth") if sizes.sum() < n else None
    return Index(rows, others, most, pivots, sample, sizes, nearest, farthest, block_rows)


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    rows = max(1, _AT_ONCE // len(pivots))
    return np.concatenate([_squares(x[k : k + rows], pivots).argmin(axis=1) for k in range(0, len(x), rows)]).astype(np.int32)


def _to_pivot(x: np.ndarray, pivots: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def _by_place(places: np.ndarray) -> np.ndarray:
    """An order in which places near each other follow each other mostly: halves by the widest
    axis, and so on."""

    def cut(own: np.ndarray) -> np.ndarray:
        if len(own) < 3:
            return own
        axis = np.ptp(places[own], axis=0).argmax()
        own, half = own[np.argsort(places[own, axis], kind="stable")], len(own) // 2
        return np.concatenate([cut(own[:half]), cut(own[half:])])

    return cut(np.arange(len(places)))


def _units(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The unit of each cell and the number of blocks of each unit. Cells are packed up to
    ``CELL_ROWS`` rows, and blocks hold no fewer where they are cut."""
    unit, at, held = np.zeros(len(index.sizes), np.int64), 0, 0
    for cell in _by_place(index.pivots):
        if held and held + index.sizes[cell] > CELL_ROWS:
            at, held = at + 1, 0
        unit[cell] = at
        held += index.sizes[cell]
    return unit, -(-np.bincount(unit, index.sizes).astype(np.int64) // max(index.block_rows, CELL_ROWS))


class _Bounds:
    """Which cells, or units of them if these are given, a target has to be sent to."""

    def __init__(self, index: Index, k: int, unit: np.ndarray | None = None):
        self.unit = unit
        if unit is not None:
            self.by_unit = np.argsort(unit, kind="stable")
            self.first = np.searchsorted(unit[self.by_unit], np.arange(unit.max() + 1))
        self.k, self.pivots, self.sample = k, index.pivots, index.sample
        self.there, self.nearest, self.farthest = index.sizes > 0, index.nearest, index.farthest
        self.length = float(max((index.pivots**2).sum(axis=1).max(), (index.sample**2).sum(axis=1).max()))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (row of ``x``, cell or unit), by row."""
        step = max(1, _AT_ONCE // max(len(self.pivots), len(self.sample)))
        parts = [self._cells(x[k : k + step]) for k in range(0, len(x), step)]
        rows = [r + k * step for k, (r, _) in enumerate(parts)]
        return np.concatenate(rows), np.concatenate([c for _, c in parts])

    def _cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = _squares(x, self.pivots)
        d, own = np.sqrt(d2), d2.argmin(axis=1)
        error = 1e-13 * (self.length + (x * x).sum(axis=1))  # of squared distances, and more
        if len(self.sample) < self.k:
            most = np.full(len(x), np.inf)
        else:
            most = np.sqrt(np.partition(_squares(x, self.sample), self.k - 1, axis=1)[:, self.k - 1] + error)
        slack = np.sqrt(error)[:, None]
        least = np.maximum(d - self.farthest, self.nearest - d) - slack
        apart = np.sqrt(((self.pivots[own][:, None, :] - self.pivots[None]) ** 2).sum(axis=2)) if len(self.pivots) < 64 else np.sqrt(_squares(self.pivots[own], self.pivots))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > slack, (d2 - d2[np.arange(len(x)), own][:, None] - 4 * error[:, None]) / (2 * (apart + slack)), 0)
        near = (np.maximum(least, plane) <= most[:, None] + slack) & self.there
        return np.nonzero(near if self.unit is None else np.logical_or.reduceat(near[:, self.by_unit], self.first, axis=1))


def knn(targets: DataFrame, reference: DataFrame, k: int, scores: str = "scores", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, pixel_number, rank, neighbor_id, distance of the k nearest reference rows.

    ``targets`` has id, pixel_number and scores; ``reference`` has id and scores. Ties in
    distance go to the target's own id first, then to lower ids. Rows with a null score or a
    null element take no part.
    """
    return search(targets, build_index(reference, k, scores, cell_rows, block_rows), k, scores)


def search(targets: DataFrame, index: Index | None, k: int, scores: str = "scores") -> DataFrame:
    """``knn`` against a reference that is in cells already."""
    spark = targets.sparkSession
    own = _whole(targets, scores, F.col("id").cast("long").alias("id"), F.col("pixel_number").cast("int").alias("pixel_number"))
    if index is None:
        return spark.createDataFrame([], "id long, pixel_number int, rank int, neighbor_id long, distance double")
    if k > index.most:
        raise ValueError(f"the index serves up to {index.most} neighbors")
    unit, blocks = _units(index)
    bounds = _Bounds(index, k, unit)
    copies = _copies(own, bounds, blocks)
    shared = spark.sparkContext.broadcast((bounds, blocks, copies))

    def deal_reference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, blocks, copies = shared.value
        for batch in batches:
            step = max(1, _ROWS_OUT // int(copies.max()))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cell = bounds.unit[_nearest_pivot(_matrix(part.column(1)), bounds.pivots)]
                ids = part.column(0).to_numpy()
                again = np.repeat(np.arange(len(cell)), copies[cell])
                copy = np.arange(len(again)) - np.repeat(np.cumsum(copies[cell]) - copies[cell], copies[cell])
                yield _placed(cell[again], (_mixed(ids) % blocks[cell])[again], copy, False, part.column(0).take(pa.array(again)), None, part.column(1).take(pa.array(again)))

    def deal_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, blocks, copies = shared.value
        for batch in batches:
            step = min(1024, max(1, _AT_ONCE // int(blocks.sum())))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, cell = bounds.cells(_matrix(part.column(2)))
                ids = _mixed(part.column(0).to_numpy() * 31 + part.column(1).fill_null(0).to_numpy(zero_copy_only=False))
                again = np.repeat(np.arange(len(row)), blocks[cell])
                block = np.arange(len(again)) - np.repeat(np.cumsum(blocks[cell]) - blocks[cell], blocks[cell])
                for lo in range(0, len(again), _ROWS_OUT):
                    some = slice(lo, lo + _ROWS_OUT)
                    at_row, at_cell = row[again[some]], cell[again[some]]
                    yield _placed(at_cell, block[some], ids[at_row] % copies[at_cell], True, *[part.column(c).take(pa.array(at_row)) for c in range(3)])

    both = index.rows.select("id", "scores").mapInArrow(deal_reference, _PLACED).unionByName(own.select("id", "pixel_number", "scores").mapInArrow(deal_targets, _PLACED))
    met = both.repartition("cell", "block", "copy").sortWithinPartitions("cell", "block", "copy", "target")
    found = met.mapInArrow(lambda batches: _meet(batches, k), _OUT)
    if index.others is not None:  # a target's own row, if there are many of its scores
        mine = own.join(index.others.select("id", F.col("scores").alias("_s")), "id")
        d2 = F.aggregate(F.zip_with("scores", "_s", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        found = found.unionByName(mine.select("id", "pixel_number", F.col("id").alias("neighbor_id"), F.sqrt(d2).alias("distance")))
    order = [F.col("distance"), (F.col("id") != F.col("neighbor_id")), F.col("neighbor_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id", "pixel_number").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("id", "pixel_number", "rank", "neighbor_id", "distance")


def _copies(own: DataFrame, bounds: _Bounds, blocks: np.ndarray) -> np.ndarray:
    """How often each cell is repeated, from the cells of a sample of the targets. It only
    decides how work is spread."""
    out = np.ones(len(blocks), np.int64)
    n = own.count()
    if n > COPY_TARGETS:
        sample = _sampled(own, n, TARGET_SAMPLE)
        if len(sample):
            sent = np.bincount(bounds.cells(sample)[1], minlength=len(blocks)) * (n / len(sample))
            out = np.clip(np.ceil(sent / COPY_TARGETS), 1, _COPIES).astype(np.int64)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 that spread ids."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _placed(cell, block, copy, target: bool, ids: pa.Array, pixel: pa.Array | None, scores: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    pixel = pa.nulls(n, pa.int32()) if pixel is None else pixel
    cells = [pa.array(np.asarray(x, np.int32)) for x in (cell, block, copy)]
    return pa.RecordBatch.from_arrays([*cells, pa.array(np.full(n, target)), ids, pixel, scores], names=[x.split()[0] for x in _PLACED.split(", ")])


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a block for each of its targets. Rows come by block, the reference first."""
    now, ids, parts, matrix = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for begin, end in zip(cuts, cuts[1:]):
            part, place, target = batch.slice(begin, end - begin), tuple(key[begin, :3]), key[begin, 3]
            if place != now:
                now, ids, parts, matrix = place, [], [], None
            if not target:
                ids.append(part.column(4).to_numpy())
                parts.append(_matrix(part.column(6)))
            elif ids:
                if matrix is None:
                    matrix, known = np.concatenate(parts), np.concatenate(ids)
                    parts = []
                yield from _best(part.column(4).to_numpy(), part.column(5), _matrix(part.column(6)), known, matrix, k)


def _best(tid: np.ndarray, pixel: pa.Array, x: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Candidates come from one matrix product; their distances are evaluated again exactly."""
    square = (matrix * matrix).sum(axis=1)
    rows, kk = max(1, _AT_ONCE // len(ids)), min(k, len(ids))
    for lo in range(0, len(x), rows):
        t = x[lo : lo + rows]
        about = square[None, :] - 2 * t @ matrix.T
        limit = np.partition(about, kk - 1, axis=1)[:, kk - 1] if kk < len(ids) else about.max(axis=1)
        slack = 1e-9 * ((t * t).sum(axis=1) + square.max() + 1)
        r, c = np.nonzero(about <= (limit + slack)[:, None])
        distance = np.zeros(len(r))
        for a in range(t.shape[1]):  # one element after another, as SQL adds up
            apart = t[r, a] - matrix[c, a]
            distance += apart * apart
        distance = np.sqrt(distance)
        keep = np.lexsort((ids[c], ids[c] != tid[lo + r], distance, r))
        r, c, distance = r[keep], c[keep], distance[keep]
        first = np.searchsorted(r, np.arange(len(t)))
        inside = np.arange(len(r)) - first[r] < kk
        r, c, distance = r[inside], c[inside], distance[inside]
        yield pa.RecordBatch.from_arrays([pa.array(tid[lo + r]), pixel.take(pa.array(lo + r)), pa.array(ids[c]), pa.array(distance)], names=["id", "pixel_number", "neighbor_id", "distance"])


def independent(neighbors: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Neighbors at another location than the target's (``crosswalk``: id, loc_id)."""
    t = crosswalk.select(F.col("id"), F.col("loc_id").alias("_lt"))
    n = crosswalk.select(F.col("id").alias("neighbor_id"), F.col("loc_id").alias("_ln"))
    return neighbors.join(t, "id").join(n, "neighbor_id").where(F.col("_lt") != F.col("_ln")).drop("_lt", "_ln")


def not_self(neighbors: DataFrame) -> DataFrame:
    return neighbors.where(F.col("id") != F.col("neighbor_id"))


def top_k(neighbors: DataFrame, k: int) -> DataFrame:
    """The k nearest that are left, ranked anew."""
    again = F.row_number().over(Window.partitionBy("id", "pixel_number").orderBy("rank"))
    return neighbors.withColumn("_r", again).where(F.col("_r") <= k).withColumn("rank", F.col("_r")).drop("_r")


def self_position(neighbors: DataFrame, most: int) -> DataFrame:
    """id, average_position: mean over pixels of the place of the own id; ``most`` where it is
    not among the neighbors."""
    each = neighbors.groupBy("id", "pixel_number").agg(F.coalesce(F.min(F.when(F.col("id") == F.col("neighbor_id"), F.col("rank"))), F.least(F.max("rank"), F.lit(most))).alias("p"))
    return each.groupBy("id").agg(F.avg("p").alias("average_position"))
