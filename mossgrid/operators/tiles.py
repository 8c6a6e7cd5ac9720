"""Rasters in square tiles, and the pixels around plots by a join of tiles.

A tile is one row: its place, the positions that have data, and an array per variable. Plots are
dealt to the tiles that their window touches (mostly one), packed up to ``PACK`` to a row, and
cut out of the tile inside the row that the join makes. So what is shuffled is tiles and packs,
not a row for each cell of each window; a tile with very many plots has many packs, which a
skewed join can be split by, and where plots are few the packs are broadcast by Spark and tiles
stay where they are.

Nulls and ties: pixels without row or col, and plots without place or footprint, take no part;
pixels where any variable is null are left out, as are cells outside the raster. Of several
rows for a pixel (and year) each variable's greatest value is kept. Plots that are repeated
are cut out as often.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rasters import Footprint, Geometry

#: Cells along a tile's edge, and most plots in a pack.
TILE, PACK = 64, 256


def to_tiles(stack: DataFrame, variables: Sequence[str], tile: int = TILE, year: str | None = None) -> DataFrame:
    """tile_row, tile_col (and year), pos, and an array per variable, from row, col and the
    variables. ``pos`` counts cells row by row."""
    keys = ["tile_row", "tile_col", *(["year"] if year else [])]
    own = stack.dropna(subset=["row", "col"]).select(
        F.floor(F.col("row") / tile).cast("int").alias("tile_row"), F.floor(F.col("col") / tile).cast("int").alias("tile_col"), *([F.col(year).cast("int").alias("year")] if year else []),
        (F.pmod("row", F.lit(tile)) * tile + F.pmod("col", F.lit(tile))).cast("int").alias("cell"), *[F.col(v).cast("double").alias(v) for v in variables],
    )
    # both aggregates work within the partitions that one exchange makes
    cells = own.repartition(*keys).groupBy(*keys, "cell").agg(*[F.max(v).alias(v) for v in variables])
    packed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell", *variables))).alias("cells"))  # tile * tile at most
    return packed.select(*keys, F.col("cells.cell").alias("pos"), *[F.col("cells")[v].alias(v) for v in variables])


def from_tiles(tiles: DataFrame, variables: Sequence[str], tile: int = TILE) -> DataFrame:
    """row, col (and year) and the variables: the table that ``to_tiles`` was given."""
    more = ["year"] if "year" in tiles.columns else []
    each = tiles.select("tile_row", "tile_col", *more, F.inline(F.arrays_zip("pos", *variables)))
    return each.select((F.col("tile_row") * tile + F.floor(F.col("pos") / tile)).cast("int").alias("row"), (F.col("tile_col") * tile + F.col("pos") % tile).cast("int").alias("col"), *more, *variables)


def _packs(plots: DataFrame, footprints: Sequence[Footprint], geometry: Geometry, tile: int, use_kernel: bool, year: bool) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Packs of plots by tile, and each footprint's (dr, dc) by its number; cells go row by row
    and are numbered from 1."""
    cells, spans = {}, []
    for k, f in enumerate(footprints):
        i, j = f.index
        own = f.offsets if use_kernel else [(r, c) for r, row in enumerate(f.codes) for c in range(len(row))]
        cells[k] = np.array(sorted((r - i, c - j) for r, c in own), dtype=np.int64).reshape(-1, 2)
        (a, b), (c, d) = cells[k].min(axis=0).tolist(), cells[k].max(axis=0).tolist()
        spans.append((f.key, k, a, c, b, d))
    table = plots.sparkSession.createDataFrame(spans, "key string, footprint int, r0 int, r1 int, c0 int, c1 int")  # a row for each footprint
    row = F.floor((F.lit(geometry.y_max) - F.col("y")) / geometry.cell_size).cast("int")
    col = F.floor((F.col("x") - F.lit(geometry.x_min)) / geometry.cell_size).cast("int")
    keys = ["tile_row", "tile_col", *(["year"] if year else [])]
    own = plots.select("id", row.alias("r"), col.alias("c"), "key", *(["year"] if year else [])).dropna(subset=["r", "c"]).join(F.broadcast(table), "key")
    tiles = lambda at, low, high: F.sequence(F.floor((F.col(at) + F.col(low)) / tile).cast("int"), F.floor((F.col(at) + F.col(high)) / tile).cast("int"))
    own = own.withColumn("tile_row", F.explode(tiles("r", "r0", "r1"))).withColumn("tile_col", F.explode(tiles("c", "c0", "c1")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "r", "c", "footprint"))
    packed = own.withColumn("pack", F.floor((number - 1) / PACK)).groupBy(*keys, "pack").agg(F.collect_list(F.struct("id", "r", "c", "footprint")).alias("plots"))  # PACK at most
    return packed, cells


def extract(plots: DataFrame, tiles: DataFrame, variables: Sequence[str], footprints: Sequence[Footprint], geometry: Geometry, use_kernel: bool = False, tile: int = TILE) -> DataFrame:
    """id, pixel_number, row, col and the variables of the pixels around plots (id, x, y, key).
    Where both sides have a year, it is a key as well."""
    year = "year" in tiles.columns
    packs, cells = _packs(plots, footprints, geometry, tile, use_kernel, year)
    keys = ["tile_row", "tile_col", *(["year"] if year else [])]
    met = packs.join(tiles.select(*keys, "pos", *variables), keys).select("tile_row", "tile_col", "plots", "pos", *variables)
    id_type = plots.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, pixel_number int, row int, col int, " + ", ".join(f"`{v}` double" for v in variables)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.slice(k, 1)
                top, left = own.column(0)[0].as_py() * tile, own.column(1)[0].as_py() * tile
                packed = own.column(2).flatten()
                ids = packed.field("id")
                r, c, shape = (packed.field(x).to_numpy(zero_copy_only=False) for x in ("r", "c", "footprint"))
                place = np.full(tile * tile, -1)
                pos = own.column(3).flatten().to_numpy(zero_copy_only=False)
                place[pos] = np.arange(len(pos))
                values = [own.column(4 + i).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(variables))]
                for f in np.unique(shape):
                    mine = np.flatnonzero(shape == f)
                    rows, cols = r[mine, None] + cells[f][None, :, 0], c[mine, None] + cells[f][None, :, 1]
                    plot, pixel = np.nonzero((rows >= top) & (rows < top + tile) & (cols >= left) & (cols < left + tile))
                    rows, cols = rows[plot, pixel], cols[plot, pixel]
                    at = place[(rows - top) * tile + cols - left]
                    good = at >= 0
                    for v in values:
                        good &= ~np.isnan(v[at])
                    columns = [ids.take(pa.array(mine[plot[good]])), *(pa.array(x[good].astype(np.int32)) for x in (pixel + 1, rows, cols)), *(pa.array(v[at[good]]) for v in values)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "pixel_number", "row", "col", *variables])

    return met.mapInArrow(cut, schema)


def extract_by_year(plots: DataFrame, tiles: DataFrame, variables: Sequence[str], footprints: Sequence[Footprint], geometry: Geometry, use_kernel: bool = False, tile: int = TILE) -> DataFrame:
    """As extract, for plots and tiles with a year; tiles whose year is null are every year's."""
    dated = extract(plots, tiles.where("year IS NOT NULL"), variables, footprints, geometry, use_kernel, tile)
    return dated.unionByName(extract(plots, tiles.where("year IS NULL").drop("year"), variables, footprints, geometry, use_kernel, tile))


def save_bucketed(raster: DataFrame, table: str, buckets: int, path: str | None = None, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Keep a raster (or tiles, with their keys) as a table in ``buckets`` by place, each
    bucket in order. Tables of equally many buckets join and group by place without an
    exchange."""
    own = raster.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (own.option("path", path) if path else own).saveAsTable(table)
    return raster.sparkSession.table(table)
