"""Pixel tables and footprints: windows around plots, alignment, covariate stacks, areas.

A raster is a table (row, col, value) with nulls or missing rows for masked pixels; its
geometry is a small record. Windows are equi-joins on enumerated offsets, so a plot's pixels
are found by hash and no range join is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Geometry:
    """Upper-left corner and cell size of a raster."""

    x_min: float
    y_max: float
    cell_size: float


@dataclass(frozen=True)
class Footprint:
    """A small grid of codes: 0 out, 1 in, 2 index pixel inside, 3 index pixel outside."""

    key: str
    codes: tuple[tuple[int, ...], ...]
    cell_size: float

    @property
    def index(self) -> tuple[int, int]:
        for code in (2, 3):
            found = [(r, c) for r, row in enumerate(self.codes) for c, x in enumerate(row) if x == code]
            if len(found) == 1:
                return found[0]
        raise ValueError("a footprint needs exactly one index pixel")

    @property
    def offsets(self) -> list[tuple[int, int]]:
        return [(r, c) for r, row in enumerate(self.codes) for c, x in enumerate(row) if x in (1, 2)]

    def coordinates(self, x: float, y: float) -> list[tuple[float, float]]:
        """Centers of the pixels inside, around a point."""
        i, j = self.index
        return [(x + (c - j) * self.cell_size, y + (i - r) * self.cell_size) for r, c in self.offsets]

    def window(self, x: float, y: float) -> tuple[float, float, int, int]:
        """Upper-left coordinate, columns and rows of the window around a point."""
        i, j = self.index
        return x - j * self.cell_size, y + i * self.cell_size, len(self.codes[0]), len(self.codes)

    def kernel(self) -> list[list[int]]:
        """The grid rebuilt from offsets and index."""
        own = set(self.offsets)
        return [[(2 if (r, c) in own else 3) if (r, c) == self.index else int((r, c) in own) for c in range(len(row))] for r, row in enumerate(self.codes)]


def footprint_table(spark: SparkSession, footprints: list[Footprint], use_kernel: bool = False) -> DataFrame:
    """key, dr, dc: offsets from the index pixel; the whole rectangle unless ``use_kernel``."""
    rows = []
    for f in footprints:
        i, j = f.index
        cells = f.offsets if use_kernel else [(r, c) for r, row in enumerate(f.codes) for c in range(len(row))]
        rows += [(f.key, r - i, c - j) for r, c in cells]
    return spark.createDataFrame(rows, "key string, dr int, dc int")


def plot_pixels(plots: DataFrame, footprints: DataFrame, geometry: Geometry) -> DataFrame:
    """id, pixel_number (from 1, row by row), row, col. ``plots``: id, x, y, key."""
    row = F.floor((F.lit(geometry.y_max) - F.col("y")) / geometry.cell_size).cast("int")
    col = F.floor((F.col("x") - F.lit(geometry.x_min)) / geometry.cell_size).cast("int")
    per_key = footprints.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("dr", "dc"))).alias("cells"))  # small grids
    own = plots.withColumns({"_r": row, "_c": col}).join(F.broadcast(per_key), "key")
    return own.select("id", F.posexplode("cells").alias("k", "cell"), "_r", "_c").select("id", (F.col("k") + 1).alias("pixel_number"), (F.col("_r") + F.col("cell.dr")).alias("row"), (F.col("_c") + F.col("cell.dc")).alias("col"))


def extract(pixels: DataFrame, stack: DataFrame, variables: list[str]) -> DataFrame:
    """Covariates of plot pixels; pixels where any is missing are left out. ``stack``: row,
    col and a column per variable."""
    return pixels.join(stack.select("row", "col", *variables), ["row", "col"]).dropna(subset=variables)


def extract_by_year(pixels: DataFrame, years: DataFrame, stacks: DataFrame, variables: list[str]) -> DataFrame:
    """As extract, with a stack per year (``stacks`` has a year column; null: every year)."""
    own = pixels.join(years.select("id", "year"), "id")
    dated = own.join(stacks.where("year is not null").select("row", "col", "year", *variables), ["row", "col", "year"])
    static = own.join(stacks.where("year is null").select("row", "col", *variables), ["row", "col"])
    return dated.unionByName(static.select(dated.columns)).dropna(subset=variables).drop("year")


def aligned(rasters: dict[str, DataFrame]) -> DataFrame:
    """row, col and one column per raster, where all have the pixel."""
    out = None
    for name, raster in rasters.items():
        own = raster.select("row", "col", F.col("value").alias(name))
        out = own if out is None else out.join(own, ["row", "col"])
    return out


def nonforest_and_values(raster: DataFrame, scalar: float, geometry: Geometry) -> tuple[DataFrame, DataFrame]:
    """Area of negative pixels in hectares (one row) and the values of the others with the
    hectares of a pixel."""
    pixel = geometry.cell_size * geometry.cell_size / 10_000
    area = raster.agg((F.count_if(F.col("value") < 0) * F.lit(pixel)).alias("nonforest"))
    return area, raster.where("value >= 0").select((F.col("value") / F.lit(float(scalar))).alias("value"), F.lit(pixel).alias("area"))


def by_row_band(raster: DataFrame, band: int = 256) -> DataFrame:
    """Partitioned by bands of rows, for writing."""
    return raster.withColumn("band", F.floor(F.col("row") / band).cast("int")).repartition("band")
