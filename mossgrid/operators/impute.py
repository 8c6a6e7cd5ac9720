"""Imputation of attributes from ranked neighbors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbors import independent, top_k

#: Weights of seven neighbors for attribute rasters; normalized when used.
SEVEN_WEIGHTS = [0.6321, 0.2325, 0.0855, 0.0315, 0.0116, 0.0043, 0.0016]


def weigh(neighbors: DataFrame, k: int, weights: str | Sequence[float] = "INVERSE_DISTANCES") -> DataFrame:
    """Adds ``w``, which adds up to 1 over a pixel's neighbors. Inverse distances take 1e-12
    for a distance of 0; EQUAL and explicit weights are normalized over the neighbors there."""
    if weights == "INVERSE_DISTANCES":
        raw: Column = F.lit(1.0) / F.when(F.col("distance") == 0, F.lit(1e-12)).otherwise(F.col("distance"))
    elif weights == "EQUAL":
        raw = F.lit(1.0)
    else:
        if len(weights) != k:
            raise ValueError("as many weights as neighbors are needed")
        raw = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("rank"))
    whole = F.sum("_w").over(Window.partitionBy("id", "pixel_number"))
    return neighbors.withColumn("_w", raw).withColumn("w", F.col("_w") / whole).drop("_w")


def predict(neighbors: DataFrame, attributes: DataFrame, continuous: Sequence[str], k: int, weights: str | Sequence[float] = "INVERSE_DISTANCES", crosswalk: DataFrame | None = None) -> DataFrame:
    """Weighted means per pixel, then means over a plot's pixels: one row per id. With a
    crosswalk only neighbors at other locations count. No neighbor left: null."""
    near = top_k(independent(neighbors, crosswalk) if crosswalk is not None else neighbors, k)
    near = weigh(near, k, weights).select("id", "pixel_number", "neighbor_id", "w")
    values = attributes.select(F.col("id").alias("neighbor_id"), *continuous)
    pixels = near.join(values, "neighbor_id").groupBy("id", "pixel_number").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in continuous])
    plots = pixels.groupBy("id").agg(*[F.avg(c).alias(c) for c in continuous])
    return neighbors.select("id").distinct().join(plots, "id", "left")


def predict_categorical(neighbors: DataFrame, attributes: DataFrame, categorical: Sequence[str], crosswalk: DataFrame | None = None) -> DataFrame:
    """First neighbor's class per pixel, then the most frequent over a plot's pixels; of
    equally frequent ones the least."""
    near = top_k(independent(neighbors, crosswalk) if crosswalk is not None else neighbors, 1).select("id", "neighbor_id")
    values = attributes.select(F.col("id").alias("neighbor_id"), *categorical)
    return near.join(values, "neighbor_id").groupBy("id").agg(*[F.mode(c, True).alias(c) for c in categorical])


def predict_all(neighbors: DataFrame, attributes: DataFrame, k: int, weights: str | Sequence[float] = "INVERSE_DISTANCES", continuous: Sequence[str] = (), categorical: Sequence[str] = (), species: Sequence[str] = (), crosswalk: DataFrame | None = None) -> DataFrame:
    """All groups of attributes by one join and one aggregate each for pixels and plots:
    continuous ones as ``predict`` has them, categorical ones as ``predict_categorical``, and
    the first neighbor's species, averaged over a plot's pixels. No neighbor left: nulls."""
    near = top_k(independent(neighbors, crosswalk) if crosswalk is not None else neighbors, k)
    near = weigh(near, k, weights).select("id", "pixel_number", "neighbor_id", F.col("w").alias("own weight"), F.col("rank").alias("own rank"))
    values = attributes.select(F.col("id").alias("neighbor_id"), *[F.col(c).alias(c) for c in dict.fromkeys([*continuous, *categorical, *species])])
    first = [F.max(F.when(F.col("own rank") == 1, F.col(c))).alias(f"first {c}") for c in dict.fromkeys([*categorical, *species])]
    pixels = near.join(values, "neighbor_id").groupBy("id", "pixel_number").agg(*[F.sum(F.col("own weight") * F.col(c)).alias(c) for c in continuous], *first, F.count(F.lit(1)).alias("neighbors"))
    plots = pixels.groupBy("id").agg(F.sum("neighbors").alias("neighbors"), *[F.avg(c).alias(c) for c in continuous], *[F.mode(f"first {c}", True).alias(c) for c in categorical], *[F.avg(f"first {c}").alias(c) for c in species])
    return neighbors.select("id").distinct().join(plots.drop("neighbors"), "id", "left")


def predict_each_k(neighbors: DataFrame, attributes: DataFrame, continuous: Sequence[str], weights: dict[int, str | Sequence[float]], crosswalk: DataFrame | None = None) -> DataFrame:
    """``predict`` for several k at once: id, k and the attributes, from one ranking, one join
    and one aggregate each for pixels and plots. ``weights``: those of each k."""
    near = top_k(independent(neighbors, crosswalk) if crosswalk is not None else neighbors, max(weights)).select("id", "pixel_number", "neighbor_id", "distance", F.col("rank").alias("own rank"))
    met = near.join(attributes.select(F.col("id").alias("neighbor_id"), *continuous), "neighbor_id")
    rank, sums = F.col("own rank"), []
    for k, own in weights.items():
        if own == "INVERSE_DISTANCES":
            raw: Column = F.lit(1.0) / F.when(F.col("distance") == 0, F.lit(1e-12)).otherwise(F.col("distance"))
        elif own == "EQUAL":
            raw = F.lit(1.0)
        else:
            if len(own) != k:
                raise ValueError("as many weights as neighbors are needed")
            raw = F.get(F.array(*[F.lit(float(x)) for x in own]), rank - 1)
        raw = F.when(rank <= k, raw)
        sums += [F.sum(raw).alias(f"{k} weight"), *[F.sum(raw * F.col(c)).alias(f"{k} {c}") for c in continuous]]
    pixels = met.groupBy("id", "pixel_number").agg(*sums)
    plots = pixels.groupBy("id").agg(*[F.avg(F.col(f"`{k} {c}`") / F.col(f"`{k} weight`")).alias(f"{k} {c}") for k in weights for c in continuous])
    each = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"`{k} {c}`").alias(c) for c in continuous]) for k in weights])
    return neighbors.select("id").distinct().join(plots, "id", "left").select("id", F.inline(each))


def zonal(neighbors: DataFrame, k: int) -> DataFrame:
    """id, pixel_number, neighbor (from 1), neighbor_id, distance."""
    return top_k(neighbors, k).select("id", "pixel_number", F.col("rank").alias("neighbor"), "neighbor_id", "distance")


def attribute_raster(pixels: DataFrame, values: DataFrame, mask: DataFrame, weights: Sequence[float], scalar: float = 1.0, nodata: int = -32768) -> DataFrame:
    """row, col, value: weighted sum of the neighbors' attribute, scaled and rounded half to
    even. ``pixels``: row, col, rank, neighbor_id; ``values``: id, value (missing: 0);
    ``mask``: row, col, forest. Not forest: -1; pixels that lack a neighbor: ``nodata``."""
    total = float(sum(weights))
    own = F.element_at(F.array(*[F.lit(float(x) / total) for x in weights]), F.col("rank"))
    near = pixels.where(F.col("rank") <= len(weights)).join(values.select(F.col("id").alias("neighbor_id"), "value"), "neighbor_id", "left")
    sums = near.groupBy("row", "col").agg(F.sum(own * F.coalesce("value", F.lit(0.0))).alias("v"), F.count("neighbor_id").alias("n"))
    out = mask.join(sums, ["row", "col"], "left")
    value = F.when(~F.col("forest"), F.lit(-1)).when(F.coalesce(F.col("n"), F.lit(0)) < len(weights), F.lit(nodata)).otherwise(F.rint(F.col("v") * F.lit(float(scalar))).cast("int"))
    return out.select("row", "col", value.alias("value"))
