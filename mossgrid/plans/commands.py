"""The seven commands as functions over tables; files only where a path is given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.operators import impute as imputing
from mossgrid.operators import neighbors, ordination, rasters
from mossgrid.plans import diagnostics
from mossgrid.sources import model_file
from mossgrid.sources import tables as table_files
from mossgrid.sources.small_files import Parameters


def build_model(parameters: Parameters, species: DataFrame, env: DataFrame, path: str | None = None) -> ordination.Ordination:
    """Fit the ordination that the parameters name; write the model file if there is a path."""
    own = parameters.ordination
    key = parameters.plot_id
    x = ordination.species_long(species, key, own.transform)
    names = own.names(parameters.model_year)
    model = ordination.fit(own.program, own.metric, x, env.select(F.col(key).cast("long").alias("id"), *[F.col(v).cast("double").alias(v) for v in names]), names, downweighting=bool(own.downweighting))
    if path:
        model_file.write(model, species.sparkSession, path)
    return model


def scores(parameters: Parameters, model: ordination.Ordination, env: DataFrame) -> DataFrame:
    """``env`` (id and covariates, one or more pixels per id) with scores and pixel numbers;
    pixels with a missing covariate are left out."""
    own = parameters.imputation
    names = model.variables
    weights = list(model.eigenvalues) if own.axis_weighting else None
    table = env.dropna(subset=names)
    if "pixel_number" not in table.columns:
        from pyspark.sql import Window

        table = table.withColumn("pixel_number", F.row_number().over(Window.partitionBy("id").orderBy(*names)))
    array = F.array(*[F.col(v).cast("double") for v in names])
    return table.select("id", "pixel_number", array.alias("_env")).select("id", "pixel_number", neighbors.project(F.col("_env"), model.means, model.coefficients, weights, min(own.axes, model.rank)).alias("scores"))


def reference(parameters: Parameters, model: ordination.Ordination) -> DataFrame:
    """Scores of the model's own plots, scaled as those of targets."""
    own = parameters.imputation
    n = min(own.axes, model.rank)
    scale = [float(e) ** 0.5 if own.axis_weighting else 1.0 for e in model.eigenvalues[:n]]
    return model.sites.select("id", F.array(*[F.col("lc")[k] * F.lit(s) for k, s in enumerate(scale)]).alias("scores"))


def find_neighbors(parameters: Parameters, model: ordination.Ordination, env: DataFrame) -> DataFrame:
    return neighbors.knn(scores(parameters, model, env), reference(parameters, model), parameters.imputation.max_neighbors)


def predictions(parameters: Parameters, near: DataFrame, attributes: DataFrame, continuous: Sequence[str], categorical: Sequence[str], species: Sequence[str], crosswalk: DataFrame | None) -> DataFrame:
    """All groups of attributes in one table: continuous ones by k and weights, categorical
    ones and species by the first neighbor."""
    own = parameters.imputation
    return imputing.predict_all(near, attributes, own.k, own.weight_list(), continuous, categorical, species, crosswalk)


def cross_validate(parameters: Parameters, model: ordination.Ordination, env: DataFrame, attributes: DataFrame, crosswalk: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), species: Sequence[str] = (), tables: dict[str, DataFrame] | None = None, settings: dict | None = None) -> dict:
    """Neighbors once, predictions with and without neighbors at the same location, zonal
    records, and the accuracy diagnostics that the parameters name."""
    near = find_neighbors(parameters, model, env).persist()
    independent = predictions(parameters, near, attributes, continuous, categorical, species, crosswalk)
    dependent = predictions(parameters, near, attributes, continuous, categorical, species, None)
    context = _context(parameters, near, attributes, independent, dependent, crosswalk, continuous, species, tables, settings)
    found = diagnostics.run(parameters.accuracy.diagnostics, context, diagnostics.ACCURACY)
    return {"neighbors": near, "independent": independent, "dependent": dependent, "zonal": imputing.zonal(near, parameters.imputation.k), "diagnostics": found, "context": context}


def _context(parameters: Parameters, near: DataFrame, attributes: DataFrame, independent: DataFrame, dependent: DataFrame, crosswalk: DataFrame | None, continuous: Sequence[str], species: Sequence[str], tables: dict[str, DataFrame] | None, settings: dict | None) -> diagnostics.Context:
    own = {"observed": attributes, "independent": independent, "dependent": dependent, "neighbors": near} | ({"crosswalk": crosswalk} if crosswalk is not None else {}) | (tables or {})
    a, o = parameters.accuracy, parameters.outliers
    values = {"bins": a.bins, "bin_method": a.bin_method, "k": parameters.imputation.k, "weights": parameters.imputation.weight_list(), "k_values": list(a.k_values), "k_weights": {k: w if isinstance(w, str) else list(w) for k, w in a.k_weights}, "hex_levels": {h.column: h.min_plots for h in a.hex_levels}, "index_threshold": o.index_threshold, "deviations": dict(o.deviations), "max_neighbors": parameters.imputation.max_neighbors}
    return diagnostics.Context(own, list(continuous), species=list(species), **(values | (settings or {})))


def find_outliers(parameters: Parameters, validated: dict) -> dict[str, dict[str, DataFrame]]:
    """Outlier diagnostics on the result of cross_validate."""
    return diagnostics.run(parameters.outliers.diagnostics, validated["context"], diagnostics.OUTLIERS)


def run_diagnostics(parameters: Parameters, observed: DataFrame, predicted: DataFrame, continuous: Sequence[str], tables: dict[str, DataFrame] | None = None, settings: dict | None = None) -> dict[str, dict[str, DataFrame]]:
    """Accuracy diagnostics on tables that are there already."""
    context = diagnostics.Context({"observed": observed, "independent": predicted} | (tables or {}), list(continuous), bins=parameters.accuracy.bins, bin_method=parameters.accuracy.bin_method, **(settings or {}))
    return diagnostics.run(parameters.accuracy.diagnostics, context, diagnostics.ACCURACY)


def new_targets(parameters: Parameters, model: ordination.Ordination, env: DataFrame, targets: DataFrame, attributes: DataFrame, continuous: Sequence[str], crosswalk: DataFrame | None = None, categorical: Sequence[str] = (), species: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Neighbors of the ids of a target table, and from them, with all groups of attributes,
    ``dependent`` and ``independent`` predictions and zonal records. ``targets`` has id, and
    place where its order matters; predictions then have an id's first place. Without a
    crosswalk there are no independent tables. ``neighbors`` is persisted; release it when
    the tables are written."""
    order = targets.groupBy("id").agg(F.min("place").alias("place")) if "place" in targets.columns else targets.select("id").distinct()
    near = find_neighbors(parameters, model, env.join(order.select("id"), "id", "left_semi")).persist()
    out = {"neighbors": near}
    for name, own in [("dependent", None), *([("independent", crosswalk)] if crosswalk is not None else [])]:
        left = near if own is None else neighbors.independent(near, own)
        out[name] = predictions(parameters, near, attributes, continuous, categorical, species, own).join(order, "id")
        out[f"zonal_{name}"] = imputing.zonal(left, parameters.imputation.k)
    return out | {"predicted": out["dependent"]}


def write_new_targets(found: dict[str, DataFrame], predicted_prefix: str, zonal_prefix: str, id_col: str = "FCID") -> None:
    """The tables of new_targets as CSV files under the names that a command line gives:
    predictions in the order of the target list (else of ids), records in that of ids."""
    for name in ("independent", "dependent"):
        if name not in found:
            continue
        own = found[name]
        order = own.orderBy("place", "id").drop("place") if "place" in own.columns else own.orderBy("id")
        table_files.write_csv(order.withColumnRenamed("id", id_col), f"{predicted_prefix}_{name}.csv")
        table_files.write_zonal(found[f"zonal_{name}"].orderBy("id", "pixel_number", "neighbor"), f"{zonal_prefix}_pixel_{name}.csv", id_col)


def build_attribute_raster(near: DataFrame, attributes: DataFrame, attribute: str, mask: DataFrame, k: int, scalar: float = 1.0, weights: Sequence[float] | None = None) -> DataFrame:
    """Attribute raster from neighbor pixels (row, col, rank, neighbor_id). Seven neighbors
    have their own weights, other numbers equal ones unless weights are given."""
    weights = weights or (imputing.SEVEN_WEIGHTS if k == 7 else [1.0] * k)
    return imputing.attribute_raster(near, attributes.select("id", F.col(attribute).cast("double").alias("value")), mask, weights, scalar)


def impute(parameters: Parameters, model: ordination.Ordination, stack: DataFrame) -> DataFrame:
    """Wall to wall: row, col, rank, neighbor_id, distance of every pixel of a stack of
    covariates (row, col, variables)."""
    # a pixel's id is negative, so that no plot is taken for the pixel's own
    env = stack.withColumns({"id": -1 - (F.shiftleft(F.col("row").cast("long"), 31) + F.col("col")), "pixel_number": F.lit(1)})
    place = -1 - F.col("id")
    return find_neighbors(parameters, model, env).select(F.shiftright(place, 31).cast("int").alias("row"), F.pmod(place, F.lit(1 << 31)).cast("int").alias("col"), "rank", "neighbor_id", "distance")


def footprint_environment(spark: SparkSession, plots: DataFrame, footprints: list[rasters.Footprint], geometry: rasters.Geometry, stack: DataFrame, variables: list[str], use_kernel: bool = False) -> DataFrame:
    """Covariates of the pixels around plots, as input of find_neighbors."""
    return rasters.extract(rasters.plot_pixels(plots, rasters.footprint_table(spark, footprints, use_kernel), geometry), stack, variables)
