"""Diagnostics: functions from tables to a result table, by key.

A diagnostic gets a context (tables by name and settings) and names the tables that it needs;
one whose tables are missing is skipped with a message and the others run.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrid.operators import accuracy, binning, classify, impute, neighbors
from mossgrid.sources import tables

log = logging.getLogger(__name__)

#: Values, observed and predicted, that natural breaks of regional areas are made from, about.
NATURAL_SAMPLE = 40_000


@dataclass
class Context:
    """Tables by name (all keyed by ``id``) and settings of an assessment."""

    tables: dict[str, DataFrame]
    continuous: list[str] = field(default_factory=list)
    categorical: dict[str, list[int]] = field(default_factory=dict)
    species: list[str] = field(default_factory=list)
    bins: int = 10
    bin_method: str = "EQUAL_INTERVAL"
    k: int = 1
    weights: str | list[float] = "INVERSE_DISTANCES"
    k_values: list[int] = field(default_factory=lambda: [1])
    k_weights: dict[int, str | list[float]] = field(default_factory=dict)  # weights of a k, if it has its own
    hex_levels: dict[str, int] = field(default_factory=dict)  # column of the hex table: least plots
    index_threshold: float = 100.0
    max_neighbors: int = 100
    deviations: dict[str, float] = field(default_factory=dict)
    class_inputs: tuple[str, str, str] = ("QMD_DOM", "BAH_PROP", "CANCOV")
    given_bins: dict[str, list[float]] = field(default_factory=dict)  # edges, e.g. of tables.read_bins


@dataclass(frozen=True)
class Diagnostic:
    needs: tuple[str, ...]
    run: Callable[[Context], dict[str, DataFrame]]


def _pairs(c: Context, names: list[str], predicted: str = "independent") -> DataFrame:
    return accuracy.long_pairs(c.tables["observed"], c.tables[predicted], "id", names)


def local(c: Context) -> dict[str, DataFrame]:
    return {"local_accuracy": accuracy.local_accuracy(_pairs(c, c.continuous))}


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("there is no variable to assess")
    return out


def error_matrices(c: Context, predicted: str = "independent") -> dict[str, DataFrame]:
    """Binned error matrices and bins of all variables."""
    spark = c.tables["observed"].sparkSession
    matrices, bins = [], []
    for name in [*c.continuous, *c.categorical]:
        pairs = accuracy.pair(c.tables["observed"], c.tables[predicted], "id", [name])
        if name in c.given_bins:
            edges = binning.custom_edges(c.given_bins[name])
        elif name in c.categorical:
            edges = binning.code_edges(c.categorical[name])
        else:
            both = pairs.select(F.col(f"{name}_O").alias("v")).unionByName(pairs.select(F.col(f"{name}_P").alias("v")))
            edges = binning.edges_by(c.bin_method, both, "v", c.bins)
        matrices.append(binning.error_matrix_binned(pairs, F.col(f"{name}_O"), F.col(f"{name}_P"), edges).withColumn("variable", F.lit(name)))
        bins.append(spark.createDataFrame([(name, k + 1, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "variable string, class int, low double, high double"))
    return {"error_matrix": _union(matrices), "bins": _union(bins)}


def species(c: Context) -> dict[str, DataFrame]:
    return {"species_accuracy": accuracy.species_accuracy(_pairs(c, c.species), "variable", "observed", "predicted")}


def _classes(c: Context, table: DataFrame) -> DataFrame:
    s, h, v = (F.col(x) for x in c.class_inputs)
    return table.select("id", classify.vegclass(s, h, v).alias("class"))


def _class_pairs(c: Context, predicted: str = "independent") -> DataFrame:
    o, p = _classes(c, c.tables["observed"]), _classes(c, c.tables[predicted])
    return o.select("id", F.col("class").alias("observed")).join(p.select("id", F.col("class").alias("predicted")), "id")


def class_accuracy(pairs: DataFrame, fuzzy: DataFrame | None = None, classes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Matrix, totals and kappas of observed and predicted classes; without fuzzy sets a class
    is equal to itself alone. ``classes`` (class): all that the classifier knows, so that those
    without plots have rows too; by default those of the fuzzy sets, or else of the pairs."""
    if classes is None and fuzzy is not None:
        classes = fuzzy.select("class").distinct()
    matrix = classify.error_matrix(pairs, classes)
    out = {"class_matrix": matrix, "class_totals": classify.totals(matrix, fuzzy), "kappa": classify.kappa(matrix), "kappa_by_class": classify.kappa_by_class(matrix)}
    if fuzzy is not None:
        out |= {"fuzzy_kappa": classify.fuzzy_kappa(matrix, fuzzy), "fuzzy_kappa_by_class": classify.kappa_by_class(matrix, fuzzy)}
    return out


def vegclass(c: Context) -> dict[str, DataFrame]:
    pairs = _class_pairs(c)
    return {"class_pairs": pairs} | class_accuracy(pairs, classify.fuzzy_table(pairs.sparkSession))


def regional(c: Context) -> dict[str, DataFrame]:
    """Areas per bin of the observed plots and of predicted pixels, adjusted areas, and what
    they are made from: plots with their predictions, error matrices and bins.
    ``area``: id, HECTARES, attributes; ``raster``: variable, value, area."""
    special, plots = classify.sentinel_areas(c.tables["area"], "id", "HECTARES")
    areas, adjusted, matrices, bins, plotted = [], [], [], [], []
    for name in c.continuous:
        predicted = c.tables["raster"].where(F.col("variable") == name)
        own = plots.select(F.col(name).cast("double").alias("v"))
        both = own.unionByName(predicted.select(F.col("value").cast("double").alias("v")))
        if c.bin_method == "NATURAL_BREAKS":
            own = binning.systematic_sample(both, "v", NATURAL_SAMPLE)
        edges = binning.edges_by(c.bin_method, both if c.bin_method == "EQUAL_INTERVAL" else own, "v", c.bins)
        first = special.select(F.inline(F.array(F.struct(F.lit("Nonforest").alias("bin_name"), F.col("nonforest").cast("double").alias("area"), F.lit(-1).alias("bin")), F.struct(F.lit("Unsampled").alias("bin_name"), F.col("unsampled").cast("double").alias("area"), F.lit(0).alias("bin")))))
        o, p = binning.weighted_histogram(plots, name, "HECTARES", edges), binning.weighted_histogram(predicted, "value", "area", edges)
        areas.append(first.unionByName(o).withColumns({"dataset": F.lit("OBSERVED"), "variable": F.lit(name)}))
        areas.append(p.withColumns({"dataset": F.lit("PREDICTED"), "variable": F.lit(name)}))
        pairs = accuracy.pair(c.tables["observed"], c.tables["independent"], "id", [name])
        matrix = binning.error_matrix_binned(pairs, F.col(f"{name}_O"), F.col(f"{name}_P"), edges).select(F.col("observed_class").alias("observed"), F.col("predicted_class").alias("predicted"), "n")
        matrices.append(matrix.withColumn("variable", F.lit(name)))
        plotted.append(pairs.select("id", F.lit(name).alias("variable"), F.col(f"{name}_O").cast("double").alias("observed"), F.col(f"{name}_P").cast("double").alias("predicted")))
        bins.append(special.sparkSession.createDataFrame([(name, k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:]), 1)], "variable string, class int, low double, high double"))
        adjusted.append(classify.adjusted_area(matrix, p.select(F.col("bin").alias("class"), "area")).withColumn("variable", F.lit(name)))
    return {"regional_accuracy": _union(areas), "adjusted_area": _union(adjusted), "predicted_plots": _union(plotted), "regional_error_matrix": _union(matrices), "regional_bins": _union(bins)}


def multiscale(c: Context) -> dict[str, DataFrame]:
    """Statistics by k and level: plots, then means and deviations of hexes with enough of
    them. ``hex``: id and a column of hex ids per level. All k come from one imputation, all
    levels from one aggregate, and all statistics from one table of (level, k, variable)."""
    names = c.continuous
    weights = {k: c.k_weights.get(k, c.weights if k == c.k else "INVERSE_DISTANCES") for k in c.k_values}
    predicted = impute.predict_each_k(c.tables["neighbors"], c.tables["observed"], names, weights, c.tables.get("crosswalk")).fillna(0.0, names)
    own = predicted.select("id", "k", *[F.col(n).cast("double").alias(f"{n}_P") for n in names])
    own = c.tables["observed"].select("id", *[F.col(n).cast("double").alias(f"{n}_O") for n in names]).join(own, "id")
    pairs = own.select("id", "k", F.inline(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"{n}_O").alias("observed"), F.col(f"{n}_P").alias("predicted")) for n in names])))
    key = lambda level: F.struct(level.alias("level"), F.col("k"), F.col("variable")).alias("key")
    table = pairs.select(key(F.lit("plot")), "observed", "predicted")
    if c.hex_levels:
        levels = F.array(*[F.struct(F.lit(level).alias("level"), F.col(level).cast("string").alias("hex"), F.lit(least).alias("least")) for level, least in c.hex_levels.items()])
        placed = pairs.join(c.tables["hex"].select("id", levels.alias("levels")), "id").select("k", "variable", "observed", "predicted", F.inline("levels"))
        sums = placed.groupBy("level", "least", "hex", "k", "variable").agg(F.avg("observed").alias("mo"), F.avg("predicted").alias("mp"), F.stddev_pop("observed").alias("so"), F.stddev_pop("predicted").alias("sp"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("least"))
        kinds = F.array(F.struct(F.concat("level", F.lit("_MEAN")).alias("name"), F.col("mo").alias("observed"), F.col("mp").alias("predicted")), F.struct(F.concat("level", F.lit("_STD")).alias("name"), F.col("so").alias("observed"), F.col("sp").alias("predicted")))
        table = table.unionByName(sums.select("k", "variable", F.inline(kinds)).select(key(F.col("name")), "observed", "predicted"))
    found = accuracy.agreement(table, "key", "observed", "predicted").join(accuracy.ks(table, "key", "observed", "predicted"), "key")
    stats = ["gmfr_a", "gmfr_b", "ac", "ac_sys", "ac_uns", "ks_max", "ks_mean"]
    return {"multiscale_accuracy": found.select("key.level", "key.k", "key.variable", F.inline(F.array(*[F.struct(F.lit(s.upper()).alias("statistic"), F.col(s).cast("double").alias("value")) for s in stats])))}


def validation(c: Context) -> dict[str, DataFrame]:
    """Predictions of held-out plots from all neighbors, with local and class accuracy."""
    predicted = impute.predict(c.tables["validation_neighbors"], c.tables["observed"], c.continuous, c.k, c.weights)
    own = Context(c.tables | {"observed": c.tables["validation"], "independent": predicted}, c.continuous, class_inputs=c.class_inputs)
    out = {"predicted": predicted} | local(own)
    return out | (vegclass(own) if set(c.class_inputs) <= set(c.continuous) else {})


def _kinds(c: Context, one: Callable[[str], DataFrame]) -> DataFrame:
    return _union(one(kind).withColumn("prediction_type", F.lit(kind.upper())) for kind in ("independent", "dependent"))


def index_outliers(c: Context) -> dict[str, DataFrame]:
    found = neighbors.self_position(c.tables["neighbors"], c.max_neighbors)
    return {"nn_index_outlier": found.where(F.col("average_position") >= c.index_threshold)}


def class_outliers(c: Context) -> dict[str, DataFrame]:
    return {"vegclass_outlier": _kinds(c, lambda kind: classify.severity(_class_pairs(c, kind)).where("severity <> 'green'"))}


def class_variety(c: Context) -> dict[str, DataFrame]:
    classes = _classes(c, c.tables["observed"])

    def one(kind: str) -> DataFrame:
        near = c.tables["neighbors"]
        if kind == "independent" and "crosswalk" in c.tables:
            near = neighbors.independent(near, c.tables["crosswalk"])
        return classify.variety(neighbors.top_k(near, 1), classes).select("id")

    return {"vegclass_variety": _kinds(c, one)}


def deviation_outliers(c: Context) -> dict[str, DataFrame]:
    spark = c.tables["observed"].sparkSession
    least = spark.createDataFrame(list(c.deviations.items()), "variable string, min_deviation double")
    o, p = F.col("observed"), F.col("predicted")
    return {"variable_deviation_outlier": _kinds(c, lambda kind: accuracy.deviations(_pairs(c, list(c.deviations), kind), least, o, p))}


ACCURACY: dict[str, Diagnostic] = {
    "local_accuracy": Diagnostic(("observed", "independent"), local),
    "error_matrix_accuracy": Diagnostic(("observed", "independent"), error_matrices),
    "species_accuracy": Diagnostic(("observed", "independent"), species),
    "vegclass_accuracy": Diagnostic(("observed", "independent"), vegclass),
    "regional_accuracy": Diagnostic(("observed", "independent", "area", "raster"), regional),
    "riemann_accuracy": Diagnostic(("observed", "neighbors", "hex"), multiscale),
    "validation_accuracy": Diagnostic(("observed", "validation", "validation_neighbors"), validation),
}
OUTLIERS: dict[str, Diagnostic] = {
    "nn_index_outlier": Diagnostic(("neighbors",), index_outliers),
    "vegclass_outlier": Diagnostic(("observed", "independent", "dependent"), class_outliers),
    "vegclass_variety": Diagnostic(("observed", "neighbors"), class_variety),
    "variable_deviation_outlier": Diagnostic(("observed", "independent", "dependent"), deviation_outliers),
}


def run(keys: Iterable[str], context: Context, registry: dict[str, Diagnostic]) -> dict[str, dict[str, DataFrame]]:
    """Results by key; unknown keys and those with missing tables are told and skipped."""
    out = {}
    for key in keys:
        own = registry.get(key)
        if own is None:
            log.warning("%s is not a diagnostic", key)
            continue
        missing = [t for t in own.needs if t not in context.tables]
        if missing:
            log.warning("%s is skipped, without %s", key, ", ".join(missing))
            continue
        out[key] = own.run(context)
    return out


def classification_accuracy(table: DataFrame, observed: str = "OBSERVED", predicted: str = "PREDICTED", fuzzy: DataFrame | None = None) -> dict[str, DataFrame]:
    """Class accuracy of a table of class pairs."""
    accuracy.require_columns(table, [observed, predicted])
    return class_accuracy(table.select(F.col(observed).alias("observed"), F.col(predicted).alias("predicted")), fuzzy)


def write(results: dict[str, dict[str, DataFrame]], folder: str, decimals: int = 6) -> None:
    """Every result as CSV below ``folder``, in the file convention."""
    for own in results.values():
        for name, df in own.items():
            tables.write_csv(df, f"{folder.rstrip('/')}/{name}", decimals)


def annotation(o: Column, p: Column) -> dict[str, Column]:
    """What a scatter plot of predicted against observed is annotated with."""
    from mossgrid.functions import stats

    return {"pearson_r": stats.pearson(o, p), "rmse": stats.rmse(o, p), "normalized_rmse": stats.normalized_rmse(o, p), "bias_percentage": stats.bias_percentage(o, p), "r_square": stats.r_square(o, p)}
