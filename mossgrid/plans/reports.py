"""Results of diagnostics in the fixed formats of their files.

Each file has its columns in order, each with a heading and, for numbers, its decimals; rows are
in a fixed order. A result may also be pivoted (the matrix of classes with totals). Nulls, NaN
and booleans are written as everywhere (``tables.csv_ready``); ``pivoted`` leaves cells blank.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrid.operators import classify
from mossgrid.sources import tables


@dataclass(frozen=True)
class Field:
    """A column of a file: heading, where it comes from, decimals (None: as it is)."""

    heading: str
    source: str | Callable[[], Column]
    decimals: int | None = None

    def column(self) -> Column:
        return (F.col(self.source) if isinstance(self.source, str) else self.source()).alias(self.heading)


@dataclass(frozen=True)
class Format:
    fields: tuple[Field, ...]
    order: tuple[str, ...]  # of the result's columns

    def of(self, df: DataFrame) -> DataFrame:
        """The file's columns in order, rows in order, numbers in their decimals."""
        own = df.orderBy(*self.order).select(*[f.column() for f in self.fields])
        return tables.csv_ready(own, {f.heading: f.decimals for f in self.fields if f.decimals is not None})


def _fields(columns: str, decimals: int | None = None) -> tuple[Field, ...]:
    """Fields from ``HEADING=source`` entries; without a source it is the heading in lower case."""
    parts = [c.partition("=") for c in columns.split()]
    return tuple(Field(a, b or a.lower(), decimals) for a, _, b in parts)


_VARIABLE = _fields("VARIABLE")
_BINS = Format(_VARIABLE + _fields("CLASS") + _fields("LOW HIGH", 4), ("variable", "class"))


def _matrix(observed: str, predicted: str) -> Format:
    return Format(_VARIABLE + (Field("OBSERVED_CLASS", observed), Field("PREDICTED_CLASS", predicted), Field("COUNT", "n")), ("variable", predicted, observed))


def formats(id_col: str = "FCID") -> dict[str, Format]:
    """Formats by name of result. Headings and decimals of the files."""
    own = (Field(id_col, "id"),)
    kind = _fields("PREDICTION_TYPE")
    return {
        "local_accuracy": Format(_VARIABLE + _fields("PEARSON_R SPEARMAN_R RMSE NORMALIZED_RMSE BIAS_PERCENTAGE R_SQUARE", 6), ("variable",)),
        "species_accuracy": Format(
            (Field("SPECIES", "variable"), *_fields("OP_PP=n_pp OP_PA=n_pa OA_PP=n_ap OA_PA=n_aa"))
            + _fields("PREVALENCE SENSITIVITY FALSE_NEGATIVE_RATE SPECIFICITY FALSE_POSITIVE_RATE PERCENT_CORRECT ODDS_RATIO KAPPA", 4),
            ("variable",),
        ),
        "error_matrix": _matrix("observed_class", "predicted_class"),
        "bins": _BINS,
        "regional_accuracy": Format(_VARIABLE + _fields("DATASET BIN_NAME") + _fields("AREA", 3), ("variable", "dataset", "bin")),
        "regional_bins": _BINS,
        "regional_error_matrix": _matrix("observed", "predicted"),
        "adjusted_area": Format(_VARIABLE + _fields("CLASS") + _fields("MAPPED ADJUSTED CI_ADJUSTED=ci", 4), ("variable", "class")),
        "multiscale_accuracy": Format(_fields("LEVEL K VARIABLE STATISTIC") + _fields("VALUE", 4), ("level", "k", "variable", "statistic")),
        "nn_index_outlier": Format(own + _fields("AVERAGE_POSITION", 4), ("id",)),
        "class_pairs": Format(own + _fields("OBSERVED PREDICTED"), ("id",)),
        "vegclass_outlier": Format(own + kind + _fields("OBSERVED_VEGCLASS=observed PREDICTED_VEGCLASS=predicted OUTLIER_TYPE=severity"), ("prediction_type", "id")),
        "vegclass_variety": Format(own + kind, ("prediction_type", "id")),
        "variable_deviation_outlier": Format(
            own + kind + _VARIABLE + _fields("OBSERVED_VALUE=observed PREDICTED_VALUE=predicted", 4) + (Field("DEVIATION", lambda: F.col("observed") - F.col("predicted"), 4),),
            ("prediction_type", "variable", "id"),
        ),
        "kappas": Format((Field("CLASS", "name"), *_fields("KAPPA FUZZY_KAPPA", 4)), ("whole", "class")),
    }


def kappas(results: dict[str, DataFrame]) -> DataFrame:
    """Kappa and fuzzy kappa by class, and of all classes, from the results of class accuracy;
    without fuzzy sets both are the same."""
    fuzzy = results.get("fuzzy_kappa_by_class", results["kappa_by_class"]), results.get("fuzzy_kappa", results["kappa"])
    each = results["kappa_by_class"].join(fuzzy[0].select("class", F.col("kappa").alias("fuzzy_kappa")), "class")
    whole = results["kappa"].crossJoin(fuzzy[1].select(F.col("kappa").alias("fuzzy_kappa")))  # one row each
    each = each.select(F.col("class").cast("string").alias("name"), F.col("class").cast("int").alias("class"), F.lit(0).alias("whole"), "kappa", "fuzzy_kappa")
    return each.unionByName(whole.select(F.lit("ALL").alias("name"), F.lit(0).alias("class"), F.lit(1).alias("whole"), "kappa", "fuzzy_kappa"))


def pivoted(matrix: DataFrame, classes: list[int], fuzzy: DataFrame | None = None) -> DataFrame:
    """The matrix of observed (rows) by predicted classes with totals, percents correct and
    percents fuzzily correct of rows, columns and all, as text: label, one column for each
    class, Total, % Correct, % FCorrect. Rows come in order of ``place``."""
    names = [str(c) for c in classes]
    last = ["Total", "% Correct", "% FCorrect"]
    count, percent = (lambda c: c.cast("string")), (lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(0.0))))
    sums = classify.totals(matrix, fuzzy)
    rows = matrix.groupBy("observed").pivot("predicted", classes).agg(F.sum("n")).fillna(0).join(sums.where("predicted IS NULL AND observed IS NOT NULL").drop("predicted"), "observed")
    body = rows.select(F.array_position(F.array(*map(F.lit, classes)), F.col("observed")).cast("int").alias("place"), F.col("observed").cast("string").alias("label"), *[count(F.col(f"`{n}`")).alias(n) for n in names], *[c.alias(n) for n, c in zip(last, (count(F.col("n")), percent(F.col("percent_correct")), percent(F.col("percent_fuzzy"))))])
    ends = sums.where("observed IS NULL").select(F.coalesce(F.col("predicted").cast("string"), F.lit("all")).alias("class"), F.inline(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(label).alias("label"), value.alias("value")) for k, (label, value) in enumerate(zip(last, (count(F.col("n")), percent(F.col("percent_correct")), percent(F.col("percent_fuzzy")))))])))
    foot = ends.groupBy("place", "label").pivot("class", [*names, "all"]).agg(F.first("value"))
    corner = [F.when(F.col("place") == k, F.col("all")).otherwise("").alias(n) for k, n in enumerate(last)]
    foot = foot.select((F.col("place") + len(classes) + 1).alias("place"), "label", *[F.col(f"`{n}`") for n in names], *corner)
    return body.unionByName(foot)


def write(results: dict[str, dict[str, DataFrame]], folder: str, id_col: str = "FCID", places: dict[str, str] | None = None, classes: list[int] | None = None, fuzzy: DataFrame | None = None) -> list[str]:
    """Every result that has a format as a CSV folder of one file, below ``folder`` or at its
    place in ``places``; class accuracy as pairs, kappas and, with ``classes``, the pivoted
    matrix. Returns the names written. Results without a format are left to the caller."""
    known, done = formats(id_col), []

    def put(name: str, df: DataFrame) -> None:
        path = (places or {}).get(name, f"{folder.rstrip('/')}/{name}.csv")
        df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
        done.append(name)

    for own in results.values():
        for name, df in own.items():
            if name in known:
                put(name, known[name].of(df))
        if {"kappa", "kappa_by_class", "class_matrix"} <= set(own):
            put("kappas", known["kappas"].of(kappas(own)))
            if classes:
                put("class_matrix", pivoted(own["class_matrix"], classes, fuzzy).orderBy("place").drop("place").withColumnRenamed("label", " "))
    return done
