"""Accuracy statistics as aggregate expressions over an observed and a predicted column.

Every function gives a Column for ``groupBy(...).agg(...)``. Sums combine before the shuffle;
undefined cases follow the documented conventions instead of raising under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_zero(x: Column) -> Column:
    return F.max(F.abs(x)) == 0


def rmse(o: Column, p: Column) -> Column:
    """Root mean squared error; 0 if either side is all zero."""
    return F.when(all_zero(o) | all_zero(p), F.lit(0.0)).otherwise(F.sqrt(F.avg((o - p) * (o - p))))


def normalized_rmse(o: Column, p: Column) -> Column:
    """RMSE over the mean of the observed; 0 if the observed are all zero."""
    return F.when(all_zero(o), F.lit(0.0)).otherwise(F.try_divide(rmse(o, p), F.avg(o)))


def bias_percentage(o: Column, p: Column) -> Column:
    return F.when(all_zero(o) | all_zero(p), F.lit(0.0)).otherwise(F.try_divide(F.sum(p - o), F.sum(o)) * F.lit(100.0))


def pearson(o: Column, p: Column) -> Column:
    """Pearson's r; 0 if either side is all zero, else null where a side does not vary."""
    return F.when(all_zero(o) | all_zero(p), F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(o, p), F.stddev_pop(o) * F.stddev_pop(p)))


def r_square(o: Column, p: Column) -> Column:
    """1 - SSE/SST about the mean of the observed; can be negative."""
    return F.when(all_zero(o) | all_zero(p), F.lit(0.0)).otherwise(F.lit(1.0) - F.try_divide(F.sum((o - p) * (o - p)), F.var_pop(o) * F.count(o)))


def regression(x: Column, y: Column) -> dict[str, Column]:
    """Slopes and intercepts of y on x (normal), x on y turned around (inverse), and reduced
    major axis (rma)."""
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    slopes = {"normal": F.try_divide(sxy, sxx), "inverse": F.try_divide(syy, sxy), "rma": F.sqrt(F.try_divide(syy, sxx))}
    out = {}
    for kind, slope in slopes.items():
        out[f"{kind}_slope"] = slope
        out[f"{kind}_intercept"] = F.avg(y) - slope * F.avg(x)
    return out


def gmfr(x: Column, y: Column) -> tuple[Column, Column]:
    """Geometric mean functional relationship: intercept and slope."""
    slope = F.sqrt(F.try_divide(F.var_pop(y), F.var_pop(x)))
    return F.avg(y) - slope * F.avg(x), slope


def binary_counts(o: Column, p: Column) -> dict[str, Column]:
    """The four cells of a presence/absence matrix."""
    return {"n_pp": F.count_if(o & p), "n_pa": F.count_if(o & ~p), "n_ap": F.count_if(~o & p), "n_aa": F.count_if(~o & ~p)}


def binary_statistics(pp: Column, pa: Column, ap: Column, aa: Column) -> dict[str, Column]:
    """From the cells (observed, predicted): prevalence to kappa."""
    n = pp + pa + ap + aa
    sensitivity = F.coalesce(F.try_divide(pp, pp + pa), F.lit(1.0))
    specificity = F.coalesce(F.try_divide(aa, ap + aa), F.lit(1.0))
    chance = F.try_divide((pp + pa) * (pp + ap) + (ap + aa) * (pa + aa), n.cast("double") * n)
    correct = F.try_divide(pp + aa, n)
    return {
        "prevalence": F.try_divide(pp + pa, n), "sensitivity": sensitivity, "false_negative_rate": F.lit(1.0) - sensitivity,
        "specificity": specificity, "false_positive_rate": F.lit(1.0) - specificity, "percent_correct": correct,
        "positive_predictive_power": F.coalesce(F.try_divide(pp, pp + ap), F.lit(1.0)),
        "odds_ratio": F.coalesce(F.try_divide(pp.cast("double") * aa, pa.cast("double") * ap), F.lit(1.0)),
        "true_skill": sensitivity + specificity - F.lit(1.0),
        "kappa": F.when(chance == 1, F.lit(0.0)).otherwise(F.try_divide(correct - chance, F.lit(1.0) - chance)),
    }


def kappa_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cohen's kappa of a collapsed matrix; 0 when all agreement is by chance."""
    n = (a + b + c + d).cast("double")
    chance = F.try_divide((a + b) * (a + c) + (c + d) * (b + d), n)
    return F.when(n == chance, F.lit(0.0)).otherwise(F.try_divide(a + d - chance, n - chance))


def effective_number(x: Column) -> Column:
    """N2 diversity: squared sum over sum of squares."""
    return F.try_divide(F.sum(x) * F.sum(x), F.sum(x * x))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(w))
