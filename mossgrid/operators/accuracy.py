"""Observed against predicted: pairing, ranks, local accuracy, agreement and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrid.functions import stats

from . import ordering


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_no_nulls(df: DataFrame, names: list[str]) -> None:
    """One aggregate over the named columns."""
    found = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first().asDict()
    bad = [c for c, n in found.items() if n]
    if bad:
        raise ValueError(f"null values in: {', '.join(bad)}")


def pair(observed: DataFrame, predicted: DataFrame, id_col: str, variables: list[str] | None = None) -> DataFrame:
    """Rows of ids on both sides, with suffixes _O and _P; by id, never by position."""
    variables = variables or [c for c in observed.columns if c != id_col and c in predicted.columns]
    require_columns(observed, [id_col, *variables])
    require_columns(predicted, [id_col, *variables])
    o = observed.select(id_col, *[F.col(c).alias(f"{c}_O") for c in variables])
    p = predicted.select(id_col, *[F.col(c).alias(f"{c}_P") for c in variables])
    return o.join(p, id_col)


def long_pairs(observed: DataFrame, predicted: DataFrame, id_col: str, variables: list[str] | None = None) -> DataFrame:
    """id, variable, observed, predicted: one join, then one row per variable."""
    variables = variables or [c for c in observed.columns if c != id_col and c in predicted.columns]
    wide = pair(observed, predicted, id_col, variables)
    each = [F.struct(F.lit(c).alias("variable"), F.col(f"{c}_O").cast("double").alias("observed"), F.col(f"{c}_P").cast("double").alias("predicted")) for c in variables]
    return wide.select(id_col, F.inline(F.array(*each)))


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the average rank (ties share their mean) of ``value`` within ``by``; rows without
    a value go. Ranks are made on distinct values and their counts and joined back."""
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return ordering.with_common_spread(known, ordering.average_ranks(counts, by, value, name, "_n"), counts, by, value, "_n")


def spearman(pairs: DataFrame, by: list[str], o: str = "observed", p: str = "predicted") -> DataFrame:
    """Pearson's r of the average ranks; 0 if either side is all zero. Over rows that have
    both values; equal pairs are counted first."""
    kinds = pairs.where(F.col(o).isNotNull() & F.col(p).isNotNull()).groupBy(*by, o, p).agg(F.count(F.lit(1)).alias("_k"))
    ranked = kinds
    for value, name in ((o, "_ro"), (p, "_rp")):  # a common value has few rows here, as many as partners
        counts = kinds.groupBy(*by, value).agg(F.sum("_k").alias("_n"))
        ranked = ranked.join(ordering.average_ranks(counts, by, value, name, "_n"), [*by, value])
    n, x, y = F.col("_k"), F.col("_ro"), F.col("_rp")
    sums = ranked.groupBy(*by).agg(
        F.sum(n).alias("n"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), stats.all_zero(F.col(o)).alias("zero_o"), stats.all_zero(F.col(p)).alias("zero_p"),
    )
    mean = F.col("n") * (F.col("n") + 1.0) * (F.col("n") + 1.0) / 4.0  # ranks have the mean (n + 1) / 2
    r = F.try_divide(F.col("xy") - mean, F.sqrt(F.col("xx") - mean) * F.sqrt(F.col("yy") - mean))
    return sums.select(*by, F.when(F.col("zero_o") | F.col("zero_p"), F.lit(0.0)).otherwise(r).alias("spearman_r"))


def local_accuracy(pairs: DataFrame, by: str = "variable", o: str = "observed", p: str = "predicted") -> DataFrame:
    """Pearson, Spearman, RMSE, normalized RMSE, bias and R square of each variable."""
    x, y = F.col(o), F.col(p)
    rest = pairs.groupBy(by).agg(
        stats.pearson(x, y).alias("pearson_r"), stats.rmse(x, y).alias("rmse"), stats.normalized_rmse(x, y).alias("normalized_rmse"),
        stats.bias_percentage(x, y).alias("bias_percentage"), stats.r_square(x, y).alias("r_square"),
    )
    return rest.join(spearman(pairs, [by], o, p), by)


def regression_lines(pairs: DataFrame, by: str, x: str, y: str) -> DataFrame:
    return pairs.groupBy(by).agg(*[c.alias(k) for k, c in stats.regression(F.col(x), F.col(y)).items()])


def agreement(pairs: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """GMFR line and agreement coefficients (total, systematic, unsystematic); 0 where a side
    does not vary."""
    a, b = stats.gmfr(F.col(x), F.col(y))
    line = pairs.groupBy(by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), a.alias("a"), b.alias("b"))
    both = pairs.join(line, by)
    off, on = F.col(x) - F.try_divide(F.col(y) - F.col("a"), F.col("b")), F.col(y) - (F.col("a") + F.col("b") * F.col(x))
    gap = F.abs(F.col("mx") - F.col("my"))
    sums = both.groupBy(by).agg(
        F.first("a").alias("gmfr_a"), F.first("b").alias("gmfr_b"),
        F.sum((F.col(x) - F.col(y)) * (F.col(x) - F.col(y))).alias("ssd"),
        F.sum(F.abs(off) * F.abs(on)).alias("spdu"),
        F.sum((gap + F.abs(F.col(x) - F.col("mx"))) * (gap + F.abs(F.col(y) - F.col("my")))).alias("spod"),
    )
    ratio = lambda c: F.coalesce(F.lit(1.0) - F.try_divide(c, F.col("spod")), F.lit(0.0))
    return sums.select(by, "gmfr_a", "gmfr_b", ratio(F.col("ssd")).alias("ac"), ratio(F.col("ssd") - F.col("spdu")).alias("ac_sys"), ratio(F.col("spdu")).alias("ac_uns"))


def ks(pairs: DataFrame, by: str, o: str, p: str, points: int = 1000) -> DataFrame:
    """Largest and mean distance of the two distribution functions at equally spaced points
    over the joint range: counts per grid cell, then running sums over the grid. The greatest
    value belongs to the last point, whatever its quotient is rounded to."""
    span = pairs.groupBy(by).agg(F.least(F.min(o), F.min(p)).alias("lo"), F.greatest(F.max(o), F.max(p)).alias("hi"), F.count(F.lit(1)).alias("n"))
    both = pairs.select(by, F.explode(F.array(F.struct(F.col(o).alias("v"), F.lit(1).alias("s")), F.struct(F.col(p).alias("v"), F.lit(-1).alias("s")))).alias("x")).select(by, "x.v", "x.s")
    step = (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    cells = both.join(F.broadcast(span.select(by, "lo", "hi")), by).select(by, F.least(F.coalesce(F.ceil(F.try_divide(F.col("v") - F.col("lo"), step)), F.lit(0)), F.lit(points - 1)).cast("int").alias("g"), "s")
    counts = cells.groupBy(by, "g").agg(F.sum("s").alias("s"))
    grid = span.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g")).join(counts, [by, "g"], "left")
    gap = F.abs(F.sum(F.coalesce("s", F.lit(0))).over(Window.partitionBy(by).orderBy("g"))) / F.col("n")
    return grid.select(by, gap.alias("d")).groupBy(by).agg(F.max("d").alias("ks_max"), F.avg("d").alias("ks_mean"))


def species_accuracy(pairs: DataFrame, by: str, o: str, p: str) -> DataFrame:
    """Presence/absence cells and statistics of each species, from abundances."""
    cells = pairs.groupBy(by).agg(*[c.alias(k) for k, c in stats.binary_counts(F.col(o) > 0, F.col(p) > 0).items()])
    return cells.select(by, "n_pp", "n_pa", "n_ap", "n_aa", *[c.alias(k) for k, c in stats.binary_statistics(*[F.col(c) for c in ("n_pp", "n_pa", "n_ap", "n_aa")]).items()])


def by_region(df: DataFrame, region: str, variables: list[str], least: int) -> DataFrame:
    """Mean, population deviation and count by region and variable; regions of enough rows."""
    each = df.select(region, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in variables])))
    return each.groupBy(region, "variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def deviations(pairs: DataFrame, least: DataFrame, o: Column, p: Column) -> DataFrame:
    """Rows whose deviation reaches their variable's threshold (``least``: variable,
    min_deviation); inclusive, no rows if there are none."""
    return pairs.join(F.broadcast(least), "variable").withColumn("deviation", F.abs(o - p)).where(F.col("deviation") >= F.col("min_deviation")).drop("min_deviation")
