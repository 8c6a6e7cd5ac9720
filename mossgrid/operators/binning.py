"""Class edges, digitizing, and histograms.

Edges are small lists on the driver; they come from aggregates (min and max, exact
percentiles, counts per value) and never from collected rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering

#: Added to the last edge so that the greatest value falls into the last class.
TOP = 1e-4


def span(df: DataFrame, *values: str) -> tuple[float, float]:
    """Least and greatest of some columns."""
    row = df.agg(F.least(*[F.min(v) for v in values], F.lit(math.inf)).alias("lo"), F.greatest(*[F.max(v) for v in values], F.lit(-math.inf)).alias("hi")).first()
    return float(row["lo"]), float(row["hi"])


def equal_edges(lo: float, hi: float, bins: int) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, bins + 1)]


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def weighted_quantiles(counts: DataFrame, shares: Sequence[float], value: str = "value", n: str = "n") -> list[float]:
    """Linear quantiles of values repeated ``n`` times, without repeating them: the wanted
    places are looked up in the running count of distinct values."""
    total = counts.agg(F.sum(n).alias("n")).first()["n"] or 0
    if not total:
        return []
    places = sorted({k for q in shares for k in (math.floor(q * (total - 1)), min(total - 1, math.floor(q * (total - 1)) + 1))})
    run = ordering.running(counts, [], value, n).withColumn("_c", F.col("before") + F.col(n))
    hit = run.agg(*[F.min(F.when(F.col("_c") > k, F.col(value))).alias(str(k)) for k in places]).first()
    found = {k: float(hit[str(k)]) for k in places}
    out = []
    for q in shares:
        h = q * (total - 1)
        a, b = found[math.floor(h)], found[min(total - 1, math.floor(h) + 1)]
        out.append(a + (b - a) * (h - math.floor(h)))
    return out


def quantile_edges(df: DataFrame, value: str, bins: int = 10) -> list[float]:
    """Quantile edges; while edges repeat, the least repeated value is taken out of the data,
    the rest is cut into one class less, and the value comes back as an edge. Works on counts
    per value, so rows are read once."""
    counts = value_counts(df, value).persist()
    taken: list[float] = []
    try:
        while True:
            left = counts.where(~F.col("value").isin(taken)) if taken else counts
            total = left.agg(F.sum("n").alias("n")).first()["n"] or 0
            if total <= bins:
                rows = left.select(F.explode(F.array_repeat("value", F.col("n").cast("int"))).alias("value"))
                return sorted([r["value"] for r in rows.collect()] + taken)  # at most ``bins`` rows
            edges = weighted_quantiles(left, [k / bins for k in range(bins + 1)])
            repeated = sorted({e for e in edges if edges.count(e) > 1})
            if not repeated or bins <= 1:
                return sorted(set(edges) | set(taken))
            taken.append(repeated[0])
            bins -= 1
    finally:
        counts.unpersist()


def jenks(values: np.ndarray, counts: np.ndarray, classes: int) -> list[float]:
    """Fisher's optimal breaks of sorted distinct values with counts: edges that give the
    least sum of squares within classes (dynamic programme over distinct values)."""
    m = len(values)
    if classes > m:
        return [float(x) for x in values] + [float(values[-1])] * (classes - m)
    w, s, q = (np.concatenate([[0.0], np.cumsum(c)]) for c in (counts, counts * values, counts * values * values))
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = np.zeros((classes + 1, m + 1), dtype=int)
    for k in range(1, classes + 1):
        new = np.full(m + 1, np.inf)
        for j in range(k, m + 1):
            i = np.arange(k - 1, j)
            cost = best[i] + np.maximum(0, q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i]))
            at = int(np.argmin(cost))
            new[j], back[k, j] = cost[at], i[at]
        best = new
    edges, j = [float(values[-1])], m
    for k in range(classes, 0, -1):
        j = back[k, j]
        edges.append(float(values[j - 1]) if j else float(values[0]))
    return edges[::-1]


def _jenks_many(values: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray, classes: int) -> list[int]:
    """Fisher's optimal breaks for many ordered groups, each with its greatest value, count,
    sum and sum of squares: the groups that end the classes. The best break never moves back
    as the end moves on, so a layer is made by halving, all halves of a level at once."""
    m = len(values)
    w, s, q = (np.concatenate([[0.0], np.cumsum(c)]) for c in (n, total, squares))
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = np.zeros((classes + 1, m + 1), dtype=np.int32)
    for k in range(1, classes + 1):
        new = np.full(m + 1, np.inf)
        lo, hi, a, b = (np.array([x]) for x in (k, m, k - 1, m - 1))
        while len(lo):
            mid = (lo + hi) // 2
            size = np.minimum(b, mid - 1) - a + 1
            begin = np.cumsum(size) - size
            i, j = np.arange(int(size.sum())) + np.repeat(a - begin, size), np.repeat(mid, size)
            cost = best[i] + np.maximum(0, q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i]))
            least = np.minimum.reduceat(cost, begin)
            at = np.flatnonzero(cost == np.repeat(least, size))
            at = i[at[np.searchsorted(at, begin)]]  # the first of equals
            new[mid], back[k, mid] = least, at
            lo, hi, a, b = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([a, at]), np.concatenate([at, b])
            left = lo <= hi
            lo, hi, a, b = lo[left], hi[left], a[left], b[left]
        best = new
    ends, j = [], m
    for k in range(classes, 0, -1):
        ends.append(j)
        j = int(back[k, j])
    return [x - 1 for x in ends[::-1]]


def _placed(counts: DataFrame) -> DataFrame:
    """value, n and a, the rows before the value, of counts per value."""
    return ordering.running(counts, [], "value", "n", "a").select("value", "n", "a")


def natural_edges(df: DataFrame, value: str, bins: int = 10, most: int = 2000, exact: int = 500_000) -> list[float]:
    """Natural breaks over all distinct values with their counts. Beyond ``exact`` distinct
    values, about as many groups of neighboring values stand for them, with their exact
    counts, sums and sums of squares; a break then lies between two groups."""
    counts = value_counts(df, value)
    about = counts.agg(F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("s"), F.min("value").alias("least"), F.count(F.lit(1)).alias("kinds")).first()
    if not about["n"]:
        return []
    if about["kinds"] <= most:
        rows = counts.orderBy("value").collect()
        return jenks(np.array([r["value"] for r in rows]), np.array([float(r["n"]) for r in rows]), bins)
    off = F.col("value") - F.lit(about["s"] / about["n"])  # from the mean, or squares lose digits
    sums = [F.max("value").alias("top"), F.sum("n").alias("w"), F.sum(off * F.col("n")).alias("s"), F.sum(off * off * F.col("n")).alias("q")]
    if about["kinds"] <= exact:
        groups = counts.groupBy("value").agg(*sums)
    else:
        groups = _placed(counts).groupBy(F.floor(F.col("a") * F.lit(exact / about["n"])).alias("g")).agg(*sums)
    rows = groups.select("top", "w", "s", "q").toArrow().sort_by("top")
    top, w, s, q = (rows[c].to_numpy().astype(np.float64) for c in ("top", "w", "s", "q"))
    return [float(about["least"]), *(float(top[k]) for k in _jenks_many(top, w, s, q, bins))]


def custom_edges(edges: Sequence[float]) -> list[float]:
    """Given edges; a single one is doubled."""
    out = [float(x) for x in edges]
    if len(out) == 1:
        out = out * 2
    if any(b < a for a, b in zip(out, out[1:])):
        raise ValueError("edges must not fall")
    return out


def code_edges(codes: Sequence[int]) -> list[float]:
    """Edges for coded classes: the codes and one beyond; classes are then ordinals."""
    own = sorted(set(codes))
    return [float(x) for x in own] + [float(own[-1] + 1)]


def edges_by(method: str, df: DataFrame, value: str, bins: int) -> list[float]:
    """EQUAL_INTERVAL, QUANTILE or NATURAL_BREAKS."""
    if method == "EQUAL_INTERVAL":
        return equal_edges(*span(df, value), bins)
    if method == "QUANTILE":
        return quantile_edges(df, value, bins)
    if method == "NATURAL_BREAKS":
        return natural_edges(df, value, bins)
    raise ValueError(f"unknown method {method}")


def digitize(value: Column, edges: Sequence[float], raise_top: bool = True) -> Column:
    """Class i where edge[i-1] <= value < edge[i], from 1; outside: null. The last edge is
    raised a little so that the greatest value has a class."""
    own = [float(x) for x in edges]
    if raise_top:
        own[-1] += TOP
    out = F.when(value < own[0], F.lit(None).cast("int"))
    for k, edge in enumerate(own[1:], 1):
        out = out.when(value < edge, F.lit(k))
    return out


def histogram_bin(value: Column, edges: Sequence[float]) -> Column:
    """Bin from 1 where only the last bin is closed on the right; outside: null."""
    out = F.when((value < float(edges[0])) | (value > float(edges[-1])), F.lit(None).cast("int"))
    for k, edge in enumerate(edges[1:-1], 1):
        out = out.when(value < float(edge), F.lit(k))
    return out.when(value.isNotNull(), F.lit(len(edges) - 1))


def labels(edges: Sequence[float]) -> list[str]:
    """Bin names: one decimal, or exponents for large edges."""
    form = "%.1e" if edges[-1] >= 1e5 else "%.1f"
    text = [(form % e).replace("e+0", "e") for e in edges]
    # a lower edge that shows as zero is plainly so, also where others have exponents
    return [f"{'0.0' if float(a) == 0 else a}-{b}" for a, b in zip(text, text[1:])]


def weighted_histogram(df: DataFrame, value: str, weight: str, edges: Sequence[float]) -> DataFrame:
    """bin, area: sums of weights; empty bins are there with 0."""
    names = df.sparkSession.createDataFrame(list(enumerate(labels(edges), 1)), "bin int, bin_name string")
    sums = df.select(histogram_bin(F.col(value), edges).alias("bin"), F.col(weight).alias("w")).groupBy("bin").agg(F.sum("w").alias("area"))
    return names.join(sums, "bin", "left").select("bin", "bin_name", F.coalesce("area", F.lit(0.0)).alias("area"))


def categorical_histogram(observed: DataFrame, predicted: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Counts (or weights) of each class on both sides; classes of either side."""
    one = F.col(weight) if weight else F.lit(1)
    both = observed.select(F.col(value).alias("class"), one.alias("o"), F.lit(0).alias("p")).unionByName(predicted.select(F.col(value).alias("class"), F.lit(0).alias("o"), one.alias("p")))
    return both.groupBy("class").agg(F.sum("o").alias("observed"), F.sum("p").alias("predicted"))


def error_matrix_binned(pairs: DataFrame, o: Column, p: Column, edges: Sequence[float]) -> DataFrame:
    """Cross-tabulated classes of both sides, all pairs, empty ones with 0."""
    n = len(edges) - 1
    counts = pairs.select(digitize(o, edges).alias("observed_class"), digitize(p, edges).alias("predicted_class")).groupBy("observed_class", "predicted_class").agg(F.count(F.lit(1)).alias("n"))
    grid = pairs.sparkSession.range(n * n).select((F.floor(F.col("id") / n) + 1).cast("int").alias("observed_class"), (F.col("id") % n + 1).cast("int").alias("predicted_class"))
    return grid.join(counts, ["observed_class", "predicted_class"], "left").select("observed_class", "predicted_class", F.coalesce("n", F.lit(0)).alias("n"))


def unique_values(df: DataFrame, value: str) -> DataFrame:
    return df.select(value).where(F.col(value).isNotNull()).distinct()


def systematic_sample(df: DataFrame, value: str, most: int) -> DataFrame:
    """About ``most`` rows at equal steps of the sorted values, with the least and greatest.

    Places come from running counts, so no task sorts all rows. Fewer rows than ``most``: all of them."""
    counts = value_counts(df, value)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    step = max(1, total // most)
    placed = _placed(counts)
    hits = F.floor((F.col("a") + F.col("n") - 1) / step) - F.floor((F.col("a") - 1) / step)
    last = ((F.col("a") + F.col("n") == total) & F.lit((total - 1) % step != 0)).cast("int")
    return placed.select("value", (hits + last).cast("int").alias("k")).where("k > 0").select(F.explode(F.array_repeat("value", F.col("k"))).alias(value))
