"""Constrained ordination (canonical correspondence and redundancy analysis).

The cluster makes two small cross-product matrices from a long species table and a wide
covariate table: G (covariates by covariates) and C (covariates by species). All else is
linear algebra on matrices as large as the numbers of covariates and species. Collinear
covariates are handled by dropping directions of no extent after scaling.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Ordination:
    """A fitted model: small arrays by axis, and per-site tables."""

    prefix: str
    variables: list[str]
    species: list[str]
    means: np.ndarray
    eigenvalues: np.ndarray
    coefficients: np.ndarray
    biplot: np.ndarray
    centroids: np.ndarray
    total_inertia: float
    tolerances: np.ndarray | None = None
    species_info: list[tuple[str, float, float]] = field(default_factory=list)
    sites: DataFrame | None = None  # id, weight, n2, lc, wa

    @property
    def rank(self) -> int:
        return len(self.eigenvalues)

    def trimmed(self, n_axes: int) -> "Ordination":
        """The first axes only."""
        n = max(1, min(n_axes, self.rank))
        sites = None
        if self.sites is not None:
            sites = self.sites.withColumns({"lc": F.slice("lc", 1, n), "wa": F.slice("wa", 1, n)})
        cut = lambda x: None if x is None else x[:, :n]
        return Ordination(self.prefix, self.variables, self.species, self.means, self.eigenvalues[:n], cut(self.coefficients), cut(self.biplot), cut(self.centroids), self.total_inertia, cut(self.tolerances), self.species_info, sites)


def species_long(matrix: DataFrame, id_col: str, transform: str = "NONE") -> DataFrame:
    """id, species, x of a wide abundance table; zeros are left out. SQRT or LOG transforms;
    a value that the transform does not take raises when read."""
    names = [c for c in matrix.columns if c != id_col]
    each = F.array(*[F.struct(F.lit(c).alias("species"), F.col(c).cast("double").alias("x")) for c in names])
    out = matrix.select(F.col(id_col).alias("id"), F.inline(each))
    if transform == "SQRT":
        return out.withColumn("x", F.sqrt("x")).where("x <> 0")
    if transform == "LOG":
        bad = F.raise_error(F.lit("the logarithm needs positive abundances"))
        return out.withColumn("x", F.when(F.col("x") > 0, F.log("x")).otherwise(bad.cast("double"))).where("x <> 0")
    if transform != "NONE":
        raise ValueError(f"unknown transform {transform}")
    return out.where("x <> 0")


def downweighted(species: DataFrame, fraction: float = 5.0) -> DataFrame:
    """Rare species count less: abundances of a species whose frequency (square of its sum
    over its sum of squares) is below that of the most frequent one divided by ``fraction``
    are multiplied by the ratio of the two. A fraction below 1 is taken as its inverse.
    Null abundances count for nothing and stay; no rows give none."""
    if fraction <= 0:
        raise ValueError("the fraction must be positive")
    often = species.groupBy("species").agg(F.coalesce(F.try_divide(F.sum("x") * F.sum("x"), F.sum(F.col("x") * F.col("x")) + 1e-10), F.lit(0.0)).alias("often"))
    least = often.agg((F.max("often") / F.lit(max(fraction, 1 / fraction))).alias("least"))  # one row
    weight = F.coalesce(F.least(F.try_divide("often", "least"), F.lit(1.0)), F.lit(1.0))
    weights = often.crossJoin(F.broadcast(least)).select("species", weight.alias("weight"))
    return species.join(weights, "species").select("id", "species", (F.col("x") * F.col("weight")).alias("x"))


def check_inputs(species: DataFrame, env: DataFrame) -> None:
    """Same ids on both sides, all sums positive."""
    ids = species.groupBy("id").agg(F.sum("x").alias("s"))
    row = ids.join(env.select("id", F.lit(1).alias("e")), "id", "full").agg(F.count_if(F.col("s").isNull() | F.col("e").isNull()).alias("odd"), F.count_if(F.col("s") <= 0).alias("low")).first()
    if row["odd"]:
        raise ValueError("species and environment have different ids")
    if row["low"] or species.groupBy("species").agg(F.sum("x").alias("s")).where("s <= 0").limit(1).count():
        raise ValueError("a row or column has no positive sum")


def site_info(species: DataFrame) -> DataFrame:
    """id, weight, n2."""
    return species.groupBy("id").agg(F.sum("x").alias("weight"), F.try_divide(F.sum("x") * F.sum("x"), F.sum(F.col("x") * F.col("x"))).alias("n2"))


def species_info(species: DataFrame) -> DataFrame:
    """species, weight, n2."""
    return species.groupBy("species").agg(F.sum("x").alias("weight"), F.try_divide(F.sum("x") * F.sum("x"), F.sum(F.col("x") * F.col("x"))).alias("n2"))


def chi_square_residuals(species: DataFrame) -> DataFrame:
    """id, species, residual of every cell, also of empty ones: (p - r c) / sqrt(r c)."""
    total = species.agg(F.sum("x").alias("t"))
    rows = species.groupBy("id").agg(F.sum("x").alias("rx"))
    columns = species.groupBy("species").agg(F.sum("x").alias("cx"))
    # as wide as the result: every cell has a residual
    grid = rows.crossJoin(columns).join(species, ["id", "species"], "left").crossJoin(total)
    r, c, p = F.col("rx") / F.col("t"), F.col("cx") / F.col("t"), F.coalesce("x", F.lit(0.0)) / F.col("t")
    return grid.select("id", "species", ((p - r * c) / F.sqrt(r * c)).alias("residual"))


def weighted_means(species: DataFrame, env: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row: mean of each covariate, weighted by the sites' abundance."""
    own = species.groupBy("id").agg(F.sum("x").alias("w")).join(env, "id")
    return own.agg(*[(F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(v) for v in variables])


def cross_products(species: DataFrame, env: DataFrame, variables: Sequence[str], weighted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], dict]:
    """means, G, C, species in order, and sums, each from one aggregate.

    Centered covariates times chi-square residuals add up to
    sum over cells of (x/t) y / sqrt(c) only, since weighted centering removes the expected
    part; so empty cells are never made."""
    total = float(species.agg(F.sum("x").alias("t")).first()["t"])
    sites = species.groupBy("id").agg(F.sum("x").alias("w"))
    if not weighted:
        sites = env.select("id").withColumn("w", F.lit(1.0))
    joined = sites.join(env, "id")
    share = joined.agg(F.sum("w").alias("w"), *[(F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(v) for v in variables]).first()
    means = np.array([share[v] for v in variables])
    n = float(share["w"])
    y = [F.col(v) - F.lit(float(m)) for v, m in zip(variables, means)]
    pairs = [(i, j) for i in range(len(y)) for j in range(i, len(y))]
    g_row = joined.agg(*[F.sum(F.col("w") / n * y[i] * y[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(y), len(y)))
    for i, j in pairs:
        g[i, j] = g[j, i] = g_row[f"g{i}_{j}"]
    scale = F.lit(1.0 / total) if weighted else F.lit(1.0)
    c_rows = species.join(env, "id").groupBy("species").agg(F.sum("x").alias("cx"), F.sum(F.col("x") * F.col("x")).alias("cxx"), *[F.sum(F.col("x") * scale * v).alias(f"c{k}") for k, v in enumerate(y)]).orderBy("species").collect()  # a row per species
    names = [r["species"] for r in c_rows]
    c = np.array([[r[f"c{k}"] for r in c_rows] for k in range(len(y))])
    column = np.array([r["cx"] for r in c_rows])
    if weighted:
        c = c / np.sqrt(column / total)[None, :]
    return means, g, c, names, {"total": total, "column": column, "square": np.array([r["cxx"] for r in c_rows]), "n": n}


def _solve(g: np.ndarray, c: np.ndarray, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, singular values and species vectors."""
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    values, vectors = np.linalg.eigh(g / np.outer(d, d))
    keep = values > least * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    u, s, vt = np.linalg.svd(root.T @ (c / d[:, None]), full_matrices=False)
    good = s > 1e-12 * (s.max() if len(s) else 1)
    return (root @ u[:, good]) / d[:, None], s[good], vt[good].T


def _score(env: DataFrame, variables: Sequence[str], means: np.ndarray, coefficients: np.ndarray) -> Column:
    out = []
    for a in range(coefficients.shape[1]):
        score: Column = F.lit(0.0)
        for k, v in enumerate(variables):
            score = score + (F.col(v) - F.lit(float(means[k]))) * F.lit(float(coefficients[k, a]))
        out.append(score)
    return F.array(*out)


def cca(species: DataFrame, env: DataFrame, variables: Sequence[str], axes: int | None = None) -> Ordination:
    """Canonical correspondence analysis. ``species``: id, species, x; ``env``: id and the
    variables."""
    species, env = species.persist(), env.persist()  # read by each of the aggregates below
    check_inputs(species, env)
    means, g, c, names, sums = cross_products(species, env, variables)
    coef, s, v = _solve(g, c)
    t, column = sums["total"], sums["column"]
    inertia = float(species.join(site_info(species).select("id", F.col("weight").alias("rx")), "id").join(species_info(species).select("species", F.col("weight").alias("cx")), "species").agg(F.sum(F.col("x") * F.col("x") / (F.col("rx") * F.col("cx"))).alias("i")).first()["i"] - 1)
    centroids = v / np.sqrt(column / t)[:, None] * s[None, :]
    biplot = (g @ coef) / np.sqrt(np.diag(g))[:, None]
    out = Ordination("CCA", list(variables), names, means, s**2, coef, biplot, centroids, inertia)
    info = {r["species"]: (r["weight"], r["n2"]) for r in species_info(species).collect()}  # a row per species
    out.species_info = [(n, *info[n]) for n in names]
    lc = env.select("id", _score(env, variables, means, coef).alias("lc"))
    table = species.sparkSession.createDataFrame([(n, [float(x) for x in centroids[k]]) for k, n in enumerate(names)], "species string, u array<double>")
    k = len(s)
    cells = species.join(F.broadcast(table), "species")  # one row per species
    wa = cells.groupBy("id").agg(F.array(*[F.try_divide(F.sum(F.col("x") * F.col("u")[a]), F.sum("x") * F.lit(float(s[a] ** 2))) for a in range(k)]).alias("wa"))
    out.sites = site_info(species).join(lc, "id").join(wa, "id")
    off = cells.join(lc, "id").groupBy("species").agg(F.array(*[F.sqrt(F.sum(F.col("x") * F.pow(F.col("lc")[a] - F.col("u")[a], F.lit(2.0))) / F.sum("x")) for a in range(k)]).alias("t"))
    found = {r["species"]: r["t"] for r in off.collect()}  # a row per species
    out.tolerances = np.array([found[n] for n in names])
    species.unpersist(), env.unpersist()  # the tables of sites are made again from their sources
    return out.trimmed(axes) if axes else out


def rda(species: DataFrame, env: DataFrame, variables: Sequence[str], axes: int | None = None) -> Ordination:
    """Redundancy analysis: as cca, without weights, on centered abundances."""
    species, env = species.persist(), env.persist()  # read by each of the aggregates below
    check_inputs(species, env)
    means, g, c, names, sums = cross_products(species, env, variables, weighted=False)
    n = sums["n"]
    coef, s, v = _solve(g * n, c)
    eigen = s**2 / (n - 1)
    inertia = float((sums["square"] - sums["column"] ** 2 / n).sum() / (n - 1))
    centroids = v * np.sqrt(eigen / inertia)[None, :]
    sd = np.sqrt(np.diag(g * n))
    biplot = ((g * n) @ coef) / sd[:, None]
    out = Ordination("RDA", list(variables), names, means, eigen, coef, biplot, centroids, inertia)
    info = {r["species"]: (r["weight"], r["n2"]) for r in species_info(species).collect()}  # a row per species
    out.species_info = [(m, *info[m]) for m in names]
    lc = env.select("id", _score(env, variables, means, coef).alias("lc"))
    center = {m: float(x / n) for m, x in zip(names, sums["column"])}
    table = species.sparkSession.createDataFrame([(m, [float(x) for x in v[k]]) for k, m in enumerate(names)], "species string, v array<double>")
    shift = [sum(center[m] * v[k, a] for k, m in enumerate(names)) for a in range(len(s))]
    cells = species.join(F.broadcast(table), "species")  # one row per species
    wa = cells.groupBy("id").agg(F.array(*[(F.sum(F.col("x") * F.col("v")[a]) - F.lit(float(shift[a]))) / F.lit(float(s[a])) for a in range(len(s))]).alias("wa"))
    out.sites = site_info(species).join(lc, "id").join(wa, "id")
    spread = cells.join(lc, "id").join(species.sparkSession.createDataFrame([(m, [float(x) for x in centroids[k]]) for k, m in enumerate(names)], "species string, u array<double>"), "species")
    off = spread.groupBy("species").agg(F.array(*[F.sqrt(F.sum(F.col("x") * F.pow(F.col("lc")[a] - F.col("u")[a], F.lit(2.0))) / F.sum("x")) for a in range(len(s))]).alias("t"))
    found = {r["species"]: r["t"] for r in off.collect()}  # a row per species
    out.tolerances = np.array([found[m] for m in names])
    species.unpersist(), env.unpersist()
    return out.trimmed(axes) if axes else out


def bray_curtis(species: DataFrame) -> DataFrame:
    """a, b, distance of all pairs of sites that share a species or not: the pair table that
    distance-based analysis starts from (as wide as its result)."""
    sums = species.groupBy("id").agg(F.sum("x").alias("s"))
    left, right = species.select(F.col("id").alias("a"), "species", F.col("x").alias("xa")), species.select(F.col("id").alias("b"), "species", F.col("x").alias("xb"))
    shared = left.join(right, "species").where("a < b").groupBy("a", "b").agg(F.sum(F.least("xa", "xb")).alias("m"))
    pairs = sums.select(F.col("id").alias("a"), F.col("s").alias("sa")).join(sums.select(F.col("id").alias("b"), F.col("s").alias("sb")), F.col("a") < F.col("b"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", (F.lit(1.0) - F.lit(2.0) * F.coalesce("m", F.lit(0.0)) / (F.col("sa") + F.col("sb"))).alias("distance"))


#: Most sites of a distance-based analysis: its principal coordinates need all pairs.
DISTANCE_SITES = 4000


def dbrda(species: DataFrame, env: DataFrame, variables: Sequence[str], axes: int | None = None) -> Ordination:
    """Distance-based redundancy analysis on Bray-Curtis dissimilarities: principal
    coordinates (of positive eigenvalues) take the place of species."""
    species, env = species.persist(), env.persist()  # read by checks, ids and pairs
    check_inputs(species, env)
    ids = [r["id"] for r in species.select("id").distinct().orderBy("id").limit(DISTANCE_SITES + 1).collect()]
    if len(ids) > DISTANCE_SITES:
        raise ValueError(f"distance-based analysis takes at most {DISTANCE_SITES} sites")
    at = {i: k for k, i in enumerate(ids)}
    d = np.zeros((len(ids), len(ids)))
    for r in bray_curtis(species).toLocalIterator():
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["distance"]
    center = np.eye(len(ids)) - 1 / len(ids)
    values, vectors = np.linalg.eigh(-0.5 * center @ (d * d) @ center)
    keep = np.flatnonzero(values > 1e-9 * values.max())[::-1]
    rows = [(i, f"PCO{a + 1:04d}", float(vectors[at[i], k] * np.sqrt(values[k])) + 1e3) for i in ids for a, k in enumerate(keep)]
    # a constant keeps column sums positive; centering takes it out again
    points = species.sparkSession.createDataFrame(rows, "id long, species string, x double")
    out = rda(points, env, variables, axes)
    species.unpersist(), env.unpersist()
    out.prefix = "CAP"
    return out


#: Programs and metrics that a model can be built with; programs differ in name only.
METHODS = {("numpy", "CCA"): cca, ("numpy", "RDA"): rda, ("vegan", "CCA"): cca, ("vegan", "RDA"): rda, ("vegan", "DBRDA"): dbrda, ("sknnr", "CCA"): cca}


def fit(program: str, metric: str, species: DataFrame, env: DataFrame, variables: Sequence[str], axes: int | None = None, downweighting: bool = False) -> Ordination:
    """``downweighting`` is an option of the program vegan; others leave it out of account."""
    if (program, metric) not in METHODS:
        raise ValueError(f"no method for {program} and {metric}")
    own = downweighted(species) if downweighting and program == "vegan" else species
    return METHODS[program, metric](own, env, variables, axes)
