import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgrid.operators import ordination as o
from mossgrid.sources import model_file


def data(seed=1, n=18, p=9):
    rng = np.random.default_rng(seed)
    env = np.column_stack([rng.normal(size=n) * 100 + 7, rng.integers(0, 2, n), rng.normal(size=n)])
    x = rng.poisson(2 + 1.5 * (env[:, [1]] + rng.random((1, p))), size=(n, p)).astype(float)
    x[:, 0] += 1
    x[0] += 1
    return x, env


def tables(spark, x, env):
    wide = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *[f"s{k}" for k in range(x.shape[1])]])
    covariates = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(env)], ["id", *[f"v{k}" for k in range(env.shape[1])]])
    return o.species_long(wide, "id"), covariates


def direct_cca(x, env):
    p = x / x.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    res = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    y = np.sqrt(r)[:, None] * (env - (r[:, None] * env).sum(axis=0))
    fit = y @ np.linalg.lstsq(y, res, rcond=None)[0]
    u, s, vt = np.linalg.svd(fit, full_matrices=False)
    return s, u / np.sqrt(r)[:, None], vt.T / np.sqrt(c)[:, None] * s, (res**2).sum()


@pytest.mark.parametrize("collinear", [False, True])
def test_cca_against_direct(spark, collinear):
    x, env = data()
    if collinear:
        env = np.column_stack([env, env[:, 0] * 2 - env[:, 1]])
    species, covariates = tables(spark, x, env)
    m = o.cca(species, covariates, covariates.columns[1:])
    s, lc, u, inertia = direct_cca(x, env)
    assert m.rank == 3
    np.testing.assert_allclose(m.eigenvalues, s[:3] ** 2, rtol=1e-9)
    got = np.array([r["lc"] for r in m.sites.orderBy("id").collect()])
    np.testing.assert_allclose(np.abs(got), np.abs(lc[:, :3]), rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(np.abs(m.centroids), np.abs(u[:, :3]), rtol=1e-6, atol=1e-9)
    assert m.total_inertia == pytest.approx(inertia)
    assert m.eigenvalues.sum() <= inertia
    w = x.sum(axis=1) / x.sum()
    np.testing.assert_allclose((w[:, None] * got**2).sum(axis=0), 1, rtol=1e-9)
    wa = np.array([r["wa"] for r in m.sites.orderBy("id").collect()])
    want = (x @ u[:, :3]) / x.sum(axis=1)[:, None] / s[:3] ** 2
    np.testing.assert_allclose(np.abs(wa), np.abs(want), rtol=1e-6, atol=1e-9)
    tol = np.sqrt((x[:, :, None] * (got[:, None, :] - m.centroids[None]) ** 2).sum(axis=0) / x.sum(axis=0)[:, None])
    np.testing.assert_allclose(m.tolerances, tol, rtol=1e-6)


def test_rda_against_direct(spark):
    x, env = data(3)
    species, covariates = tables(spark, x, env)
    m = o.rda(species, covariates, covariates.columns[1:])
    xc, yc = x - x.mean(axis=0), env - env.mean(axis=0)
    u, s, _ = np.linalg.svd(yc @ np.linalg.lstsq(yc, xc, rcond=None)[0], full_matrices=False)
    np.testing.assert_allclose(m.eigenvalues, s[:3] ** 2 / (len(x) - 1), rtol=1e-8)
    assert m.total_inertia == pytest.approx((xc**2).sum() / (len(x) - 1))
    got = np.array([r["lc"] for r in m.sites.orderBy("id").collect()])
    np.testing.assert_allclose(np.abs(got), np.abs(u[:, :3]), rtol=1e-6, atol=1e-9)


def test_residuals_and_info(spark):
    x, env = data(5, 6, 4)
    species, _ = tables(spark, x, env)
    p = x / x.sum()
    want = (p - np.outer(p.sum(1), p.sum(0))) / np.sqrt(np.outer(p.sum(1), p.sum(0)))
    got = {(r["id"], r["species"]): r["residual"] for r in o.chi_square_residuals(species).collect()}
    assert len(got) == x.size
    for i in range(6):
        for k in range(4):
            assert got[i, f"s{k}"] == pytest.approx(want[i, k])
    n2 = {r["species"]: r["n2"] for r in o.species_info(species).collect()}
    assert n2["s0"] == pytest.approx(1 / ((x[:, 0] / x[:, 0].sum()) ** 2).sum())


def test_dbrda_runs_and_bounds(spark):
    x, env = data(7, 12, 6)
    species, covariates = tables(spark, x, env)
    m = o.dbrda(species, covariates, covariates.columns[1:])
    assert 0 < m.eigenvalues.sum() <= m.total_inertia
    assert m.prefix == "CAP"


def test_bad_inputs(spark):
    x, env = data()
    species, covariates = tables(spark, x, env)
    with pytest.raises(ValueError):
        o.cca(species, covariates.where("id > 0"), ["v0"])
    with pytest.raises(ValueError):
        o.fit("numpy", "NMDS", species, covariates, ["v0"])
    wide = spark.createDataFrame([(1, 0.5)], "id long, a double")
    assert o.species_long(wide, "id", "SQRT").first()["x"] == pytest.approx(0.5**0.5)
    with pytest.raises(Exception, match="logarithm"):
        o.species_long(spark.createDataFrame([(1, 0.0)], "id long, a double"), "id", "LOG").collect()


def test_model_file_round_trip(spark, tmp_path):
    x, env = data()
    species, covariates = tables(spark, x, env)
    m = o.cca(species, covariates, covariates.columns[1:])
    path = f"file://{tmp_path}/model.txt"
    model_file.write(m, spark, path)
    back = model_file.read(spark, path)
    assert back.variables == m.variables and back.species == m.species and back.prefix == "CCA"
    np.testing.assert_allclose(back.eigenvalues, m.eigenvalues, atol=1e-8)
    np.testing.assert_allclose(back.coefficients, m.coefficients, atol=1e-10)
    a, b = (t.sites.orderBy("id").select("id", F.col("lc")[0].alias("a"), "n2").toPandas() for t in (m, back))
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), atol=1e-5)
    assert m.trimmed(2).rank == 2


def test_downweighting(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(1, 9, (30, 6)).astype(float) * (rng.random((30, 6)) < np.array([1, 0.9, 0.5, 0.1, 0.07, 0.03]))
    x[0] = 1
    df = spark.createDataFrame([(i, f"s{j}", float(x[i, j])) for i in range(30) for j in range(6) if x[i, j]], "id long, species string, x double")
    often = x.sum(axis=0) ** 2 / (x**2).sum(axis=0)
    for fraction in (5.0, 0.2, 2.0):
        least = often.max() / max(fraction, 1 / fraction)
        want = x * np.where(often < least, often / least, 1)
        got = {(r["id"], r["species"]): r["x"] for r in o.downweighted(df, fraction).collect()}
        assert len(got) == np.count_nonzero(x) and all(v == pytest.approx(want[i, int(s[1])]) for (i, s), v in got.items())
    assert o.downweighted(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        o.downweighted(df, 0)


def test_downweighting_reaches_the_model(spark):
    rng = np.random.default_rng(7)
    rows = [(i, f"s{j}", float(rng.integers(1, 9))) for i in range(20) for j in range(6) if j < 4 or i % 7 == j]
    df = spark.createDataFrame(rows, "id long, species string, x double")
    env = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(20)], "id long, v0 double, v1 double")
    plain, less, other = (o.fit(p, "CCA", df, env, ["v0", "v1"], downweighting=w).eigenvalues for p, w in (("vegan", False), ("vegan", True), ("numpy", True)))
    assert np.allclose(plain, other) and not np.allclose(plain, less)
    assert np.allclose(less, o.cca(o.downweighted(df), env, ["v0", "v1"]).eigenvalues)


@pytest.mark.parametrize("name", ["cca_cross_products", "dbrda_eigenvalues"])
def test_sites_are_made_once(spark, monkeypatch, name):
    """The joins behind species and sites run once for all aggregates."""
    from mossgrid.plans import queries

    made, read = queries.site_species, spark.sparkContext.accumulator(0)

    def counted(spark, d):
        own = made(spark, d)

        def passed(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return own.mapInArrow(passed, own.schema)

    monkeypatch.setattr(queries, "site_species", counted)
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.count() and 0 < read.value <= made(spark, "/root/testdata/sf0.001").count()
