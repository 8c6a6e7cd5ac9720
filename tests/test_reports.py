import csv
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgrid.operators import classify
from mossgrid.plans import diagnostics, reports


def read(folder):
    (path,) = glob.glob(f"{folder}/part*")
    return list(csv.reader(open(path)))


def table(spark, seed, n=40):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.random() * 90), float(rng.random()), float(rng.random() * 100), float(rng.integers(0, 3))) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "id long, QMD_DOM double, BAH_PROP double, CANCOV double, ABAM double")


@pytest.fixture(scope="module")
def results(spark):
    o, p = table(spark, 1), table(spark, 2)
    near = spark.createDataFrame([(i, q, r, (i * q * r) % 40 + 1, 0.5 * r) for i in range(1, 41) for q in (1, 2) for r in (1, 2, 3)], "id long, pixel_number int, rank int, neighbor_id long, distance double")
    area = o.withColumn("HECTARES", F.lit(2.0))
    raster = p.select(F.lit("CANCOV").alias("variable"), F.col("CANCOV").alias("value"), F.lit(0.09).alias("area"))
    hexes = o.select("id", (F.col("id") % 4).alias("HEX_10"))
    c = diagnostics.Context({"observed": o, "independent": p, "dependent": p, "neighbors": near, "area": area, "raster": raster, "hex": hexes}, ["CANCOV", "QMD_DOM", "BAH_PROP"], species=["ABAM"], bins=4, k=2, k_values=[1, 2], k_weights={2: [3.0, 1.0]}, hex_levels={"HEX_10": 3}, index_threshold=1.0, deviations={"CANCOV": 30.0})
    c2 = diagnostics.Context(c.tables, ["CANCOV"], bins=4)
    out = diagnostics.run(["local_accuracy", "species_accuracy", "error_matrix_accuracy", "vegclass_accuracy", "riemann_accuracy"], c, diagnostics.ACCURACY)
    return out | diagnostics.run(["regional_accuracy"], c2, diagnostics.ACCURACY) | diagnostics.run(["nn_index_outlier", "vegclass_outlier", "variable_deviation_outlier"], c, diagnostics.OUTLIERS)


HEADS = {
    "local_accuracy": "VARIABLE,PEARSON_R,SPEARMAN_R,RMSE,NORMALIZED_RMSE,BIAS_PERCENTAGE,R_SQUARE",
    "species_accuracy": "SPECIES,OP_PP,OP_PA,OA_PP,OA_PA,PREVALENCE,SENSITIVITY,FALSE_NEGATIVE_RATE,SPECIFICITY,FALSE_POSITIVE_RATE,PERCENT_CORRECT,ODDS_RATIO,KAPPA",
    "error_matrix": "VARIABLE,OBSERVED_CLASS,PREDICTED_CLASS,COUNT",
    "bins": "VARIABLE,CLASS,LOW,HIGH",
    "regional_accuracy": "VARIABLE,DATASET,BIN_NAME,AREA",
    "adjusted_area": "VARIABLE,CLASS,MAPPED,ADJUSTED,CI_ADJUSTED",
    "multiscale_accuracy": "LEVEL,K,VARIABLE,STATISTIC,VALUE",
    "nn_index_outlier": "FCID,AVERAGE_POSITION",
    "class_pairs": "FCID,OBSERVED,PREDICTED",
    "vegclass_outlier": "FCID,PREDICTION_TYPE,OBSERVED_VEGCLASS,PREDICTED_VEGCLASS,OUTLIER_TYPE",
    "variable_deviation_outlier": "FCID,PREDICTION_TYPE,VARIABLE,OBSERVED_VALUE,PREDICTED_VALUE,DEVIATION",
    "kappas": "CLASS,KAPPA,FUZZY_KAPPA",
}
DECIMALS = {"local_accuracy": 6, "regional_accuracy": 3}


def test_all_files(spark, results, tmp_path):
    fuzzy = classify.fuzzy_table(spark)
    classes = sorted(r["class"] for r in fuzzy.select("class").distinct().collect())
    done = reports.write(results, str(tmp_path), places={"bins": str(tmp_path / "else" / "own_bins")}, classes=classes, fuzzy=fuzzy)
    assert set(HEADS) | {"class_matrix", "regional_bins", "regional_error_matrix"} == set(done)
    for name, head in HEADS.items():
        rows = read(tmp_path / "else" / "own_bins" if name == "bins" else tmp_path / f"{name}.csv")
        assert rows[0] == head.split(",") and len(rows) > 1, name
        with_decimals = [x.split(".")[1] for r in rows[1:] for x in r if x.lstrip("-").replace(".", "", 1).isdigit() and "." in x]
        assert all(len(x) == DECIMALS.get(name, 4) for x in with_decimals), name
    areas = read(tmp_path / "regional_accuracy.csv")
    assert [r[2] for r in areas[1:] if r[1] == "OBSERVED"][:2] == ["Nonforest", "Unsampled"]
    kappas = read(tmp_path / "kappas.csv")
    assert [r[0] for r in kappas[1:]] == [*map(str, classes), "ALL"]
    matrix = read(tmp_path / "error_matrix.csv")
    assert [(r[2], r[1]) for r in matrix[1:] if r[0] == "CANCOV"] == [(str(j), str(i)) for j in range(1, 5) for i in range(1, 5)]
    dev = read(tmp_path / "variable_deviation_outlier.csv")
    assert all(abs(float(r[3]) - float(r[4]) - float(r[5])) < 2e-4 and abs(float(r[5])) >= 30 for r in dev[1:]) and any(float(r[5]) < 0 for r in dev[1:])


def test_pivoted_matrix(spark):
    pairs = spark.createDataFrame([(1, 1)] * 3 + [(1, 2)] * 2 + [(2, 3)] + [(3, 3)] * 4, "observed int, predicted int")
    fuzzy = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3)], "class int, fuzzy int")
    classes = spark.createDataFrame([(1,), (2,), (3,), (10,)], "class int")
    got = reports.pivoted(classify.error_matrix(pairs, classes), [1, 2, 3, 10], fuzzy).orderBy("place").drop("place")
    assert got.columns == ["label", "1", "2", "3", "10", "Total", "% Correct", "% FCorrect"]
    assert [",".join(r) for r in got.collect()] == [
        "1,3,2,0,0,5,60.000,100.000", "2,0,0,1,0,1,0.000,0.000", "3,0,0,4,0,4,100.000,100.000", "10,0,0,0,0,0,0.000,0.000",
        "Total,3,2,5,0,10,,", "% Correct,100.000,0.000,80.000,0.000,,70.000,", "% FCorrect,100.000,100.000,80.000,0.000,,,90.000",
    ]


def test_weights_of_each_k(spark, results):
    """The k with weights of its own uses them."""
    o = table(spark, 1)
    near = spark.createDataFrame([(i, 1, r, (i * r) % 40 + 1, 0.5 * r) for i in range(1, 41) for r in (1, 2)], "id long, pixel_number int, rank int, neighbor_id long, distance double")
    base = {"observed": o, "neighbors": near, "hex": o.select("id", F.lit(1).alias("h"))}
    run = lambda w: {(r["k"], r["statistic"]): r["value"] for r in diagnostics.multiscale(diagnostics.Context(base, ["CANCOV"], k_values=[1, 2], k_weights=w))["multiscale_accuracy"].collect()}
    a, b = run({}), run({2: [1.0, 3.0]})
    assert a[1, "AC"] == pytest.approx(b[1, "AC"]) and abs(a[2, "AC"] - b[2, "AC"]) > 1e-6
