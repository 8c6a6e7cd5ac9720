import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from mossgrid.operators import impute
from mossgrid.plans import commands, diagnostics, queries
from mossgrid.sources import attributes, small_files, tables
from mossgrid.streaming.scoring import impute_stream

DIR = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[str]:
    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    plain = lambda v: None if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else round(float(v), 5)
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    if name not in ("nn_index_outlier", "hex_mean_std"):
        assert len(want)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def model(spark):
    rng = np.random.default_rng(0)
    n = 60
    env = pd.DataFrame({"FCID": range(1, n + 1), "v0": rng.normal(size=n), "v1": rng.normal(size=n)})
    sp = pd.DataFrame(rng.poisson(np.exp(env[["v0"]].to_numpy() * 0.4 + 1), (n, 5)) + 1.0, columns=list("abcde"))
    sp.insert(0, "FCID", env["FCID"])
    p = small_files.from_dict({"ordination": {"variables": ["v0", {"name": "v1", "years": [2001]}]}, "model_year": 2001, "imputation": {"k": 3, "axes": 2, "max_neighbors": 12}, "accuracy": {"diagnostics": ["local_accuracy", "error_matrix_accuracy", "species_accuracy", "riemann_accuracy", "regional_accuracy", "unknown"], "bins": 4, "hex_levels": [{"column": "h", "min_plots": 2}], "k_values": [1, 3]}, "outliers": {"diagnostics": ["nn_index_outlier", "variable_deviation_outlier"], "index_threshold": 2.0, "deviations": [["a", 3.0]]}})
    s, e = spark.createDataFrame(sp), spark.createDataFrame(env)
    return p, s, e, commands.build_model(p, s, e)


def test_commands_end_to_end(spark):
    p, s, e, m = model(spark)
    env = e.withColumn("id", F.col("FCID"))
    attrs = s.withColumnRenamed("FCID", "id").withColumn("code", (F.col("id") % 3).cast("int"))
    cross = attrs.select("id", F.floor(F.col("id") / 3).alias("loc_id"))
    hexes = attrs.select("id", (F.col("id") % 5).alias("h"))
    v = commands.cross_validate(p, m, env, attrs, cross, ["a", "b"], ["code"], ["c"], {"hex": hexes}, None)
    assert v["dependent"].where("a is null").count() == 0
    own = v["zonal"].where("neighbor = 1 and id = neighbor_id").count()
    assert own == 60
    assert {"local_accuracy", "error_matrix_accuracy", "species_accuracy", "riemann_accuracy"} == set(v["diagnostics"])
    for group in v["diagnostics"].values():
        for df in group.values():
            assert df.count() > 0
    found = commands.find_outliers(p, v)
    assert found["variable_deviation_outlier"]["variable_deviation_outlier"].columns
    t = commands.new_targets(p, m, env, spark.createDataFrame([(5,), (6,)], "id long"), attrs, ["a"])
    assert sorted(r["id"] for r in t["predicted"].collect()) == [5, 6]
    stack = e.select((F.col("FCID") % 4).cast("int").alias("row"), F.col("FCID").cast("int").alias("col"), "v0", "v1")
    wall = commands.impute(p, m, stack)
    assert wall.select("row", "col").distinct().count() == 60
    raster = commands.build_attribute_raster(wall.where("rank <= 3"), attrs, "a", stack.select("row", "col", F.lit(True).alias("forest")), 3, 10.0)
    assert raster.where("value < 0").count() == 0


def test_other_diagnostics(spark):
    rng = np.random.default_rng(3)
    make = lambda seed: spark.createDataFrame([(i, float(rng.random() * 90), float(rng.random()), float(rng.random() * 100)) for i in range(1, 41)], "id long, QMD_DOM double, BAH_PROP double, CANCOV double")
    o, p = make(1), make(2)
    near = spark.createDataFrame([(i, q, 1, (i * q) % 40 + 1, 0.5) for i in range(1, 41) for q in range(1, 10)], "id long, pixel_number int, rank int, neighbor_id long, distance double")
    area = o.withColumn("HECTARES", F.lit(2.0)).unionByName(spark.createDataFrame([(-10001, None, None, None, 50.0), (-10002, None, None, None, 7.0)], "id long, QMD_DOM double, BAH_PROP double, CANCOV double, HECTARES double"))
    raster = p.select(F.lit("CANCOV").alias("variable"), F.col("CANCOV").alias("value"), F.lit(0.09).alias("area"))
    c = diagnostics.Context({"observed": o, "independent": p, "dependent": p, "neighbors": near, "area": area, "raster": raster, "validation": o, "validation_neighbors": near}, ["CANCOV"], bins=5)
    out = diagnostics.run(["vegclass_accuracy", "regional_accuracy", "validation_accuracy"], c, diagnostics.ACCURACY)
    assert set(out) == {"vegclass_accuracy", "regional_accuracy", "validation_accuracy"}
    names = [r["bin_name"] for r in out["regional_accuracy"]["regional_accuracy"].where("bin <= 0").orderBy("bin").collect()]
    assert names == ["Nonforest", "Unsampled"]
    found = diagnostics.run(["vegclass_outlier", "vegclass_variety", "nn_index_outlier"], c, diagnostics.OUTLIERS)
    assert found["vegclass_outlier"]["vegclass_outlier"].where("prediction_type = 'DEPENDENT'").count() > 0
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "OBSERVED int, PREDICTED int")
    assert diagnostics.classification_accuracy(pairs)["kappa"].count() == 1


def test_sources(spark, tmp_path):
    text = "A 2 3 30.0\n0 1 0\n1 2 1\n\nB 1 1 10\n3\n"
    prints = small_files.parse_footprints(text)
    assert set(prints) == {"A", "B"} and prints["A"].index == (1, 1)
    with pytest.raises(ValueError):
        small_files.parse_footprints("A 2 2 1\n0 2\n")
    (tmp_path / "c.xml").write_text("<classifier><classification><value>1</value><name>One</name><fuzzy_classifications><fuzzy_value>1</fuzzy_value><fuzzy_value>2</fuzzy_value></fuzzy_classifications></classification></classifier>")
    assert small_files.read_classifier(str(tmp_path / "c.xml"))[1].fuzzy == (1, 2)
    assert small_files.default_classifier([3, 3, 1])[3].fuzzy == (3,)
    (tmp_path / "p.xml").write_text("<parameters><model_directory>/m</model_directory><model_year>2000</model_year><plot_id_field>FCID</plot_id_field><k>2</k><ordination_variable><variable_name>x</variable_name></ordination_variable></parameters>")
    p = small_files.read_parameters(str(tmp_path / "p.xml"))
    assert p.imputation.k == 2 and p.ordination.names() == ["x"]
    with pytest.raises(NotImplementedError):
        small_files.read_parameters("a.ini")
    with pytest.raises(ValueError):
        small_files.from_dict({"nonsense": 1})
    with pytest.raises(ValueError):
        small_files.from_dict({"plot_id": "ID"})
    df = spark.createDataFrame([(1, None, True, " a "), (2, float("nan"), None, "b")], "id long, x double, f boolean, s string")
    tables.write_csv(df, f"file://{tmp_path}/out", 2, ["id"])
    back = tables.read_table(spark, f"file://{tmp_path}/out", "id long, x string, f int, s string").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, "0.00", 1, "a"), (2, "0.00", 0, "b")]
    assert tables.ids(spark.createDataFrame([(-10001,), (4,)], "id long"), "id").count() == 1
    table = spark.createDataFrame([("A", 100.0, 7)], "ATTR string, SCALAR double, K int")
    assert tables.scalar_of(table, "A") == (100.0, 7) and tables.scalar_of(table, "B") == (1.0, 1)


def test_attributes(spark, tmp_path):
    fields = [attributes.AttributeField("FCID", "ID"), attributes.AttributeField("BA", "CONTINUOUS", project=True, accuracy=True), attributes.AttributeField("CL", "CATEGORICAL", project=True, accuracy=True), attributes.AttributeField("SP", "CONTINUOUS", species=True, project=True, accuracy=True), attributes.AttributeField("NOTE", "CHARACTER")]
    (tmp_path / "a.csv").write_text("NOTE,FCID,SP,CL,BA\nx,1,0,2,3.5\n")
    df = attributes.read_csv(spark, f"file://{tmp_path}/a.csv", fields, "FCID")
    assert df.first()["BA"] == 3.5 and dict(df.dtypes)["CL"] == "int"
    assert attributes.project(df, fields, "FCID", accuracy=True).columns == ["SP", "CL", "BA"]
    assert attributes.project(df, fields, "FCID", with_id=True, kinds=["CONTINUOUS"], species=False).columns == ["FCID", "BA"]
    assert [f.name for f in attributes.species(fields)] == ["SP"]
    with pytest.raises(ValueError, match="OTHER"):
        attributes.check(["FCID", "OTHER", "HECTARES"], fields)
    with pytest.raises(ValueError):
        attributes.read_csv(spark, f"file://{tmp_path}/a.csv", fields, "PLTID")
    (tmp_path / "m.xml").write_text("<attributes><attribute><field_name>BA</field_name><field_type>CONTINUOUS</field_type><species_attr>0</species_attr><project_attr>1</project_attr><accuracy_attr>1</accuracy_attr></attribute></attributes>")
    assert attributes.read_xml(str(tmp_path / "m.xml"))[0].in_area


def test_streaming(spark, tmp_path):
    ref = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, scores array<double>")
    attrs = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, a double")
    targets = spark.createDataFrame([(100 + i, 1, [i + 0.1, 0.0]) for i in range(8)], "id long, pixel_number int, scores array<double>")
    targets.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(targets.schema).parquet(f"file://{tmp_path}/in")
    out = []
    q = impute_stream(stream, ref, attrs, ["a"], 1, lambda df, n: out.extend(df.collect()), f"file://{tmp_path}/state")
    q.awaitTermination(120)
    assert sorted((r["id"], r["a"]) for r in out) == [(100 + i, float(i)) for i in range(8)]


def test_seven_weights():
    assert len(impute.SEVEN_WEIGHTS) == 7
