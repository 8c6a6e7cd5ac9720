"""Queries of sources, sinks and smaller operators over the driver's tables, with their SQL.

What goes through files is written below the session's shared folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.functions import labels, stats
from mossgrid.operators import binning, neighbors, ordination, rasters, tiles
from mossgrid.plans import commands
from mossgrid.sources import attributes, model_file, raster_files, small_files, tables
from mossgrid.sources.shared import shared_folder


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


# --- scans and files ------------------------------------------------------------------------


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The file convention: nulls are 0, flags numbers, text trimmed, decimals fixed."""
    own = _read(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("name"), (F.col("c_nationkey") > 12).alias("far"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 3).alias("share"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("nation"),
    )
    path = shared_folder(spark, "csv")
    tables.write_csv(own, path, {"share": 3}, ["c_custkey"])
    return tables.read_table(spark, path, "c_custkey long, name string, far int, share double, nation long", ["c_custkey", "name", "far", "share", "nation"])


_CSV = "SELECT c_custkey, trim(c_name) AS name, (c_nationkey > 12)::INT AS far, CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal / 3, 3) ELSE 0 END AS share, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey ELSE 0 END::BIGINT AS nation FROM customer"


def attribute_scan(spark: SparkSession, d: str) -> DataFrame:
    """A CSV table typed by its metadata, columns that accuracy takes, by kind."""
    fields = [attributes.AttributeField("c_custkey", "ID"), attributes.AttributeField("c_acctbal", "CONTINUOUS", accuracy=True), attributes.AttributeField("c_nationkey", "CATEGORICAL", accuracy=True), attributes.AttributeField("c_mktsegment", "CHARACTER")]
    path = shared_folder(spark, "attributes")
    _read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment").write.option("header", True).csv(path)
    own = attributes.read_csv(spark, path, fields, "c_custkey")
    kept = attributes.project(own, fields, "c_custkey", accuracy=True, with_id=True)
    return kept.groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"), _r(F.sum("c_acctbal"), 2).alias("balance"))


def id_list(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are not reserved, one in eleven being so here."""
    own = _read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("id"))
    return tables.ids(own, "id")


def paired_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two tables reduced to the ids that both have."""
    o = _read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), "o_totalprice")
    p = _read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_acctbal")
    a, b = tables.common_ids(o, p, "id")
    each = a.select("id", F.lit("o").alias("side"), F.col("o_totalprice").alias("v")).unionByName(b.select("id", F.lit("p").alias("side"), F.col("c_acctbal").alias("v")))
    return each.groupBy("side").agg(F.count("id").alias("n"), F.count_distinct("id").alias("ids"), _r(F.sum("v"), 2).alias("total"))


def forest_majority(spark: SparkSession, d: str) -> DataFrame:
    """Orders of four items or more of the customers that are wanted."""
    plots = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("PNT_COUNT")).join(_read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id")), "l_orderkey")
    wanted = _read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return tables.forest_majority(plots, "id", least=4.0, wanted=wanted).select("id", "l_orderkey", "PNT_COUNT")


def zonal_sink(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pixel_number"), (F.col("l_linenumber") % 3 + 1).alias("neighbor"), F.col("l_partkey").alias("neighbor_id"), (F.col("l_extendedprice") / 7).alias("distance"))
    path = shared_folder(spark, "zonal")
    tables.write_zonal(own, path)
    return tables.read_table(spark, path, "FCID long, PIXEL_NUMBER long, NEIGHBOR long, NEIGHBOR_ID long, DISTANCE double").withColumn("DISTANCE", _r("DISTANCE", 4))


def bins_from_file(spark: SparkSession, d: str) -> DataFrame:
    """Edges by variable written and read, then used: classes of line items by two variables."""
    edges = {"l_quantity": [1.0, 10.0, 30.0, 50.0], "l_discount": [0.0, 0.02, 0.05, 0.1]}
    rows = [(v, k, a, b) for v, e in edges.items() for k, (a, b) in enumerate(zip(e, e[1:]), 1)]
    path = shared_folder(spark, "bins")
    tables.write_bins(spark.createDataFrame(rows, "variable string, class int, low double, high double"), path)
    found = tables.read_bins(spark, path)
    own = _read(spark, d, "lineitem")
    each = F.array(*[F.struct(F.lit(v).alias("variable"), binning.digitize(F.col(v), e).alias("class")) for v, e in found.items()])
    return own.select(F.inline(each)).groupBy("variable", "class").agg(F.count(F.lit(1)).alias("n"))


def raster_window(spark: SparkSession, d: str) -> DataFrame:
    """Two bands written as raster files, a window of rows and one band read back."""
    own = _read(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col"), F.inline(F.array(F.struct(F.lit(1).alias("band"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit(2).alias("band"), F.col("p_retailprice").cast("double").alias("value")))))
    last = own.agg(F.max("row").alias("r")).first()["r"]
    path = shared_folder(spark, "raster")
    raster_files.write_raster(own, path, raster_files.Raster(last + 1, 40, 2, 0.0, 0.0, 30.0, block_rows=8))
    return raster_files.read_raster(spark, path).where((F.col("row") >= 3) & (F.col("row") < 19) & (F.col("band") == 2)).select("row", "col", _r("value", 2).alias("value"))


def predicted_raster(spark: SparkSession, d: str) -> DataFrame:
    """Area of what is not forest, and values by the scale factor that the files hold."""
    own = _read(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col"), F.when(F.col("p_size") % 9 == 0, -1.0).otherwise(F.col("p_size") * 10.0).alias("value"))
    last = own.agg(F.max("row").alias("r")).first()["r"]
    path = shared_folder(spark, "predicted")
    raster_files.write_raster(own, path, raster_files.Raster(last + 1, 40, 1, 0.0, 0.0, 30.0, dtype="int32", block_rows=16, scalar=10.0))
    about = raster_files.describe(path)
    area, values = rasters.nonforest_and_values(raster_files.read_raster(spark, path, bands=[1]), about.scalar, rasters.Geometry(about.x_min, about.y_max, about.cell_size))
    sums = values.groupBy("value").agg(_r(F.sum("area"), 4).alias("area"))
    return sums.unionByName(area.select(F.lit(None).cast("double").alias("value"), _r("nonforest", 4).alias("area")))


# --- model files and imputation everywhere ---------------------------------------------------


def _model(spark: SparkSession, d: str) -> ordination.Ordination:
    """A model of two axes with given coefficients; its sites are the suppliers."""
    means, coef = np.array([4000.0, 12.0]), np.array([[0.001, 0.0005], [0.05, -0.1]])
    env = _read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    lc = neighbors.project(F.array("balance", "nation"), means, coef, None, 2)
    sites = env.select("id", F.lit(1.0).alias("weight"), F.lit(2.0).alias("n2"), lc.alias("lc"), F.transform(lc, lambda x: x * 2).alias("wa"))
    two = np.array([[1.0, 2.0], [3.0, 4.0]])
    return ordination.Ordination("CCA", ["balance", "nation"], ["sp1", "sp2"], means, np.array([0.64, 0.25]), coef, two, two, 1.0, two, [("sp1", 1.0, 2.0), ("sp2", 3.0, 4.0)], sites)


_SITES = "si AS (SELECT s_suppkey::BIGINT AS id, (s_acctbal - 4000) * 0.001e0 + (s_nationkey - 12) * 0.05e0 AS a, (s_acctbal - 4000) * 0.0005e0 + (s_nationkey - 12) * -0.1e0 AS b FROM supplier)"


def model_file_sites(spark: SparkSession, d: str) -> DataFrame:
    """A model written to its file and read back: scores of its sites."""
    path = shared_folder(spark, "model")
    model_file.write(_model(spark, d), spark, path)
    sites = model_file.read(spark, path).sites
    return sites.select("id", _r("weight").alias("weight"), _r(F.col("lc")[0]).alias("lc1"), _r(F.col("lc")[1]).alias("lc2"), _r(F.col("wa")[0]).alias("wa1"), _r(F.col("wa")[1]).alias("wa2"))


def axis_projection(spark: SparkSession, d: str) -> DataFrame:
    """Scores of customers, axes weighted by eigenvalues; pixels with a missing covariate go."""
    env = _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("pixel_number"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    p = small_files.from_dict({"ordination": {"variables": ["balance", "nation"]}, "imputation": {"axes": 2, "axis_weighting": True}})
    return commands.scores(p, _model(spark, d), env).select("id", "pixel_number", _r(F.col("scores")[0], 7).alias("axis1"), _r(F.col("scores")[1], 7).alias("axis2"))


def wall_to_wall(spark: SparkSession, d: str) -> DataFrame:
    """Neighbors of every pixel of a stack of covariates."""
    p = small_files.from_dict({"ordination": {"variables": ["balance", "nation"]}, "imputation": {"axes": 2, "axis_weighting": True, "max_neighbors": 3}})
    stack = _read(spark, d, "customer").select(F.floor(F.col("c_custkey") / 50).cast("int").alias("row"), (F.col("c_custkey") % 50).cast("int").alias("col"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return commands.impute(p, _model(spark, d), stack).select("row", "col", "rank", "neighbor_id", _r("distance").alias("distance"))


_WALL = f"WITH {_SITES}, t AS (SELECT c_custkey AS id, ((c_acctbal - 4000) * 0.001e0 + (c_nationkey - 12) * 0.05e0) * 0.8e0 AS a, ((c_acctbal - 4000) * 0.0005e0 + (c_nationkey - 12) * -0.1e0) * 0.5e0 AS b FROM customer), n AS (SELECT t.id, si.id AS neighbor_id, sqrt((t.a - si.a * 0.8e0) * (t.a - si.a * 0.8e0) + (t.b - si.b * 0.5e0) * (t.b - si.b * 0.5e0)) AS distance FROM t JOIN si ON true), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor_id) AS rank FROM n) SELECT (id // 50)::INT AS row, (id % 50)::INT AS col, rank::INT AS rank, neighbor_id, round(distance, 6) + 0 AS distance FROM r WHERE rank <= 3"


def species_transform(spark: SparkSession, d: str) -> DataFrame:
    """Abundances of a wide table in long form, under a root and under logarithms."""
    wide = _read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("all"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("returned"), F.sum(F.when(F.col("l_linenumber") == 7, F.col("l_quantity")).otherwise(0)).alias("seventh"))
    root = ordination.species_long(wide, "l_suppkey", "SQRT").withColumn("transform", F.lit("SQRT"))
    log = ordination.species_long(wide.select("l_suppkey", "all"), "l_suppkey", "LOG").withColumn("transform", F.lit("LOG"))
    return root.unionByName(log).select("transform", F.col("id").cast("long").alias("id"), "species", _r("x").alias("x"))


_LONG = "WITH w AS (SELECT l_suppkey::BIGINT AS id, sum(l_quantity) AS all_, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned, sum(CASE WHEN l_linenumber = 7 THEN l_quantity ELSE 0 END) AS seventh FROM lineitem GROUP BY 1), x AS (SELECT 'SQRT' AS transform, id, unnest(['all', 'returned', 'seventh']) AS species, unnest([sqrt(all_), sqrt(returned), sqrt(seventh)]) AS x FROM w UNION ALL SELECT 'LOG', id, 'all', ln(all_) FROM w) SELECT transform, id, species, round(x, 6) + 0 AS x FROM x WHERE x <> 0"


def aligned_stack(spark: SparkSession, d: str) -> DataFrame:
    """Three rasters on one grid, pixels that all have."""
    own = _read(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col"), "p_size", "p_retailprice")
    one = {"first": own.where("p_size > 5").select("row", "col", F.col("p_size").alias("value")), "second": own.where("col % 4 <> 1").select("row", "col", _r("p_retailprice", 2).alias("value")), "third": own.select("row", "col", (F.col("p_size") % 5).alias("value"))}
    return rasters.aligned(one)


def footprint_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Pixels around suppliers, from the stack of each one's year and a static one."""
    own = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 30 + 2.5).alias("x"), (-(F.col("s_nationkey") % 10) - 2.5).alias("y"), F.lit("f").alias("key"), (F.col("s_suppkey") % 3 + 2000).cast("int").alias("year"))
    pixel = _read(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col"), F.col("p_size").cast("double").alias("size"))
    stack = pixel.select("row", "col", F.explode(F.array(F.lit(2000), F.lit(2002), F.lit(None))).alias("year"), "size").withColumn("size", F.col("size") + F.coalesce(F.col("year"), F.lit(0)))
    prints = [rasters.Footprint("f", ((1, 1, 1, 1, 1), (1, 1, 2, 1, 1), (0, 0, 1, 0, 0)), 1.0)]
    return tiles.extract_by_year(own, tiles.to_tiles(stack, ["size"], 8, "year"), ["size"], prints, rasters.Geometry(0.0, 0.0, 1.0), tile=8)


_BY_YEAR = "WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 30 + 2)::INT AS c, (s_nationkey % 10 + 2)::INT AS r, s_suppkey % 3 + 2000 AS year FROM supplier), o AS (SELECT unnest(range(0, 15)) AS k), y AS (SELECT unnest([2000, 2002, NULL]) AS py) SELECT id, (k + 1)::INT AS pixel_number, (r + k // 5 - 1)::INT AS row, (c + k % 5 - 2)::INT AS col, p_size::DOUBLE + coalesce(py, 0) AS size FROM s JOIN o ON true JOIN part ON p_partkey // 40 = r + k // 5 - 1 AND p_partkey % 40 = c + k % 5 - 2 JOIN y ON py IS NULL OR py = year"


# --- values, bins and labels -----------------------------------------------------------------


def unique_values(spark: SparkSession, d: str) -> DataFrame:
    return binning.unique_values(_read(spark, d, "lineitem").withColumn("v", F.when(F.col("l_quantity") > 3, F.col("l_quantity") * F.col("l_discount"))).withColumn("v", _r("v", 4)), "v")


def weighted_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of discounts, each counted as often as its quantity says."""
    counts = _read(spark, d, "lineitem").groupBy(F.col("l_extendedprice").alias("value")).agg(F.sum(F.rint("l_quantity").cast("long")).alias("n"))
    q = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = binning.weighted_quantiles(counts, q)
    return spark.createDataFrame(list(zip(q, found)), "share double, value double").withColumn("value", _r("value", 4))


def categorical_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of codes; they are ordinals of the codes that are there."""
    codes = [1, 2, 5, 9, 14, 22]
    own = _read(spark, d, "customer").where(F.col("c_nationkey").isin(codes))
    return own.groupBy(F.col("c_nationkey").cast("int").alias("code"), binning.digitize(F.col("c_nationkey"), binning.code_edges(codes)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def bin_labels(spark: SparkSession, d: str) -> DataFrame:
    """Line items by named price classes."""
    edges = [0.0, 1000.0, 5000.5, 20_000.0, 60_000.0]
    names = spark.createDataFrame(list(enumerate(binning.labels(edges), 1)), "bin int, bin_name string")
    own = _read(spark, d, "lineitem").select(binning.histogram_bin(F.col("l_extendedprice"), edges).alias("bin"))
    return own.join(F.broadcast(names), "bin").groupBy("bin_name").agg(F.count(F.lit(1)).alias("n"))


def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return binning.systematic_sample(_read(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("v")), "v", 300)


def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Labels of brands and sizes and how many labels come before each in natural order."""
    own = _read(spark, d, "part").select(F.concat(F.lit("size "), F.col("p_size"), F.lit(" of "), F.col("p_brand")).alias("label")).distinct()
    keyed = own.withColumn("sort_key", labels.natural_key(F.col("label")))
    from pyspark.sql import Window

    return keyed.select("label", F.row_number().over(Window.orderBy("sort_key")).alias("place"))  # labels are few


def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").groupBy("l_suppkey").agg(_r(stats.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("price"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_round_trip": csv_round_trip, "attribute_scan": attribute_scan, "id_list": id_list, "paired_scan": paired_scan, "forest_majority": forest_majority, "zonal_sink": zonal_sink,
    "bins_from_file": bins_from_file, "raster_window": raster_window, "predicted_raster": predicted_raster, "model_file_sites": model_file_sites, "axis_projection": axis_projection,
    "wall_to_wall": wall_to_wall, "species_transform": species_transform, "aligned_stack": aligned_stack, "footprint_by_year": footprint_by_year, "unique_values": unique_values,
    "weighted_quantiles": weighted_quantiles, "categorical_classes": categorical_classes, "bin_labels": bin_labels, "systematic_sample": systematic_sample, "natural_order": natural_order,
    "weighted_means": weighted_means,
}

ORACLE_SQL: dict[str, str] = {
    "csv_round_trip": _CSV,
    "attribute_scan": "SELECT c_nationkey::INT AS c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) + 0 AS balance FROM customer GROUP BY 1",
    "id_list": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey = 0",
    "paired_scan": "WITH o AS (SELECT o_custkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_acctbal > 0) SELECT 'o' AS side, count(*) AS n, count(DISTINCT id) AS ids, round(sum(v), 2) + 0 AS total FROM o WHERE id IN (SELECT id FROM p) UNION ALL SELECT 'p', count(*), count(DISTINCT id), round(sum(v), 2) + 0 FROM p WHERE id IN (SELECT id FROM o)",
    "forest_majority": "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_custkey AS id, l_orderkey, n AS PNT_COUNT FROM c JOIN orders ON l_orderkey = o_orderkey WHERE n >= 4 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "zonal_sink": "SELECT l_orderkey AS FCID, l_linenumber::BIGINT AS PIXEL_NUMBER, (l_linenumber % 3 + 1)::BIGINT AS NEIGHBOR, l_partkey AS NEIGHBOR_ID, round(l_extendedprice / 7, 4) + 0 AS DISTANCE FROM lineitem",
    "bins_from_file": "SELECT 'l_quantity' AS variable, CASE WHEN l_quantity < 1 THEN NULL WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 50.0001 THEN 3 END AS class, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_discount', CASE WHEN l_discount < 0 THEN NULL WHEN l_discount < 0.02 THEN 1 WHEN l_discount < 0.05 THEN 2 WHEN l_discount < 0.1001 THEN 3 END, count(*) FROM lineitem GROUP BY 2",
    "raster_window": "SELECT (p_partkey // 40)::INT AS row, (p_partkey % 40)::INT AS col, round(p_retailprice, 2) + 0 AS value FROM part WHERE p_partkey // 40 BETWEEN 3 AND 18",
    "predicted_raster": "SELECT p_size::DOUBLE AS value, round(count(*) * 0.09, 4)::DOUBLE AS area FROM part WHERE p_size % 9 <> 0 GROUP BY 1 UNION ALL SELECT NULL, round(count(*) * 0.09, 4)::DOUBLE FROM part WHERE p_size % 9 = 0",
    "model_file_sites": f"WITH {_SITES} SELECT id, 1e0 AS weight, round(a, 6) + 0 AS lc1, round(b, 6) + 0 AS lc2, round(2 * a, 6) + 0 AS wa1, round(2 * b, 6) + 0 AS wa2 FROM si",
    "axis_projection": "SELECT c_custkey AS id, 1 AS pixel_number, round(((c_acctbal - 4000) * 0.001e0 + (c_nationkey - 12) * 0.05e0) * 0.8e0, 7) + 0 AS axis1, round(((c_acctbal - 4000) * 0.0005e0 + (c_nationkey - 12) * -0.1e0) * 0.5e0, 7) + 0 AS axis2 FROM customer WHERE c_custkey % 13 <> 0",
    "wall_to_wall": _WALL,
    "species_transform": _LONG,
    "aligned_stack": "SELECT (p_partkey // 40)::INT AS row, (p_partkey % 40)::INT AS col, p_size AS first, round(p_retailprice, 2) + 0 AS second, p_size % 5 AS third FROM part WHERE p_size > 5 AND p_partkey % 40 % 4 <> 1",
    "footprint_by_year": _BY_YEAR,
    "unique_values": "SELECT DISTINCT round(l_quantity * l_discount, 4) + 0 AS v FROM lineitem WHERE l_quantity > 3",
    "weighted_quantiles": "WITH x AS (SELECT l_extendedprice AS v, unnest(range(l_quantity::BIGINT)) FROM lineitem), q AS (SELECT unnest([0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]::DOUBLE[]) AS share, unnest((SELECT quantile_cont(v, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]) FROM x)) AS v) SELECT share, round(v, 4) + 0 AS value FROM q",
    "categorical_classes": "SELECT c_nationkey::INT AS code, list_position([1, 2, 5, 9, 14, 22], c_nationkey)::INT AS class, count(*) AS n FROM customer WHERE c_nationkey IN (1, 2, 5, 9, 14, 22) GROUP BY 1, 2",
    "bin_labels": "SELECT CASE WHEN l_extendedprice < 1000 THEN '0.0-1000.0' WHEN l_extendedprice < 5000.5 THEN '1000.0-5000.5' WHEN l_extendedprice < 20000 THEN '5000.5-20000.0' ELSE '20000.0-60000.0' END AS bin_name, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 60000 GROUP BY 1",
    "systematic_sample": "WITH s AS (SELECT o_totalprice::DOUBLE AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT v FROM s WHERE k % greatest(1, n // 300) = 0 UNION ALL SELECT v FROM s WHERE k = n - 1 AND k % greatest(1, n // 300) <> 0",
    "natural_order": "WITH l AS (SELECT DISTINCT 'size ' || p_size || ' of ' || p_brand AS label, p_size FROM part) SELECT label, row_number() OVER (ORDER BY p_size, label)::INT AS place FROM l",
    "weighted_means": "SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) + 0 AS price FROM lineitem GROUP BY 1",
}
