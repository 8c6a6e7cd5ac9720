"""Registered queries over the driver's tables and the SQL that checks each.

The tables stand in for the domain's: embeddings are plots (scores: the first eight
elements; location: four ids in a row), nations by brands are sites by species, orders with
the sums of their line items are observed and predicted values, nations and regions are fine
and coarse areas.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.operators import accuracy, binning, classify, impute, neighbors, ordination, rasters, tiles
from mossgrid.sources import tables

from . import diagnostics

AXES, K, MOST = 8, 7, 24
FLAGSHIP = "impute_continuous"


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


# --- neighbors and imputation -------------------------------------------------------------


def plots(spark: SparkSession, d: str, axes: int = AXES) -> DataFrame:
    e = F.col("embedding")
    return _read(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit(1).alias("pixel_number"), F.slice(e, 1, axes).cast("array<double>").alias("scores"),
        F.floor(F.col("vec_id") / 4).alias("loc_id"), "label", e[8].cast("double").alias("a"), e[9].cast("double").alias("b"),
    )


def _near(spark: SparkSession, d: str, axes: int = AXES, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    p = plots(spark, d, axes)
    return p, neighbors.knn(p, p, most)


_P = "p AS (SELECT vec_id AS id, vec_id // 4 AS loc, embedding[1:8]::DOUBLE[] AS s, label, embedding[9]::DOUBLE AS a, embedding[10]::DOUBLE AS b FROM embeddings)"
_RANKED = f"{_P}, d AS (SELECT t.id, n.id AS neighbor_id, list_distance(t.s, n.s) AS distance, n.a, n.b, n.label FROM p t JOIN p n ON true), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, id <> neighbor_id, neighbor_id) AS rank FROM d)"
_INDEPENDENT = f"{_P}, d AS (SELECT t.id, n.id AS neighbor_id, list_distance(t.s, n.s) AS distance, n.a, n.b, n.label FROM p t JOIN p n ON t.loc <> n.loc), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor_id) AS rank FROM d)"


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("pixel_number"), F.col("embedding").cast("array<double>").alias("scores"))
    return neighbors.knn(p, p, 5).select("id", "rank", "neighbor_id", _r("distance").alias("distance"))


def knn_independent(spark: SparkSession, d: str) -> DataFrame:
    p, near = _near(spark, d)
    return neighbors.top_k(neighbors.independent(near, p.select("id", "loc_id")), K).select("id", "rank", "neighbor_id", _r("distance").alias("distance"))


def knn_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Twelve nearest of moved plots in small cells and blocks, the same reference kept in cells."""
    p = plots(spark, d)
    moved = p.withColumn("scores", F.transform("scores", lambda x, k: x + F.sin(F.col("id") * 7 + k) / 10))
    index = neighbors.build_index(p, 12, cell_rows=40, block_rows=16)
    return neighbors.search(moved, index, 12).select("id", "rank", "neighbor_id", _r("distance").alias("distance"))


def impute_all_groups(spark: SparkSession, d: str) -> DataFrame:
    """Four rows make a plot: a by inverse distances, label by majority, b of the first neighbor."""
    p, near = _near(spark, d)
    pixels = neighbors.independent(near, p.select("id", "loc_id")).withColumns({"pixel_number": (F.col("id") % 4).cast("int"), "id": F.floor(F.col("id") / 4)})
    out = impute.predict_all(pixels, p, K, "INVERSE_DISTANCES", ["a"], ["label"], ["b"])
    return out.select("id", _r("a").alias("a"), "label", _r("b").alias("b"))


def multiscale_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Agreement and distribution statistics by k, at plots and in two sizes of hexes."""
    p, near = _near(spark, d)
    hexes = p.select("id", (F.col("id") % 5).alias("HEX_5"), (F.col("id") % 31).alias("HEX_31"))
    own = {"observed": p.select("id", "a", "b"), "neighbors": near, "hex": hexes, "crosswalk": p.select("id", "loc_id")}
    c = diagnostics.Context(own, ["a", "b"], k=3, weights="INVERSE_DISTANCES", k_values=[1, 3], hex_levels={"HEX_5": 10, "HEX_31": 16})
    return diagnostics.multiscale(c)["multiscale_accuracy"].withColumn("value", _r("value", 4) + F.lit(0.0))


def requested_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """First neighbors of a list of ids with repeats, with places in the list."""
    _, near = _near(spark, d)
    wanted = _read(spark, d, "orders").select((F.col("o_custkey") % 997).alias("id"), F.col("o_orderkey").alias("place"))
    return tables.requested(near.where("rank = 1").select("id", "neighbor_id"), wanted, "id").select("place", "id", "neighbor_id")


def _impute(weights) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p, near = _near(spark, d)
        out = impute.predict(near, p, ["a", "b"], K, weights, p.select("id", "loc_id"))
        return out.select("id", _r("a").alias("a"), _r("b").alias("b"))

    return run


def _impute_sql(weight: str) -> str:
    return f"WITH {_INDEPENDENT}, w AS (SELECT *, {weight} AS w FROM r WHERE rank <= {K}) SELECT id, round(sum(w * a) / sum(w), 6) AS a, round(sum(w * b) / sum(w), 6) AS b FROM w GROUP BY id"


def impute_categorical(spark: SparkSession, d: str) -> DataFrame:
    p, near = _near(spark, d)
    pixels = near.withColumns({"pixel_number": (F.col("id") % 5).cast("int"), "id": F.floor(F.col("id") / 5)})  # five rows make a plot
    return impute.predict_categorical(pixels.where("neighbor_id % 5 <> pixel_number or floor(neighbor_id / 5) <> id"), p, ["label"])


def zonal_records(spark: SparkSession, d: str) -> DataFrame:
    _, near = _near(spark, d)
    return impute.zonal(near, 3).withColumn("distance", _r("distance"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Plots looked for by slightly other scores than their own."""
    p = plots(spark, d)
    moved = p.withColumn("scores", F.transform("scores", lambda x, i: x + F.when(i == 0, F.col("a")).otherwise(F.lit(0.0))))
    return neighbors.self_position(neighbors.knn(moved, p, MOST), MOST)


_POSITION = f"{_P}, d AS (SELECT t.id, n.id AS neighbor_id, list_distance([t.s[1] + t.a, t.s[2], t.s[3], t.s[4], t.s[5], t.s[6], t.s[7], t.s[8]], n.s) AS distance FROM p t JOIN p n ON true), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, id <> neighbor_id, neighbor_id) AS rank FROM d), q AS (SELECT id, coalesce(min(CASE WHEN id = neighbor_id THEN rank END), {MOST})::DOUBLE AS average_position FROM r WHERE rank <= {MOST} GROUP BY id)"


# --- observed and predicted ---------------------------------------------------------------


def order_pairs(spark: SparkSession, d: str) -> DataFrame:
    item = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("predicted"))
    return _read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("variable"), F.col("o_totalprice").alias("observed")).join(item, "o_orderkey")


_OP = "op AS (SELECT o_orderkey, o_orderpriority AS variable, o_totalprice AS o, p FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS p FROM lineitem GROUP BY 1) i ON l_orderkey = o_orderkey)"
_RANKS = "rk AS (SELECT variable, rank() OVER (PARTITION BY variable ORDER BY o) + (count(*) OVER (PARTITION BY variable, o) - 1) / 2e0 AS ro, rank() OVER (PARTITION BY variable ORDER BY p) + (count(*) OVER (PARTITION BY variable, p) - 1) / 2e0 AS rp FROM op), sp AS (SELECT variable, covar_pop(ro, rp) / (stddev_pop(ro) * stddev_pop(rp)) AS s FROM rk GROUP BY variable)"


def local_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = accuracy.local_accuracy(order_pairs(spark, d))
    return out.select("variable", *[_r(c).alias(c) for c in out.columns if c != "variable"])


def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.spearman(order_pairs(spark, d), ["variable"], "observed", "predicted").select("variable", _r("spearman_r").alias("spearman_r"))


def skewed_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks where nine rows in ten have the value 0."""
    over = F.greatest(F.col("l_quantity") - 45, F.lit(0)).cast("double")
    own = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", over.alias("v"))
    return accuracy.average_rank(own, ["l_returnflag"], "v", "rank").groupBy("l_returnflag", "v").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("least"), F.max("rank").alias("most"))


def regression_lines(spark: SparkSession, d: str) -> DataFrame:
    out = accuracy.regression_lines(order_pairs(spark, d), "variable", "observed", "predicted")
    return out.select("variable", *[_r(c, 4).alias(c) for c in out.columns if c != "variable"])


def gmfr_ac(spark: SparkSession, d: str) -> DataFrame:
    out = accuracy.agreement(order_pairs(spark, d), "variable", "observed", "predicted")
    return out.select("variable", _r("gmfr_a", 3).alias("gmfr_a"), *[_r(c).alias(c) for c in ("gmfr_b", "ac", "ac_sys", "ac_uns")])


def ks_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = accuracy.ks(order_pairs(spark, d), "variable", "observed", "predicted")
    return out.select("variable", _r("ks_max").alias("ks_max"), _r("ks_mean").alias("ks_mean"))


def brand_pairs(spark: SparkSession, d: str) -> DataFrame:
    """customer, brand, quantity in finished and open orders (0 where none)."""
    part = _read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("species"))
    orders = _read(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    own = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(orders, "l_orderkey").join(part, "l_partkey")
    return own.groupBy("o_custkey", "species").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("observed"), F.sum(F.when(F.col("o_orderstatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("predicted"))


_BP = "bp AS (SELECT o_custkey, p_brand AS species, sum(CASE WHEN o_orderstatus = 'F' THEN l_quantity ELSE 0 END) AS o, sum(CASE WHEN o_orderstatus = 'O' THEN l_quantity ELSE 0 END) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2), bm AS (SELECT species, count(*) FILTER (WHERE o > 0 AND p > 0) AS n_pp, count(*) FILTER (WHERE o > 0 AND NOT p > 0) AS n_pa, count(*) FILTER (WHERE NOT o > 0 AND p > 0) AS n_ap, count(*) FILTER (WHERE NOT o > 0 AND NOT p > 0) AS n_aa FROM bp GROUP BY species)"


def binary_error_matrix(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.species_accuracy(brand_pairs(spark, d), "species", "observed", "predicted").select("species", "n_pp", "n_pa", "n_ap", "n_aa")


def species_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = accuracy.species_accuracy(brand_pairs(spark, d), "species", "observed", "predicted").drop("n_pp", "n_pa", "n_ap", "n_aa")
    return out.select("species", *[_r(c).alias(c) for c in out.columns if c != "species"])


def variable_deviation(spark: SparkSession, d: str) -> DataFrame:
    pairs = order_pairs(spark, d)
    least = spark.createDataFrame([("1-URGENT", 250_000.0), ("2-HIGH", 260_000.0), ("5-LOW", 270_000.0)], "variable string, min_deviation double")
    return accuracy.deviations(pairs, least, F.col("observed"), F.col("predicted")).select(F.col("o_orderkey").alias("id"), "variable", _r("deviation", 2).alias("deviation"))


def obs_prd_pairing(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.month("o_orderdate").alias("month"))
    p = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("price"), F.min(F.month("l_shipdate")).alias("month"))
    return accuracy.long_pairs(o, p, "id", ["price", "month"]).select("id", "variable", _r("observed", 3).alias("observed"), _r("predicted", 3).alias("predicted"))


# --- binning ------------------------------------------------------------------------------


def _edges(spark: SparkSession, edges: list[float]) -> DataFrame:
    return spark.createDataFrame([(k, float(round(e, 6))) for k, e in enumerate(edges)], "place int, edge double")


def equal_interval_bins(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, binning.edges_by("EQUAL_INTERVAL", _read(spark, d, "lineitem"), "l_extendedprice", 10))


def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, binning.edges_by("QUANTILE", _read(spark, d, "lineitem"), "l_extendedprice", 10))


def natural_bins(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, binning.edges_by("NATURAL_BREAKS", _read(spark, d, "lineitem"), "l_quantity", 7))


def custom_digitize(spark: SparkSession, d: str) -> DataFrame:
    own = binning.digitize(F.col("l_quantity"), binning.custom_edges([1, 10, 20, 35, 50]))
    return _read(spark, d, "lineitem").groupBy(own.alias("class")).agg(F.count(F.lit(1)).alias("n"), _r(F.sum("l_quantity"), 2).alias("quantity"))


_HIST = [0.0, 1e4, 2e4, 3e4, 4e4, 5e4, 6e4, 7e4, 8e4, 9e4, 1.2e5]


def weighted_histogram(spark: SparkSession, d: str) -> DataFrame:
    out = binning.weighted_histogram(_read(spark, d, "lineitem"), "l_extendedprice", "l_quantity", _HIST)
    return out.select("bin", _r("area", 2).alias("area"))


def categorical_histogram(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "orders")
    return binning.categorical_histogram(own.where("o_orderstatus = 'F'"), own.where("o_orderstatus = 'O'"), "o_orderpriority")


def _seven(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    pairs = order_pairs(spark, d)
    return pairs, binning.equal_edges(*binning.span(pairs, "observed", "predicted"), 7)


def error_matrix_binned(spark: SparkSession, d: str) -> DataFrame:
    pairs, edges = _seven(spark, d)
    return binning.error_matrix_binned(pairs, F.col("observed"), F.col("predicted"), edges)


_SEVEN = f"{_OP}, sr AS (SELECT least(min(o), min(p)) AS lo, greatest(max(o), max(p)) AS hi FROM op), cl AS (SELECT least(7, floor((o - lo) / ((hi - lo) / 7)) + 1)::INT AS oc, least(7, floor((p - lo) / ((hi - lo) / 7)) + 1)::INT AS pc, o, p FROM op, sr), em AS (SELECT a.c AS observed, b.c AS predicted, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(1, 8)) AS c) a JOIN (SELECT unnest(range(1, 8)) AS c) b ON true LEFT JOIN (SELECT oc, pc, count(*) AS n FROM cl GROUP BY 1, 2) x ON a.c = oc AND b.c = pc)"


# --- classes ------------------------------------------------------------------------------


def part_classes(spark: SparkSession, d: str) -> DataFrame:
    """Per line item: a class from arithmetic proxies of its part and one of its own."""
    part = _read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    own = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_quantity", "l_tax").join(part, "l_partkey")
    o = classify.vegclass(F.col("p_size") * F.lit(1.6), F.col("l_discount") * F.lit(8.0), F.col("l_quantity") * F.lit(2.0))
    p = classify.vegclass(F.col("p_size") * F.lit(1.2), F.col("l_tax") * F.lit(10.0), F.col("l_quantity") * F.lit(1.9))
    return own.select("l_orderkey", "l_partkey", o.alias("observed"), p.alias("predicted"))


def _class_sql(size: str, hardwood: str, cover: str) -> str:
    s = f"CASE WHEN {size} < 2.5 THEN 1 WHEN {size} < 25 THEN 2 WHEN {size} < 37.5 THEN 3 WHEN {size} < 50 THEN 4 WHEN {size} < 75 THEN 5 ELSE 6 END"
    return f"CASE WHEN {cover} < 10 THEN 1 WHEN {cover} < 40 THEN 2 WHEN {hardwood} >= 0.65 THEN (CASE WHEN {s} <= 2 THEN 3 ELSE 4 END) WHEN {hardwood} >= 0.2 THEN (CASE WHEN {s} <= 2 THEN 5 WHEN {s} <= 4 THEN 6 ELSE 7 END) ELSE (CASE WHEN {s} <= 2 THEN 8 WHEN {s} <= 4 THEN 9 WHEN {s} = 5 THEN 10 ELSE 11 END) END"


_PC = f"pc AS (SELECT l_orderkey, l_partkey, {_class_sql('(p_size * 1.6e0)', '(l_discount * 8e0)', '(l_quantity * 2e0)')} AS o, {_class_sql('(p_size * 1.2e0)', '(l_tax * 10e0)', '(l_quantity * 1.9e0)')} AS p FROM lineitem JOIN part ON l_partkey = p_partkey)"
_EM = f"{_PC}, cs AS (SELECT o AS c FROM pc UNION SELECT p FROM pc), em AS (SELECT a.c AS observed, b.c AS predicted, coalesce(n, 0)::BIGINT AS n FROM cs a JOIN cs b ON true LEFT JOIN (SELECT o, p, count(*) AS n FROM pc GROUP BY 1, 2) x ON a.c = o AND b.c = p)"
_FZ = "fz(c, f) AS (VALUES " + ", ".join(f"({c}, {f})" for c, own in classify.FUZZY.items() for f in own) + ")"
_SEV = "sv(o, p, s) AS (VALUES " + ", ".join(f"({o}, {p}, '{s}')" for s, own in classify.SEVERITY.items() for o, ps in own.items() for p in ps) + ")"


def vegclass_case(spark: SparkSession, d: str) -> DataFrame:
    return part_classes(spark, d).groupBy("observed", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return classify.error_matrix(part_classes(spark, d))


def vegclass_error_matrix(spark: SparkSession, d: str) -> DataFrame:
    out = classify.totals(_matrix(spark, d), classify.fuzzy_table(spark))
    return out.select("observed", "predicted", "n", "exact", "fuzzy", _r("percent_correct").alias("percent_correct"), _r("percent_fuzzy").alias("percent_fuzzy"))


def kappa_by_class(spark: SparkSession, d: str) -> DataFrame:
    return classify.kappa_by_class(_matrix(spark, d)).select("class", _r("kappa").alias("kappa"))


def kappa_by_class_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return classify.kappa_by_class(_matrix(spark, d), classify.fuzzy_table(spark)).select("class", _r("kappa").alias("kappa"))


def fuzzy_kappa(spark: SparkSession, d: str) -> DataFrame:
    m = _matrix(spark, d)
    return classify.kappa(m).crossJoin(classify.fuzzy_kappa(m, classify.fuzzy_table(spark)).withColumnRenamed("kappa", "fuzzy")).select(_r("kappa").alias("kappa"), _r("fuzzy").alias("fuzzy_kappa"))


def vegclass_outlier(spark: SparkSession, d: str) -> DataFrame:
    return classify.severity(part_classes(spark, d)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def vegclass_variety(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ten make a plot; a first neighbor's class is its label plus one."""
    p, near = _near(spark, d)
    others = neighbors.top_k(neighbors.not_self(near), 1).withColumns({"pixel_number": (F.col("id") % 10).cast("int"), "id": F.floor(F.col("id") / 10)})
    return classify.variety(others, p.select("id", (F.col("label") + 1).alias("class")))


def _kappa_sql(a: str, b: str, c: str, e: str) -> str:
    n = f"({a} + {b} + {c} + {e})::DOUBLE"
    ch = f"((({a} + {b}) * ({a} + {c}) + ({c} + {e}) * ({b} + {e}))::DOUBLE / {n})"
    return f"CASE WHEN {n} = {ch} THEN 0 ELSE ({a} + {e} - {ch}) / ({n} - {ch}) END"


_WHOLE_KAPPA = "(SELECT (d - rc / n) / (n - rc / n) FROM (SELECT sum(n)::DOUBLE AS n, sum(CASE WHEN observed = predicted THEN n ELSE 0 END)::DOUBLE AS d FROM {m}) JOIN (SELECT sum(r * c)::DOUBLE AS rc FROM (SELECT observed AS k, sum(n)::DOUBLE AS r FROM {m} GROUP BY 1) JOIN (SELECT predicted AS k, sum(n)::DOUBLE AS c FROM {m} GROUP BY 1) USING (k)) ON true)"


# --- areas --------------------------------------------------------------------------------


def hex_mean_std(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    fine = accuracy.by_region(c.select(F.col("c_nationkey").alias("region"), "c_acctbal"), "region", ["c_acctbal"], 50)
    nation = _read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    wide = accuracy.by_region(c.join(F.broadcast(nation), "c_nationkey").select("region", "c_acctbal"), "region", ["c_acctbal"], 50)  # nations: 25 rows
    out = fine.withColumn("level", F.lit("fine")).unionByName(wide.withColumn("level", F.lit("coarse")))
    return out.select("level", "region", "variable", _r("mean").alias("mean"), _r("std").alias("std"), "n")


def olofsson_adjusted_area(spark: SparkSession, d: str) -> DataFrame:
    pairs, edges = _seven(spark, d)
    matrix = binning.error_matrix_binned(pairs, F.col("observed"), F.col("predicted"), edges).select(F.col("observed_class").alias("observed"), F.col("predicted_class").alias("predicted"), "n")
    areas = pairs.groupBy(binning.digitize(F.col("predicted"), edges).alias("class")).agg(F.sum("predicted").alias("area"))
    full = spark.range(1, 8).select(F.col("id").cast("int").alias("class")).join(areas, "class", "left").fillna(0.0)
    out = classify.adjusted_area(matrix, full)
    return out.select("class", _r("mapped", 2).alias("mapped"), _r("adjusted", 2).alias("adjusted"), _r("ci", 2).alias("ci"))


def regional_area_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Areas per bin of two datasets, after the shares of reserved ids."""
    own = _read(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 97 == 0, F.lit(-10001)).otherwise(F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("v"), (F.col("s_nationkey") + 1.0).alias("ha"))
    special, rest = classify.sentinel_areas(own, "id", "ha")
    edges = [-1000.0, 0.0, 2000.0, 4000.0, 6000.0, 10_000.0]
    first = special.select(F.lit("OBSERVED").alias("dataset"), F.lit("Nonforest").alias("bin_name"), F.col("nonforest").alias("area"))
    bins = binning.weighted_histogram(rest, "v", "ha", edges).select(F.lit("OBSERVED").alias("dataset"), F.concat(F.lit("bin"), F.col("bin")).alias("bin_name"), "area")
    prd = binning.weighted_histogram(_read(spark, d, "customer").select(F.col("c_acctbal").alias("v"), F.lit(0.09).alias("ha")), "v", "ha", edges).select(F.lit("PREDICTED").alias("dataset"), F.concat(F.lit("bin"), F.col("bin")).alias("bin_name"), "area")
    return first.unionByName(bins).unionByName(prd).withColumn("area", _r("area", 3))


def attribute_raster(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the plots laid out as a raster of 25 columns; every eleventh pixel no forest."""
    p, near = _near(spark, d)
    place = [F.floor(F.col("id") / 25).cast("int").alias("row"), (F.col("id") % 25).cast("int").alias("col")]
    pixels = near.where(F.col("rank") <= K).select(*place, "rank", "neighbor_id")
    mask = p.select(*place, (F.col("id") % 11 != 0).alias("forest"))
    return impute.attribute_raster(pixels, p.select("id", F.col("a").alias("value")), mask, impute.SEVEN_WEIGHTS, 1000.0)


_W7 = "[" + ", ".join(f"{x}::DOUBLE" for x in impute.SEVEN_WEIGHTS) + "]"


# --- ordination ---------------------------------------------------------------------------

_ENV = ["acctbal", "price", "discount"]


def site_species(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("species"))
    # orders meet their customers before line items, which are more, meet them
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(_read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("id")), "c_custkey").drop("c_custkey")
    own = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(orders, "l_orderkey").join(part, "l_partkey")
    return own.groupBy("id", "species").agg(F.sum("l_quantity").alias("x"))


def site_env(spark: SparkSession, d: str) -> DataFrame:
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", F.col("o_custkey").alias("c_custkey")).join(_read(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("long").alias("id")), "c_custkey").drop("c_custkey")
    own = _read(spark, d, "lineitem").select("l_orderkey", "l_discount").join(orders, "l_orderkey")
    return own.groupBy("id").agg(F.avg("c_acctbal").alias("acctbal"), F.avg("o_totalprice").alias("price"), F.avg("l_discount").alias("discount"))


_SS = "ss AS (SELECT c_nationkey::BIGINT AS id, p_brand AS species, sum(l_quantity) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
_SE = "se AS (SELECT c_nationkey::BIGINT AS id, avg(c_acctbal) AS acctbal, avg(o_totalprice) AS price, avg(l_discount) AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


def chi_square_residuals(spark: SparkSession, d: str) -> DataFrame:
    return ordination.chi_square_residuals(site_species(spark, d)).withColumn("residual", _r("residual", 9))


def species_downweighting(spark: SparkSession, d: str) -> DataFrame:
    """Brands whose last digit is 3 are rare: they are kept at few sites."""
    rare = F.col("species").endswith("3") & (F.col("id") % 12 != 0)
    return ordination.downweighted(site_species(spark, d).where(~rare)).withColumn("x", _r("x"))


def species_info_n2(spark: SparkSession, d: str) -> DataFrame:
    return ordination.species_info(site_species(spark, d)).withColumn("n2", _r("n2"))


def site_info_n2(spark: SparkSession, d: str) -> DataFrame:
    return ordination.site_info(site_species(spark, d)).withColumn("n2", _r("n2"))


def weighted_env_means(spark: SparkSession, d: str) -> DataFrame:
    out = ordination.weighted_means(site_species(spark, d), site_env(spark, d), _ENV)
    return out.select(*[_r(c).alias(c) for c in _ENV])


def cca_cross_products(spark: SparkSession, d: str) -> DataFrame:
    species, env = site_species(spark, d).persist(), site_env(spark, d).persist()  # read by each aggregate
    _, g, c, names, _ = ordination.cross_products(species, env, _ENV)
    species.unpersist(), env.unpersist()
    rows = [("G", a, b, float(g[i, j])) for i, a in enumerate(_ENV) for j, b in enumerate(_ENV)] + [("C", a, b, float(c[i, j])) for i, a in enumerate(_ENV) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "part string, variable string, other string, value double").withColumn("value", _r("value", 5) + F.lit(0.0))


def _axes(model: ordination.Ordination, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k + 1, float(e)) for k, e in enumerate(model.eigenvalues)], "axis int, eigenvalue double").withColumn("eigenvalue", _r("eigenvalue", 9))


def cca_eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    return _axes(ordination.cca(site_species(spark, d), site_env(spark, d), _ENV), spark)


def rda_eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    return _axes(ordination.rda(site_species(spark, d), site_env(spark, d), _ENV), spark)


def dbrda_eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    return _axes(ordination.dbrda(site_species(spark, d), site_env(spark, d), _ENV), spark)


def cca_site_scores(spark: SparkSession, d: str) -> DataFrame:
    return ordination.cca(site_species(spark, d), site_env(spark, d), _ENV).sites


def bray_curtis(spark: SparkSession, d: str) -> DataFrame:
    return ordination.bray_curtis(site_species(spark, d)).withColumn("distance", _r("distance", 9))


# --- windows and projection ---------------------------------------------------------------


def footprint_window(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as plots on a raster of parts, three by three cells each."""
    prints = rasters.footprint_table(spark, [rasters.Footprint("f", ((1, 1, 1), (1, 2, 1), (0, 1, 1)), 1.0)])
    own = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 20 + 1.5).alias("x"), (-(F.col("s_nationkey") % 10) - 1.5).alias("y"), F.lit("f").alias("key"))
    pixels = rasters.plot_pixels(own, prints, rasters.Geometry(0.0, 0.0, 1.0))
    stack = _read(spark, d, "part").select(F.floor(F.col("p_partkey") / 22).cast("int").alias("row"), (F.col("p_partkey") % 22).cast("int").alias("col"), F.col("p_size").cast("double").alias("size"))
    return rasters.extract(pixels, stack, ["size"]).select("id", "pixel_number", "row", "col", "size")


def footprint_tiles(spark: SparkSession, d: str) -> DataFrame:
    """As footprint_window, by a join of tiles."""
    own = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 20 + 1.5).alias("x"), (-(F.col("s_nationkey") % 10) - 1.5).alias("y"), F.lit("f").alias("key"))
    stack = _read(spark, d, "part").select(F.floor(F.col("p_partkey") / 22).cast("int").alias("row"), (F.col("p_partkey") % 22).cast("int").alias("col"), F.col("p_size").cast("double").alias("size"))
    prints = [rasters.Footprint("f", ((1, 1, 1), (1, 2, 1), (0, 1, 1)), 1.0)]
    return tiles.extract(own, tiles.to_tiles(stack, ["size"], 16), ["size"], prints, rasters.Geometry(0.0, 0.0, 1.0), tile=16)


def flag_projection(spark: SparkSession, d: str) -> DataFrame:
    from mossgrid.sources.attributes import AttributeField, project

    fields = [AttributeField("c_custkey", "ID"), AttributeField("c_acctbal", "CONTINUOUS", accuracy=True, project=True), AttributeField("c_nationkey", "CATEGORICAL", accuracy=True), AttributeField("c_mktsegment", "CHARACTER"), AttributeField("c_name", "CHARACTER")]
    return project(_read(spark, d, "customer"), fields, "c_custkey", accuracy=True, with_id=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "impute_continuous": _impute("INVERSE_DISTANCES"), "knn_topk": knn_topk, "knn_independent": knn_independent, "knn_partitioned": knn_partitioned,
    "impute_all_groups": impute_all_groups, "multiscale_accuracy": multiscale_accuracy, "requested_neighbors": requested_neighbors, "skewed_ranks": skewed_ranks, "species_downweighting": species_downweighting,
    "impute_equal_weights": _impute("EQUAL"), "impute_explicit_weights": _impute(impute.SEVEN_WEIGHTS),
    "impute_categorical_majority": impute_categorical, "zonal_records": zonal_records,
    "nn_index_position": _positions, "nn_index_outlier": lambda s, d: _positions(s, d).where("average_position >= 5"),
    "local_accuracy": local_accuracy, "spearman_rank": spearman_rank, "regression_lines": regression_lines, "gmfr_ac": gmfr_ac,
    "ks_statistics": ks_statistics, "binary_error_matrix": binary_error_matrix, "species_accuracy": species_accuracy,
    "variable_deviation_outlier": variable_deviation, "obs_prd_pairing": obs_prd_pairing,
    "equal_interval_bins": equal_interval_bins, "quantile_bins": quantile_bins, "natural_bins": natural_bins, "custom_digitize": custom_digitize,
    "weighted_histogram": weighted_histogram, "categorical_histogram": categorical_histogram, "error_matrix_binned": error_matrix_binned,
    "vegclass_case": vegclass_case, "vegclass_error_matrix": vegclass_error_matrix, "kappa_by_class": kappa_by_class, "kappa_by_class_fuzzy": kappa_by_class_fuzzy,
    "fuzzy_kappa": fuzzy_kappa, "vegclass_outlier": vegclass_outlier, "vegclass_variety": vegclass_variety,
    "hex_mean_std": hex_mean_std, "olofsson_adjusted_area": olofsson_adjusted_area, "regional_area_histogram": regional_area_histogram, "attribute_raster": attribute_raster,
    "chi_square_residuals": chi_square_residuals, "species_info_n2": species_info_n2, "site_info_n2": site_info_n2, "weighted_env_means": weighted_env_means,
    "cca_cross_products": cca_cross_products, "cca_eigenvalues": cca_eigenvalues, "rda_eigenvalues": rda_eigenvalues, "dbrda_eigenvalues": dbrda_eigenvalues,
    "cca_site_scores": cca_site_scores, "bray_curtis": bray_curtis,
    "footprint_window": footprint_window, "footprint_tiles": footprint_tiles, "flag_projection": flag_projection,
}

ORACLE_SQL: dict[str, str] = {
    "impute_continuous": _impute_sql("1 / CASE WHEN distance = 0 THEN 1e-12 ELSE distance END"),
    "impute_equal_weights": _impute_sql("1e0"),
    "impute_explicit_weights": _impute_sql(f"{_W7}[rank]"),
    "knn_topk": "WITH d AS (SELECT t.vec_id AS id, n.vec_id AS neighbor_id, list_distance(t.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS distance FROM embeddings t JOIN embeddings n ON true), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, id <> neighbor_id, neighbor_id) AS rank FROM d) SELECT id, rank::INT AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= 5",
    "species_downweighting": f"WITH {_SS}, r AS (SELECT * FROM ss WHERE NOT (species LIKE '%3' AND id % 12 <> 0)), o AS (SELECT species, sum(x) * sum(x) / (sum(x * x) + 1e-10) AS often FROM r GROUP BY 1), w AS (SELECT species, least(1, often / (max(often) OVER () / 5)) AS w FROM o) SELECT id, species, round(x * w, 6) AS x FROM r JOIN w USING (species)",
    "knn_partitioned": f"WITH {_P}, m AS (SELECT id, list_transform(s, lambda x, k: x + sin(id * 7 + k - 1) / 10) AS s FROM p), d AS (SELECT t.id, n.id AS neighbor_id, list_distance(t.s, n.s) AS distance FROM m t JOIN p n ON true), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, id <> neighbor_id, neighbor_id) AS rank FROM d) SELECT id, rank::INT AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= 12",
    "impute_all_groups": f"WITH {_RANKED}, i AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM r WHERE rank <= {MOST} AND id // 4 <> neighbor_id // 4), x AS (SELECT id // 4 AS plot, id, sum(CASE WHEN k <= {K} THEN a / CASE WHEN distance = 0 THEN 1e-12 ELSE distance END END) / sum(CASE WHEN k <= {K} THEN 1 / CASE WHEN distance = 0 THEN 1e-12 ELSE distance END END) AS a, max(CASE WHEN k = 1 THEN label END) AS label, max(CASE WHEN k = 1 THEN b END) AS b FROM i GROUP BY id), l AS (SELECT plot, label, row_number() OVER (PARTITION BY plot ORDER BY count(*) DESC, label) AS k FROM x GROUP BY plot, label) SELECT x.plot AS id, round(avg(a), 6) AS a, any_value(l.label) AS label, round(avg(b), 6) AS b FROM x JOIN l ON l.plot = x.plot AND k = 1 GROUP BY x.plot",
    "requested_neighbors": f"WITH {_RANKED} SELECT o_orderkey AS place, id, neighbor_id FROM orders JOIN r ON id = o_custkey % 997 AND rank = 1",
    "skewed_ranks": "WITH v AS (SELECT l_returnflag, greatest(l_quantity - 45, 0)::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY v) - (n - 1) / 2.0 AS r FROM v) SELECT l_returnflag, v, n, r::DOUBLE AS least, r::DOUBLE AS most FROM s",
    "knn_independent": f"WITH {_INDEPENDENT} SELECT id, rank::INT AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= {K}",
    "impute_categorical_majority": f"WITH {_RANKED}, f AS (SELECT id // 5 AS id, label, row_number() OVER (PARTITION BY id ORDER BY rank) AS f FROM r WHERE id <> neighbor_id), c AS (SELECT id, label, count(*) AS n FROM f WHERE f = 1 GROUP BY 1, 2) SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM c) WHERE k = 1",
    "zonal_records": f"WITH {_RANKED} SELECT id, 1 AS pixel_number, rank::INT AS neighbor, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= 3",
    "nn_index_position": f"WITH {_POSITION} SELECT id, average_position FROM q",
    "nn_index_outlier": f"WITH {_POSITION} SELECT id, average_position FROM q WHERE average_position >= 5",
    "local_accuracy": f"WITH {_OP}, {_RANKS} SELECT variable, round(covar_pop(o, p) / (stddev_pop(o) * stddev_pop(p)), 6) AS pearson_r, round(sqrt(avg((o - p) * (o - p))), 6) AS rmse, round(sqrt(avg((o - p) * (o - p))) / avg(o), 6) AS normalized_rmse, round(sum(p - o) / sum(o) * 100, 6) AS bias_percentage, round(1 - sum((o - p) * (o - p)) / (var_pop(o) * count(*)), 6) AS r_square, round(any_value(s), 6) AS spearman_r FROM op JOIN sp USING (variable) GROUP BY variable",
    "spearman_rank": f"WITH {_OP}, {_RANKS} SELECT variable, round(s, 6) AS spearman_r FROM sp",
    "regression_lines": f"WITH {_OP}, q AS (SELECT variable, regr_sxy(p, o) / regr_sxx(p, o) AS n, regr_syy(p, o) / regr_sxy(p, o) AS i, sqrt(regr_syy(p, o) / regr_sxx(p, o)) AS r, avg(o) AS x, avg(p) AS y FROM op GROUP BY variable) SELECT variable, round(n, 4) AS normal_slope, round(y - n * x, 4) AS normal_intercept, round(i, 4) AS inverse_slope, round(y - i * x, 4) AS inverse_intercept, round(r, 4) AS rma_slope, round(y - r * x, 4) AS rma_intercept FROM q",
    "gmfr_ac": f"WITH {_OP}, q AS (SELECT variable, avg(o) AS mx, avg(p) AS my, sqrt(var_pop(p) / var_pop(o)) AS b, avg(p) - sqrt(var_pop(p) / var_pop(o)) * avg(o) AS a FROM op GROUP BY variable), z AS (SELECT variable, any_value(a) AS a, any_value(b) AS b, sum((o - p) * (o - p)) AS ssd, sum(abs(o - (p - a) / b) * abs(p - (a + b * o))) AS spdu, sum((abs(mx - my) + abs(o - mx)) * (abs(mx - my) + abs(p - my))) AS spod FROM op JOIN q USING (variable) GROUP BY variable) SELECT variable, round(a, 3) AS gmfr_a, round(b, 6) AS gmfr_b, round(1 - ssd / spod, 6) AS ac, round(1 - (ssd - spdu) / spod, 6) AS ac_sys, round(1 - spdu / spod, 6) AS ac_uns FROM z",
    "ks_statistics": f"WITH {_OP}, q AS (SELECT variable, least(min(o), min(p)) AS lo, greatest(max(o), max(p)) AS hi, count(*) AS n FROM op GROUP BY variable), e AS (SELECT variable, o AS v, 1 AS s FROM op UNION ALL SELECT variable, p, -1 FROM op), c AS (SELECT e.variable, least(999, ceil((v - lo) / ((hi - lo) / 999e0)))::INT AS g, sum(s) AS s FROM e JOIN q USING (variable) GROUP BY 1, 2), w AS (SELECT variable, n, x.g, abs(sum(coalesce(s, 0)) OVER (PARTITION BY variable ORDER BY x.g)) / n::DOUBLE AS d FROM q JOIN (SELECT unnest(range(0, 1000)) AS g) x ON true LEFT JOIN c USING (variable, g)) SELECT variable, round(max(d), 6) AS ks_max, round(avg(d), 6) AS ks_mean FROM w GROUP BY variable",
    "binary_error_matrix": f"WITH {_BP} SELECT * FROM bm",
    "species_accuracy": f"WITH {_BP}, q AS (SELECT species, n_pp::DOUBLE AS a, n_pa::DOUBLE AS b, n_ap::DOUBLE AS c, n_aa::DOUBLE AS d, (n_pp + n_pa + n_ap + n_aa)::DOUBLE AS n FROM bm), z AS (SELECT *, CASE WHEN a + b = 0 THEN 1 ELSE a / (a + b) END AS se, CASE WHEN c + d = 0 THEN 1 ELSE d / (c + d) END AS sp, ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n) AS ch, (a + d) / n AS pc FROM q) SELECT species, round((a + b) / n, 6) AS prevalence, round(se, 6) AS sensitivity, round(1 - se, 6) AS false_negative_rate, round(sp, 6) AS specificity, round(1 - sp, 6) AS false_positive_rate, round(pc, 6) AS percent_correct, round(CASE WHEN a + c = 0 THEN 1 ELSE a / (a + c) END, 6) AS positive_predictive_power, round(CASE WHEN b * c = 0 THEN 1 ELSE a * d / (b * c) END, 6) AS odds_ratio, round(se + sp - 1, 6) AS true_skill, round(CASE WHEN ch = 1 THEN 0 ELSE (pc - ch) / (1 - ch) END, 6) AS kappa FROM z",
    "variable_deviation_outlier": f"WITH {_OP} SELECT o_orderkey AS id, variable, round(abs(o - p), 2) AS deviation FROM op JOIN (VALUES ('1-URGENT', 250000e0), ('2-HIGH', 260000e0), ('5-LOW', 270000e0)) m(v, m) ON v = variable WHERE abs(o - p) >= m",
    "obs_prd_pairing": "WITH i AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS price, min(month(l_shipdate)) AS month FROM lineitem GROUP BY 1) SELECT id, 'price' AS variable, round(o_totalprice, 3) AS observed, round(price, 3) AS predicted FROM orders JOIN i ON id = o_orderkey UNION ALL SELECT id, 'month', month(o_orderdate)::DOUBLE, i.month::DOUBLE FROM orders JOIN i ON id = o_orderkey",
    "equal_interval_bins": "SELECT k::INT AS place, round(lo + (hi - lo) * k / 10, 6) AS edge FROM (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) JOIN (SELECT unnest(range(0, 11)) AS k) ON true",
    "quantile_bins": "SELECT (k - 1)::INT AS place, round(q[k], 6) AS edge FROM (SELECT quantile_cont(l_extendedprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM lineitem) JOIN (SELECT unnest(range(1, 12)) AS k) ON true",
    "custom_digitize": "SELECT CASE WHEN l_quantity < 1 THEN NULL WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 WHEN l_quantity < 35 THEN 3 WHEN l_quantity < 50.0001 THEN 4 END AS class, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
    "weighted_histogram": "WITH b AS (SELECT k, [0, 1e4, 2e4, 3e4, 4e4, 5e4, 6e4, 7e4, 8e4, 9e4, 1.2e5][k] AS lo, [0, 1e4, 2e4, 3e4, 4e4, 5e4, 6e4, 7e4, 8e4, 9e4, 1.2e5][k + 1] AS hi FROM (SELECT unnest(range(1, 11)) AS k)) SELECT k::INT AS bin, round(coalesce(sum(l_quantity), 0), 2) AS area FROM b LEFT JOIN lineitem ON l_extendedprice >= lo AND (l_extendedprice < hi OR (k = 10 AND l_extendedprice = hi)) GROUP BY k",
    "categorical_histogram": "SELECT o_orderpriority AS class, count(*) FILTER (WHERE o_orderstatus = 'F') AS observed, count(*) FILTER (WHERE o_orderstatus = 'O') AS predicted FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    "error_matrix_binned": f"WITH {_SEVEN} SELECT observed::INT AS observed_class, predicted::INT AS predicted_class, n FROM em",
    "vegclass_case": f"WITH {_PC} SELECT o AS observed, p AS predicted, count(*) AS n FROM pc GROUP BY 1, 2",
    "vegclass_error_matrix": f"WITH {_EM}, {_FZ}, x AS (SELECT observed, predicted, n, CASE WHEN observed = predicted THEN n ELSE 0 END AS e, CASE WHEN f IS NOT NULL THEN n ELSE 0 END AS z FROM em LEFT JOIN fz ON c = observed AND f = predicted) SELECT observed, predicted, sum(n)::BIGINT AS n, sum(e)::BIGINT AS exact, sum(z)::BIGINT AS fuzzy, round(CASE WHEN sum(n) = 0 THEN NULL ELSE sum(e) * 100e0 / sum(n) END, 6) AS percent_correct, round(CASE WHEN sum(n) = 0 THEN NULL ELSE sum(z) * 100e0 / sum(n) END, 6) AS percent_fuzzy FROM x GROUP BY GROUPING SETS ((observed), (predicted), ())",
    "kappa_by_class": f"WITH {_EM}, q AS (SELECT k.c AS class, sum(CASE WHEN observed = k.c AND predicted = k.c THEN n ELSE 0 END) AS a, sum(CASE WHEN observed = k.c AND predicted <> k.c THEN n ELSE 0 END) AS b, sum(CASE WHEN observed <> k.c AND predicted = k.c THEN n ELSE 0 END) AS c, sum(CASE WHEN observed <> k.c AND predicted <> k.c THEN n ELSE 0 END) AS e FROM em JOIN cs k ON true GROUP BY 1) SELECT class, round({_kappa_sql('a', 'b', 'c', 'e')}, 6) AS kappa FROM q",
    "kappa_by_class_fuzzy": f"WITH {_EM}, {_FZ}, m AS (SELECT em.*, f IS NOT NULL AS z FROM em LEFT JOIN fz ON fz.c = observed AND f = predicted), q AS (SELECT k.c AS class, sum(CASE WHEN z AND (observed = k.c OR predicted = k.c) THEN n ELSE 0 END) AS a, sum(CASE WHEN NOT z AND observed = k.c THEN n ELSE 0 END) AS b, sum(CASE WHEN NOT z AND predicted = k.c THEN n ELSE 0 END) AS c, sum(n) AS t FROM m JOIN cs k ON true GROUP BY 1) SELECT class, round({_kappa_sql('a', 'b', 'c', '(t - a - b - c)')}, 6) AS kappa FROM q",
    "fuzzy_kappa": f"WITH {_EM}, {_FZ}, fm AS (SELECT observed, CASE WHEN f IS NOT NULL THEN observed ELSE predicted END AS predicted, sum(n) AS n FROM em LEFT JOIN fz ON c = observed AND f = predicted GROUP BY 1, 2) SELECT round({_WHOLE_KAPPA.format(m='em')}, 6) AS kappa, round({_WHOLE_KAPPA.format(m='fm')}, 6) AS fuzzy_kappa",
    "vegclass_outlier": f"WITH {_PC}, {_SEV} SELECT coalesce(s, 'green') AS severity, count(*) AS n FROM pc LEFT JOIN sv ON sv.o = pc.o AND sv.p = pc.p GROUP BY 1",
    "vegclass_variety": f"WITH {_RANKED}, f AS (SELECT id // 10 AS id, label + 1 AS c, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM r WHERE id <> neighbor_id), q AS (SELECT id, count(*) FILTER (WHERE c IN (1, 2, 3, 5, 8)) AS n_young, count(*) FILTER (WHERE c IN (7, 10, 11)) AS n_old FROM f WHERE k = 1 GROUP BY id) SELECT * FROM q WHERE n_young >= 2 AND n_old >= 2",
    "hex_mean_std": "SELECT 'fine' AS level, c_nationkey AS region, 'c_acctbal' AS variable, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std, count(*) AS n FROM customer GROUP BY 2 HAVING count(*) >= 50 UNION ALL SELECT 'coarse', n_regionkey, 'c_acctbal', round(avg(c_acctbal), 6), round(stddev_pop(c_acctbal), 6), count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 HAVING count(*) >= 50",
    "olofsson_adjusted_area": f"WITH {_SEVEN}, ar AS (SELECT k AS class, coalesce(sum(p), 0) AS area FROM (SELECT unnest(range(1, 8)) AS k) LEFT JOIN cl ON pc = k GROUP BY 1), t AS (SELECT sum(area) AS t FROM ar), rs AS (SELECT predicted, sum(n) AS rn FROM em GROUP BY 1), x AS (SELECT observed, CASE WHEN rn = 0 THEN 0 ELSE n / rn::DOUBLE END AS p, area / t AS w, t, rn FROM em JOIN rs USING (predicted) JOIN ar ON class = predicted, t), y AS (SELECT observed, sum(w * p) * any_value(t) AS adjusted, 2 * sqrt(sum(w * w * p * (1 - p) / (greatest(rn, 2) - 1))) * any_value(t) AS ci FROM x GROUP BY 1) SELECT class::INT AS class, round(area, 2) AS mapped, round(adjusted, 2) AS adjusted, round(ci, 2) AS ci FROM ar JOIN y ON observed = class",
    "regional_area_histogram": "WITH e AS (SELECT k, [-1000, 0, 2000, 4000, 6000, 10000][k] AS lo, [-1000, 0, 2000, 4000, 6000, 10000][k + 1] AS hi FROM (SELECT unnest(range(1, 6)) AS k)), s AS (SELECT s_suppkey % 97 = 0 AS nf, s_acctbal AS v, s_nationkey + 1e0 AS ha FROM supplier) SELECT 'OBSERVED' AS dataset, 'Nonforest' AS bin_name, round(coalesce(max(CASE WHEN nf THEN ha END), 0), 3) AS area FROM s UNION ALL SELECT 'OBSERVED', 'bin' || k, round(coalesce(sum(ha), 0), 3) FROM e LEFT JOIN (SELECT * FROM s WHERE NOT nf AND true) ON v >= lo AND (v < hi OR (k = 5 AND v = hi)) GROUP BY k UNION ALL SELECT 'PREDICTED', 'bin' || k, round(coalesce(sum(CASE WHEN c_acctbal IS NULL THEN NULL ELSE 0.09e0 END), 0), 3) FROM e LEFT JOIN customer ON c_acctbal >= lo AND (c_acctbal < hi OR (k = 5 AND c_acctbal = hi)) GROUP BY k",
    "attribute_raster": f"WITH {_RANKED}, q AS (SELECT id, sum({_W7}[rank] / list_sum({_W7}) * a) AS v FROM r WHERE rank <= {K} GROUP BY id) SELECT (id // 25)::INT AS row, (id % 25)::INT AS col, CASE WHEN id % 11 = 0 THEN -1 ELSE round_even(v * 1000, 0)::INT END AS value FROM q",
    "chi_square_residuals": f"WITH {_SS}, t AS (SELECT sum(x) AS t FROM ss), r AS (SELECT id, sum(x) AS r FROM ss GROUP BY 1), c AS (SELECT species, sum(x) AS c FROM ss GROUP BY 1) SELECT r.id, c.species, round((coalesce(x, 0) / t - r / t * c / t) / sqrt(r / t * c / t), 9) AS residual FROM r JOIN c ON true JOIN t ON true LEFT JOIN ss ON ss.id = r.id AND ss.species = c.species",
    "species_info_n2": f"WITH {_SS} SELECT species, sum(x) AS weight, round(sum(x) * sum(x) / sum(x * x), 6) AS n2 FROM ss GROUP BY 1",
    "site_info_n2": f"WITH {_SS} SELECT id, sum(x) AS weight, round(sum(x) * sum(x) / sum(x * x), 6) AS n2 FROM ss GROUP BY 1",
    "weighted_env_means": f"WITH {_SS}, {_SE}, w AS (SELECT id, sum(x) AS w FROM ss GROUP BY 1) SELECT round(sum(w * acctbal) / sum(w), 6) AS acctbal, round(sum(w * price) / sum(w), 6) AS price, round(sum(w * discount) / sum(w), 6) AS discount FROM w JOIN se USING (id)",
    "cca_cross_products": f"WITH {_SS}, {_SE}, w AS (SELECT id, sum(x) AS w FROM ss GROUP BY 1), l AS (SELECT id, w, unnest(['acctbal', 'price', 'discount']) AS v, unnest([acctbal, price, discount]) AS e FROM w JOIN se USING (id)), m AS (SELECT v, sum(w * e) / sum(w) AS m FROM l GROUP BY 1), y AS (SELECT id, w, v, e - m AS y FROM l JOIN m USING (v)), t AS (SELECT sum(x) AS t FROM ss), cx AS (SELECT species, sum(x) AS c FROM ss GROUP BY 1) SELECT 'G' AS part, a.v AS variable, b.v AS other, round(sum(a.w / t * a.y * b.y), 5) + 0 AS value FROM y a JOIN y b ON a.id = b.id, t GROUP BY 2, 3 UNION ALL SELECT 'C', v, species, round(sum(x / t * y) / sqrt(any_value(c) / any_value(t)), 5) + 0 FROM ss JOIN y USING (id) JOIN cx USING (species), t GROUP BY 2, 3",
    "bray_curtis": f"WITH {_SS}, s AS (SELECT id, sum(x) AS s FROM ss GROUP BY 1), m AS (SELECT a.id AS a, b.id AS b, sum(least(a.x, b.x)) AS m FROM ss a JOIN ss b ON a.species = b.species AND a.id < b.id GROUP BY 1, 2) SELECT p.id AS a, q.id AS b, round(1 - 2 * coalesce(m, 0) / (p.s + q.s), 9) AS distance FROM s p JOIN s q ON p.id < q.id LEFT JOIN m ON m.a = p.id AND m.b = q.id",
    "footprint_window": "WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 20 + 1)::INT AS c, (s_nationkey % 10 + 1)::INT AS r FROM supplier), o AS (SELECT unnest(range(0, 9)) AS k) SELECT id, (k + 1)::INT AS pixel_number, (r + k // 3 - 1)::INT AS row, (c + k % 3 - 1)::INT AS col, p_size::DOUBLE AS size FROM s JOIN o ON true JOIN part ON p_partkey // 22 = r + k // 3 - 1 AND p_partkey % 22 = c + k % 3 - 1",
    "flag_projection": "SELECT c_custkey, c_acctbal, c_nationkey FROM customer",
}
ORACLE_SQL["footprint_tiles"] = ORACLE_SQL["footprint_window"]


def _multiscale_sql() -> str:
    """The statistics of gmfr_ac and ks_statistics, over a table of all levels and k."""
    bare = lambda name: re.sub(r"round\(((?:[^()]|\([^()]*\))*), \d\) AS", r"\1 AS", ORACLE_SQL[name].removeprefix(f"WITH {_OP}, "))
    raw = "1 / CASE WHEN distance = 0 THEN 1e-12 ELSE distance END"
    sums = ", ".join(f"sum(CASE WHEN k <= 3 THEN {v} * {raw} END) / sum(CASE WHEN k <= 3 THEN {raw} END) AS {v}3, max(CASE WHEN k = 1 THEN {v} END) AS {v}1" for v in "ab")
    each = " UNION ALL ".join(f"SELECT p.id, {k} AS k, '{v}' AS variable, p.{v} AS o, i.{v}{k} AS p FROM p JOIN i USING (id)" for v in "ab" for k in (1, 3))
    hexes = " UNION ALL ".join(f"SELECT 'HEX_{n}_{kind}', k, variable, {f}(o), {f}(p) FROM e GROUP BY id % {n}, k, variable HAVING count(*) >= {least}" for n, least in ((5, 10), (31, 16)) for kind, f in (("MEAN", "avg"), ("STD", "stddev_pop")))
    names = ["gmfr_a", "gmfr_b", "ac", "ac_sys", "ac_uns", "ks_max", "ks_mean"]
    out = " UNION ALL ".join(f"SELECT split_part(variable, '/', 1) AS level, split_part(variable, '/', 2)::INT AS k, split_part(variable, '/', 3) AS variable, '{n.upper()}' AS statistic, round({n}, 4) + 0 AS value FROM st" for n in names)
    return (
        f"WITH {_RANKED}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM r WHERE rank <= {MOST} AND id // 4 <> neighbor_id // 4), i AS (SELECT id, {sums} FROM n GROUP BY id), e AS ({each}), "
        f"lv(level, k, variable, o, p) AS (SELECT 'plot', k, variable, o, p FROM e UNION ALL {hexes}), op AS (SELECT level || '/' || k || '/' || variable AS variable, o, p FROM lv), "
        f"ga AS (WITH {bare('gmfr_ac')}), kt AS (WITH {bare('ks_statistics')}), st AS (SELECT * FROM ga JOIN kt USING (variable)) {out}"
    )


ORACLE_SQL["multiscale_accuracy"] = _multiscale_sql()
