"""Classes, error matrices, kappa, outlier severity and variety."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mossgrid.functions.stats import kappa_2x2

# Breaks of stem size and cover, the fuzzy sets of eleven classes, the severity
# of class pairs (all others green), and the coarse age groups.
SIZE_BREAKS = [2.5, 25.0, 37.5, 50.0, 75.0]
COVER_BREAKS = [10.0, 40.0, 70.0]
FUZZY = {1: [1, 2], 2: [1, 2, 3, 5, 8], 3: [2, 3, 4, 5], 4: [3, 4, 6, 7], 5: [2, 3, 5, 6, 8], 6: [4, 5, 6, 7, 9], 7: [4, 6, 7, 10, 11], 8: [2, 5, 8, 9], 9: [6, 8, 9, 10], 10: [7, 9, 10, 11], 11: [7, 10, 11]}
SEVERITY = {
    "red": {1: [10, 11], 2: [11], 5: [11], 8: [11], 10: [1], 11: [1, 2, 5, 8]},
    "orange": {1: [4, 6, 7, 8, 9], 2: [10], 3: [10, 11], 4: [1], 5: [10], 6: [1, 11], 7: [1], 8: [1], 9: [1], 10: [2, 3, 5], 11: [3, 6]},
    "yellow": {1: [3, 5], 2: [4, 6, 7, 9], 3: [1, 6, 7, 8, 9], 4: [2, 5, 9, 10, 11], 5: [1, 4, 7, 9], 6: [2, 3, 8, 10], 7: [2, 3, 5, 8, 9], 8: [3, 4, 6, 7, 10], 9: [2, 3, 4, 5, 7, 11], 10: [4, 6, 8], 11: [4, 9]},
}
YOUNG, MEDIUM, OLD = [1, 2, 3, 5, 8], [4, 6, 9], [7, 10, 11]


def _step(value: Column, breaks: Sequence[float]) -> Column:
    out = F.when(value < breaks[0], F.lit(1))
    for k, b in enumerate(breaks[1:], 2):
        out = out.when(value < b, F.lit(k))
    return out.when(value.isNotNull(), F.lit(len(breaks) + 1))


def vegclass(size: Column, hardwood: Column, cover: Column) -> Column:
    """Class 1 to 11 from mean size, hardwood share and canopy cover; null inputs give null."""
    s, c = _step(size, SIZE_BREAKS), _step(cover, COVER_BREAKS)
    broad = F.when(s <= 2, F.lit(3)).otherwise(F.lit(4))
    mixed = F.when(s <= 2, F.lit(5)).when(s <= 4, F.lit(6)).otherwise(F.lit(7))
    conifer = F.when(s <= 2, F.lit(8)).when(s <= 4, F.lit(9)).when(s == 5, F.lit(10)).otherwise(F.lit(11))
    own = F.when(c <= 2, c).when(hardwood >= 0.65, broad).when(hardwood >= 0.2, mixed).otherwise(conifer)
    return F.when(s.isNotNull() & c.isNotNull() & hardwood.isNotNull(), own)


def coarse(value: Column) -> Column:
    return F.when(value.isin(YOUNG), F.lit("young")).when(value.isin(MEDIUM), F.lit("medium")).when(value.isin(OLD), F.lit("old"))


def fuzzy_table(spark: SparkSession, sets: dict[int, list[int]] | None = None) -> DataFrame:
    rows = [(c, f) for c, own in (sets or FUZZY).items() for f in own]
    return spark.createDataFrame(rows, "class int, fuzzy int")


def severity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, p, s) for s, own in SEVERITY.items() for o, ps in own.items() for p in ps], "observed int, predicted int, severity string")


def severity(pairs: DataFrame, o: str = "observed", p: str = "predicted") -> DataFrame:
    """Adds ``severity``: red, orange, yellow or green."""
    table = severity_table(pairs.sparkSession).select(F.col("observed").alias("_o"), F.col("predicted").alias("_p"), "severity")
    return pairs.join(F.broadcast(table), (F.col(o) == F.col("_o")) & (F.col(p) == F.col("_p")), "left").drop("_o", "_p").withColumn("severity", F.coalesce("severity", F.lit("green")))


def error_matrix(pairs: DataFrame, classes: DataFrame | None = None, o: str = "observed", p: str = "predicted") -> DataFrame:
    """observed, predicted, n for all pairs of classes; classes default to those of either
    side. Null classes take no part."""
    own = pairs.select(F.col(o).alias("observed"), F.col(p).alias("predicted"))
    counts = own.groupBy("observed", "predicted").agg(F.count(F.lit(1)).alias("n"))
    # null classes leave by a condition on counts, as one on classes alone would be moved below
    # the aggregate and evaluated, with all that classes are made from, once more
    counts = counts.where(F.when(F.col("observed").isNotNull() & F.col("predicted").isNotNull(), F.col("n")).otherwise(0) > 0)
    # the grid of classes is as wide as the result itself; counts fill it by a second aggregate
    # over cells, so that nothing above them is read again
    if classes is None:
        one = counts.groupBy().agg(F.array_union(F.collect_set("observed"), F.collect_set("predicted")).alias("classes"), F.collect_list(F.struct("observed", "predicted", "n")).alias("cells"))  # a row of all cells
        empty = F.flatten(F.transform("classes", lambda o: F.transform("classes", lambda p: F.struct(o.alias("observed"), p.alias("predicted"), F.lit(0).cast("long").alias("n")))))
        filled = one.select(F.inline(F.concat("cells", empty)))
    else:
        grid = classes.select(F.col("class").alias("observed")).crossJoin(classes.select(F.col("class").alias("predicted")))
        return grid.join(counts, ["observed", "predicted"], "left").select("observed", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.groupBy("observed", "predicted").agg(F.sum("n").alias("n"))


def totals(matrix: DataFrame, fuzzy: DataFrame | None = None) -> DataFrame:
    """Row, column and overall totals with exact and fuzzy agreement; null: all classes."""
    own = _with_fuzzy(matrix, fuzzy)
    out = own.cube("observed", "predicted").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("observed") == F.col("predicted"), F.col("n")).otherwise(0)).alias("exact"), F.sum(F.when(F.col("is_fuzzy"), F.col("n")).otherwise(0)).alias("fuzzy"))
    return out.where("observed is null or predicted is null").withColumns({"percent_correct": F.try_divide(F.col("exact") * 100.0, F.col("n")), "percent_fuzzy": F.try_divide(F.col("fuzzy") * 100.0, F.col("n"))})


def _with_fuzzy(matrix: DataFrame, fuzzy: DataFrame | None) -> DataFrame:
    if fuzzy is None:
        return matrix.withColumn("is_fuzzy", F.col("observed") == F.col("predicted"))
    table = fuzzy.select(F.col("class").alias("_c"), F.col("fuzzy").alias("_f"))
    own = matrix.join(F.broadcast(table), (F.col("observed") == F.col("_c")) & (F.col("predicted") == F.col("_f")), "left")
    return own.withColumn("is_fuzzy", F.col("_f").isNotNull() | (F.col("observed") == F.col("predicted"))).drop("_c", "_f")


def kappa(matrix: DataFrame) -> DataFrame:
    """Kappa of a whole matrix: one row."""
    rows = matrix.groupBy(F.col("observed").alias("class")).agg(F.sum("n").alias("r"))
    columns = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("c"))
    chance = rows.join(columns, "class").agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("rc"))
    whole = matrix.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("observed") == F.col("predicted"), F.col("n")).otherwise(0)).cast("double").alias("d"))
    both = whole.crossJoin(chance)  # one row each
    expected = F.try_divide(F.col("rc"), F.col("n"))
    return both.select(F.when(F.col("n") == expected, F.lit(0.0)).otherwise(F.try_divide(F.col("d") - expected, F.col("n") - expected)).alias("kappa"))


def kappa_by_class(matrix: DataFrame, fuzzy: DataFrame | None = None) -> DataFrame:
    """class, kappa of the matrix collapsed to that class and the rest; with fuzzy sets a
    fuzzy-equal pair of the class counts as agreement. One aggregate: each cell counts for
    its observed and its predicted class, and for the whole (class null)."""
    own = _with_fuzzy(matrix, fuzzy)
    n, none = F.col("n"), F.lit(0).cast(matrix.schema["n"].dataType)
    part = lambda c, a, b, d, t: F.struct(c.alias("class"), a.alias("a"), b.alias("b"), d.alias("c"), t.alias("t"))
    o, p = F.col("observed"), F.col("predicted")
    hits = F.transform(F.array_distinct(F.array(o, p)), lambda c: part(c, n, none, none, none))
    misses = F.array(part(o, none, n, none, none), part(p, none, none, n, none))
    whole = part(F.lit(None).cast(matrix.schema["observed"].dataType), none, none, none, n)
    each = own.select(F.inline(F.concat(F.when(F.col("is_fuzzy"), hits).otherwise(misses), F.array(whole))))
    sums = each.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("a", "b", "c", "t")])
    total = F.max(F.when(F.col("class").isNull(), F.col("t"))).over(Window.partitionBy())  # a row for each class
    each = sums.withColumn("t", total).where("class IS NOT NULL")
    rest = F.col("t") - F.col("a") - F.col("b") - F.col("c")
    return each.select("class", kappa_2x2(F.col("a"), F.col("b"), F.col("c"), rest).alias("kappa"))


def fuzzy_kappa(matrix: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Kappa of the whole matrix after fuzzy-equal counts moved to the diagonal."""
    own = _with_fuzzy(matrix, fuzzy).select("observed", F.when(F.col("is_fuzzy"), F.col("observed")).otherwise(F.col("predicted")).alias("predicted"), "n")
    return kappa(own.groupBy("observed", "predicted").agg(F.sum("n").alias("n")))


def variety(neighbors: DataFrame, classes: DataFrame, young: int = 2, old: int = 2) -> DataFrame:
    """Ids whose pixels' first neighbors are at least so many young and so many old ones;
    ``classes``: id, class."""
    near = neighbors.where("rank = 1").join(classes.select(F.col("id").alias("neighbor_id"), coarse(F.col("class")).alias("age")), "neighbor_id")
    return near.groupBy("id").agg(F.count_if(F.col("age") == "young").alias("n_young"), F.count_if(F.col("age") == "old").alias("n_old")).where((F.col("n_young") >= young) & (F.col("n_old") >= old))


def adjusted_area(matrix: DataFrame, areas: DataFrame) -> DataFrame:
    """class, mapped, adjusted, ci: area of each observed class estimated from the mapped area
    of predicted classes (``areas``: class, area) and the error matrix, with twice the
    standard error."""
    rows = matrix.groupBy("predicted").agg(F.sum("n").alias("row_n"))
    total = areas.agg(F.sum("area").alias("total"))
    share = areas.crossJoin(total).select(F.col("class").alias("predicted"), F.try_divide("area", "total").alias("w"), "total")
    cells = matrix.join(rows, "predicted").join(share, "predicted")
    cells = cells.withColumn("p", F.coalesce(F.try_divide("n", "row_n"), F.lit(0.0)))
    spread = F.col("w") * F.col("w") * F.col("p") * (F.lit(1.0) - F.col("p")) / (F.greatest("row_n", F.lit(2)) - 1)
    out = cells.groupBy(F.col("observed").alias("class")).agg((F.sum(F.col("w") * F.col("p")) * F.first("total")).alias("adjusted"), (F.lit(2.0) * F.sqrt(F.sum(spread)) * F.first("total")).alias("ci"))
    return areas.select("class", F.col("area").alias("mapped")).join(out, "class")


def sentinel_areas(plots: DataFrame, id_col: str, area: str, nonforest: int = -10001, unsampled: int = -10002) -> tuple[DataFrame, DataFrame]:
    """One row (nonforest, unsampled area) from reserved ids, and the plots of positive ids."""
    special = plots.agg(F.coalesce(F.max(F.when(F.col(id_col) == nonforest, F.col(area))), F.lit(0.0)).alias("nonforest"), F.coalesce(F.max(F.when(F.col(id_col) == unsampled, F.col(area))), F.lit(0.0)).alias("unsampled"))
    return special, plots.where(F.col(id_col) > 0)
