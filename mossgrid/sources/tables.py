"""Tables in and out: ids, paired inputs, CSV conventions, crosswalks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet, or CSV with a given schema; only the columns asked for are read."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def ids(df: DataFrame, id_col: str) -> DataFrame:
    """Ids that are not reserved (negative ones are)."""
    return df.select(id_col).where(F.col(id_col) >= 0)


def common_ids(observed: DataFrame, predicted: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Both tables, with the ids that both have."""
    return observed.join(predicted.select(id_col), id_col, "left_semi"), predicted.join(observed.select(id_col), id_col, "left_semi")


def subset(df: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    return df.join(wanted.select(id_col), id_col, "left_semi")


def positioned(wanted: DataFrame, id_col: str, place: str = "place") -> DataFrame:
    """A list of ids with the place of each: in the order in which its one file is read."""
    return wanted.select(F.col(id_col), F.monotonically_increasing_id().alias(place))


def requested(df: DataFrame, wanted: DataFrame, id_col: str, place: str = "place") -> DataFrame:
    """Rows of the ids of a list (``id_col`` and ``place``), as often as the list has them and
    with their place in it, by which the sink sorts; an id without rows has none."""
    return wanted.select(id_col, place).join(df, id_col)


def forest_majority(plots: DataFrame, id_col: str, count: str = "PNT_COUNT", least: float = 2.0, wanted: DataFrame | None = None) -> DataFrame:
    out = plots.where(F.col(count) >= least)
    return out if wanted is None else subset(out, wanted, id_col)


def location_crosswalk(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col("LOC_ID").alias("loc_id"))


def year_crosswalk(df: DataFrame, id_col: str, model_type: str, model_year: int) -> DataFrame:
    """id, year: the plot's image year for models with imagery per plot, else the model's."""
    year = F.col("IMAGE_YEAR").cast("int") if model_type == "sppsz" else F.lit(model_year)
    return df.select(F.col(id_col).cast("long").alias("id"), year.alias("year"))


def csv_ready(df: DataFrame, decimals: int | Mapping[str, int] = 4) -> DataFrame:
    """The file convention: nulls and NaN are 0, booleans 0 or 1, strings trimmed, doubles in
    fixed decimals. The table itself is left as it is."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.coalesce(c.cast("int"), F.lit(0))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            n = decimals if isinstance(decimals, int) else decimals.get(f.name, 4)
            c = F.format_string(f"%.{n}f", F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)))
        elif isinstance(f.dataType, T.StringType):
            c = F.trim(c)
        else:
            c = F.coalesce(c, F.lit(0))
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, decimals: int | Mapping[str, int] = 4, order: Sequence[str] = ()) -> None:
    out = csv_ready(df.orderBy(*order) if order else df, decimals)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_zonal(records: DataFrame, path: str, id_col: str = "FCID") -> None:
    out = records.select(F.col("id").alias(id_col), F.col("pixel_number").alias("PIXEL_NUMBER"), F.col("neighbor").alias("NEIGHBOR"), F.col("neighbor_id").alias("NEIGHBOR_ID"), F.col("distance").alias("DISTANCE"))
    write_csv(out, path, 8)


def write_bins(bins: DataFrame, path: str) -> None:
    """VARIABLE, CLASS, LOW, HIGH of bins (variable, class, low, high)."""
    write_csv(bins.select(F.col("variable").alias("VARIABLE"), F.col("class").alias("CLASS"), F.col("low").alias("LOW"), F.col("high").alias("HIGH")), path, 8, ["VARIABLE", "CLASS"])


def read_bins(spark: SparkSession, path: str) -> dict[str, list[float]]:
    """Edges by variable, from a CSV file with columns VARIABLE, LOW and HIGH (others are
    ignored): the lows in order, then the last high."""
    header = spark.read.option("header", True).csv(path).columns
    missing = {"VARIABLE", "LOW", "HIGH"} - set(header)
    if missing:
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in ("LOW", "HIGH") else T.StringType()) for c in header])
    rows = spark.read.schema(schema).option("header", True).csv(path).groupBy("VARIABLE").agg(F.sort_array(F.collect_list("LOW")).alias("low"), F.max("HIGH").alias("high"))
    return {r["VARIABLE"]: [*r["low"], r["high"]] for r in rows.collect()}  # a row per variable


def scalars(spark: SparkSession, path: str) -> DataFrame:
    """ATTR, SCALAR, K of attribute rasters."""
    return read_table(spark, path, "ATTR string, SCALAR double, K int")


def scalar_of(table: DataFrame, attribute: str) -> tuple[float, int]:
    """Scale factor and k of an attribute; 1 and 1 if it is not listed."""
    row = table.where(F.col("ATTR") == attribute).agg(F.coalesce(F.max("SCALAR"), F.lit(1.0)).alias("s"), F.coalesce(F.max("K"), F.lit(1)).alias("k")).first()
    return float(row["s"]), int(row["k"])


def domain_points(spark: SparkSession, points: Sequence[tuple[float, float]] | None = None, path: str | None = None) -> DataFrame:
    """x, y of a list of points: given ones, or those of a CSV file with columns X and Y."""
    if (points is None) == (path is None):
        raise ValueError("either points or a path is needed")
    if points is not None:
        return spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    header = spark.read.option("header", True).csv(path).columns
    missing = {"X", "Y"} - set(header)
    if missing:
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in ("X", "Y") else T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).csv(path).select(F.col("X").alias("x"), F.col("Y").alias("y"))
