"""Running counts of values in order, without a task that sorts a whole group.

Values are counted first, so a value that is very common is one row. The distinct values of
each group are then cut into parts of equal numbers at splitters, approximate percentiles
that every task's sketch is merged into: the parts are as even on skewed values as on any.
Counts of parts are summed up along a group, values inside their part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group are COARSE * COARSE.
COARSE = 8
#: A value is common where it has more than one row in COMMON of the whole table; its rows are
#: dealt to SALTS tasks.
COMMON, SALTS = 1024, 32


def parted(values: DataFrame, by: Sequence[str], value: str, name: str = "_part") -> DataFrame:
    """Adds the part, from 0, of each row's value within ``by``. ``values`` has distinct values."""
    n = COARSE * COARSE
    shares = [k / n for k in range(1, n)]
    sketch = F.percentile_approx(F.col(value).cast("double"), F.array(*map(F.lit, shares)), 20 * n).alias("_splits")
    splits = values.groupBy(*by).agg(sketch)
    # a row for each group: small beside its values, so that the join can turn to a broadcast
    # once its size is known; with one group it is one row
    both = values.join(splits, list(by)) if by else values.crossJoin(F.broadcast(splits))
    below = lambda a: F.size(F.filter(a, lambda x: x < F.col(value).cast("double")))
    firsts = F.transform(F.sequence(F.lit(COARSE), F.lit(n - 1), F.lit(COARSE)), lambda k: F.get("_splits", k - 1))
    coarse = below(firsts)
    part = both.withColumn("_coarse", coarse).withColumn(name, F.col("_coarse") * COARSE + below(F.slice("_splits", F.col("_coarse") * COARSE + 1, F.lit(COARSE - 1))))
    return part.drop("_splits", "_coarse")


def running(counts: DataFrame, by: Sequence[str], value: str, n: str = "n", before: str = "before") -> DataFrame:
    """Adds to counts per distinct value the sum of ``n`` of lesser values within ``by``."""
    ranged = parted(counts, by, value)
    sums = ranged.groupBy(*by, "_part").agg(F.sum(n).alias("_t"))
    line = Window.partitionBy(*by).orderBy("_part")  # a row for each part
    ahead = sums.select(*by, "_part", (F.sum("_t").over(line) - F.col("_t")).alias("_ahead"))
    inside = F.sum(n).over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)
    return ranged.withColumn("_inside", inside).join(ahead, [*by, "_part"]).withColumn(before, F.col("_ahead") + F.col("_inside")).drop("_part", "_inside", "_ahead")


def average_ranks(counts: DataFrame, by: Sequence[str], value: str, name: str, n: str = "n") -> DataFrame:
    """``by``, ``value`` and its average rank (equal values share their mean) from counts."""
    return running(counts, by, value, n, "_before").select(*by, value, (F.col("_before") + (F.col(n) + 1) / F.lit(2.0)).alias(name))


def with_common_spread(rows: DataFrame, table: DataFrame, counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """``rows`` joined to ``table`` (one row per ``by`` and ``value``). Rows of common values,
    of which there are ``COMMON`` at most, are dealt out by the hash of the whole row, and
    meet copies of the table's row."""
    total = counts.agg(F.sum(n).alias("_total"))
    common = counts.crossJoin(F.broadcast(total)).where(F.col(n) * COMMON > F.col("_total")).select(*by, value, F.lit(True).alias("_common"))
    spread = F.when(F.col("_common"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int")
    salts: Column = F.when(F.col("_common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    keys = [*by, value]
    left = rows.join(F.broadcast(common), keys, "left").withColumn("_salt", spread).drop("_common")
    right = table.join(F.broadcast(common), keys, "left").withColumn("_salt", F.explode(salts)).drop("_common")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
