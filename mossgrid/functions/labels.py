"""Labels that hold numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(label: Column) -> Column:
    """Sort key by which "b10" comes after "b9": leading text, then the first number."""
    text = F.coalesce(label.cast("string"), F.lit(""))
    number = F.regexp_extract(text, r"(\d+)", 1)
    return F.struct(F.regexp_extract(text, r"^(\D*)", 1).alias("text"), F.when(number == "", F.lit(-1)).otherwise(number.cast("long")).alias("number"), text.alias("rest"))
