"""Folders, staging and small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words; everything else belongs to a word.
SPACES = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` that driver and executors both reach.

    Where the setting is absent on one machine (tests), a temporary folder becomes the
    checkpoint folder of the session; on a cluster such a folder would be of no use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="mossgrid-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/mossgrid-{name}-{uuid.uuid4().hex}"


class _Folders(threading.local):
    """Folders of staged tables that are still there, in the order in which they were written:
    a thread's own, so that queries in several threads cannot delete each other's."""

    def __init__(self) -> None:
        self.own: list[str] = []


_folders = _Folders()


def staged(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; this cuts lineage
    in a way that survives the loss of executors. The folder is added to ``held`` too, the
    list of a caller who deletes what it has staged."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    _folders.own.append(path)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_folders() -> list[str]:
    return list(_folders.own)


def drop_staged(spark: SparkSession, held: list[str]) -> None:
    """Delete folders of tables that this thread has staged, through the file system that owns
    them, and take them off the list ``held``. What reads them must be done by then."""
    jvm = spark.sparkContext._jvm
    for path in [x for x in held if x in _folders.own]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _folders.own.remove(path)
    held.clear()


_held: dict[Any, Any] = {}


def of_worker(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker remembers between tasks. One thing at a time: workers outlive
    stages, and what another operator has left there would take up memory for nothing."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bits of the map that rows are tested against (8 MB, in rows of 4 KB).
MAP_BITS, MAP_ROW = 1 << 26, 1 << 15


def _tested(rows: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, Column]:
    """``rows`` with a row of the bitmap of ``wanted``'s keys, and whether the bit is set."""
    at = lambda: F.pmod(F.xxhash64(*key), F.lit(MAP_BITS))
    part = lambda: F.floor(at() / MAP_ROW).cast("int")
    maps = wanted.select(part().alias("map_part"), F.pmod(at(), F.lit(MAP_ROW)).alias("map_bit")).groupBy("map_part").agg(F.bitmap_construct_agg("map_bit").alias("map_bits"))
    place = F.pmod(at(), F.lit(MAP_ROW)).cast("int")
    byte = F.conv(F.hex(F.substr("map_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, F.pmod(place, F.lit(8))).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(maps), part() == F.col("map_part"), "left"), F.coalesce(found, F.lit(False))


def possible(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``key`` columns are not among ``wanted``'s; never
    without one whose are.

    A bitmap of hashes, of a fixed size and so fit to be broadcast, goes before a join that
    shuffles, so that what is shuffled grows with what is wanted. Where very many keys are
    wanted the map fills and filters little; the join is as right without it.
    """
    both, found = _tested(rows, wanted, key)
    return both.where(found).select(rows.columns)


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` whose ``key`` columns (null equals null) are not among ``gone``'s. Only rows
    that the bitmap finds are shuffled to decide."""
    both, found = _tested(rows, gone, key)
    names = gone.select([F.col(c).alias(f"gone {c}") for c in key]).distinct()
    equal = [F.col(c).eqNullSafe(F.col(f"gone {c}")) for c in key]
    doubtful = possible(rows, gone, key).join(names, equal, "left_anti")
    return both.where(~found).select(rows.columns).unionByName(doubtful)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text, in order; no text or only white space gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
