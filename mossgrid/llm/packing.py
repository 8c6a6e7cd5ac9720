"""Packing of token sequences: first-fit decreasing in randomised groups of documents.

A document's ids are cut every ``size`` ids. Full pieces are sequences of their own; the
rest of each document goes to a group drawn by a seeded hash, and each group is packed by
itself: pieces in descending order of length, each into the first open bin that holds it.
The bins' free room is kept in a tournament tree (each node holds the most room below it),
so a piece costs the logarithm of the number of bins.

A group has about ``GROUP`` documents whatever the size of the corpus, so groups are bounded
and their number grows with the input; only lengths and checksums are shuffled.

Nulls and ties: a null text is empty (its end id alone). Rows with the same doc_id are
documents of their own, and are drawn into groups one by one. Pieces of equal length are
ordered by document id, then by the row's number. An empty table gives no rows. Columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import read, staged, text_or_empty

SIZE = 4096
#: Documents in a group, about.
GROUP = 2048
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row_key long"


class RoomTree:
    """Tournament tree over bins: finds the first bin with enough room."""

    def __init__(self, n_bins: int, size: int):
        self.leaves = 1 << max(0, (n_bins - 1).bit_length())
        self.room = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """Put a piece into the first bin that has room for it; gives the bin."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < length:
                k += 1
        found = k - self.leaves
        room[k] -= length
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        return found


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """For lengths in descending order: the bin of each and its offset there."""
    tree, filled, out = RoomTree(max(1, len(lengths)), size), {}, []
    for n in lengths:
        b = tree.place(n)
        at = filled.get(b, 0)
        filled[b] = at + n
        out.append((b, at))
    return out


def pieces(docs: DataFrame, tokenizer: str, end: int = 2, kind: str = "word", size: int = SIZE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut the ids of every whole text into pieces of ``size``; only the last is shorter."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = bpe.encoder(tokenizer, kind).encode
        number = count(TaskContext.get().partitionId() << 40)  # a row's own, also among equal rows
        for batch in batches:
            rows = []
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)  # of a batch's texts no more are held twice
                for own, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist(), end)):
                    n, key = len(ids) // 4, next(number)
                    for at in range(0, n, size):
                        part = ids[4 * at : 4 * (at + size)]
                        rows.append((own, at, len(part) // 4, zlib.crc32(part), n, key))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return rows.mapInArrow(cut, _PIECES)


def pack(cut: DataFrame, n_docs: int, size: int = SIZE, group: int = GROUP, seed: int = 17) -> DataFrame:
    """Give each piece its sequence and its offset there."""
    n_groups = max(1, -(-n_docs // group))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = cut.where(F.col("length") == size)
    # a full piece is a sequence; its number comes from the rows' numbering, below all group numbers
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(columns)
    rest = cut.where(F.col("length") < size).withColumn("grp", F.pmod(F.xxhash64(F.col("doc_id"), F.col("row_key"), F.lit(seed)), F.lit(n_groups)))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "row_key", "start"], ascending=[False, True, True, True], kind="stable")
        where = np.array(first_fit_decreasing(rows["length"].tolist(), size), dtype=np.int64).reshape(-1, 2)
        return rows.assign(sequence_id=(rows["grp"].to_numpy() << 32) + where[:, 0], offset=where[:, 1])[columns]

    out = rest.groupBy("grp").applyInPandas(packed, ", ".join(f"{c} long" for c in columns))
    return full.unionByName(out)


def packed(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Encode, cut and pack ``docs``. The pieces are written once, so their numbering and
    their number are fixed before packing."""
    cut = staged(pieces(docs, tokenizer, **options), "pieces")
    return pack(cut, cut.where("start = 0").count(), options.get("size", SIZE))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
