"""Token ids of whole texts in a plane-shuffled binary format, and back.

Format (a folder, written and read by Spark alone so that any store will do):

* ``blocks``: one row per block of ``BLOCK`` ids (the last of a shard may be shorter):
  shard, block, n_ids, ``planes`` (the block's little-endian unsigned 32-bit ids transposed
  into 4 byte planes or 32 bit planes, each compressed with zstandard), and the documents
  that have ids in the block: doc_no (their number in the shard), doc_id, length.
* ``index``: one row per block: shard, block, start (ids in all blocks before it), n_ids,
  n_bytes. A reader that wants ids a..b needs only the blocks that the index names.

Shards are ranges of doc_id in ascending order; blocks of a shard are in ascending order too.

Nulls and ties: a null text is an empty one (its end id alone); a null doc_id sorts first;
rows that
share a doc_id are ordered by a hash of their text and stay separate documents. An empty table
gives an empty folder with the same schema. Columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import partitions, read, shared_dir, text_or_empty

BLOCK = 65_536
_BLOCKS = "shard int, block int, n_ids int, planes array<binary>, doc_no array<long>, doc_id array<long>, length array<int>"
_PIECES = "shard int, doc_no long, doc_id long, block int, at int, n int, crc long, whole boolean"


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> list[bytes]:
    """Transpose unsigned 32-bit ids into 4 byte planes or 32 bit planes and compress each."""
    import zstandard

    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    rows = np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little").T, axis=1) if bits else np.ascontiguousarray(as_bytes.T)
    squeeze = zstandard.ZstdCompressor(level=level)
    return [squeeze.compress(x.tobytes()) for x in rows]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids that ``to_planes`` was given; the number of planes tells their kind."""
    import zstandard

    loosen = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(loosen.decompress(x), np.uint8) for x in planes])
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1)[:, :n], axis=0, bitorder="little")
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def _crc_matrix_times(matrix: tuple[int, ...], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


@lru_cache(maxsize=None)
def _zero_bits(power: int) -> tuple[int, ...]:
    """The crc operator, as a bit matrix, for 2 to the power zero bits."""
    if power == 0:
        return (0xEDB88320, *(1 << k for k in range(31)))
    half = _zero_bits(power - 1)
    return tuple(_crc_matrix_times(half, x) for x in half)


def crc32_join(first: int, second: int, n_second: int) -> int:
    """crc32 of two strings in a row from the crc32 of each and the second's bytes."""
    n_bits, power = 8 * n_second, 0
    while n_bits:
        if n_bits & 1:
            first = _crc_matrix_times(_zero_bits(power), first)
        n_bits >>= 1
        power += 1
    return first ^ second


def write_token_planes(docs: DataFrame, path: str, tokenizer: str, end: int = 0, kind: str = "byte", id_col: str = "doc_id", text: str = "text", bits: bool = False, block: int = BLOCK) -> None:
    """Encode every whole text, append ``end``, and write the folder described above."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # equal rows are told apart by a random number, or all of them would be one shard's
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("draw", F.rand(11))
    rows = rows.repartitionByRange(n, "doc_id", "tie", "draw").sortWithinPartitions("doc_id", "tie").drop("tie", "draw")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = bpe.encoder(tokenizer, kind).encode
        shard, number, waiting, kept, doc_no = TaskContext.get().partitionId(), 0, [], 0, 0
        listed: list[tuple[int, int, int]] = []

        def row(ids: np.ndarray) -> pa.RecordBatch:
            cells = [[shard], [number], [len(ids)], [to_planes(ids, bits)], *([[x[k] for x in listed]] for k in range(3))]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in batches:
            columns = batch.to_pydict()
            for k in range(0, len(columns["text"]), 256):
                for own, ids in zip(columns["doc_id"][k : k + 256], encode(columns["text"][k : k + 256], end)):
                    left = np.frombuffer(ids, "<u4")
                    while len(left):
                        part, left = left[: block - kept], left[block - kept :]
                        waiting.append(part)
                        kept += len(part)
                        listed.append((doc_no, own, len(part)))
                        if kept == block:
                            yield row(np.concatenate(waiting))
                            number, waiting, kept, listed = number + 1, [], 0, []
                    doc_no += 1
        if kept:
            yield row(np.concatenate(waiting))

    rows.mapInArrow(blocks, _BLOCKS).write.parquet(f"{path}/blocks")
    own = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").select("shard", "block", "n_ids", F.aggregate("planes", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)).alias("n_bytes"))
    shards = own.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    shards = shards.select("shard", (F.sum("shard_ids").over(Window.orderBy("shard")) - F.col("shard_ids")).alias("base"))
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    own.join(shards, "shard").select("shard", "block", (F.col("base") + before).alias("start"), "n_ids", "n_bytes").write.parquet(f"{path}/index")


def read_token_planes(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, shard."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    index = spark.read.schema("shard int, block int, start long, n_ids long, n_bytes long").parquet(f"{path}/index")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = batch.slice(r, 1).to_pydict()
                ids = from_planes(x["planes"][0], x["n_ids"][0])
                ends = np.cumsum(x["length"][0])
                last = len(ends) - 1
                rows = [(x["shard"][0], no, own, x["block"][0], int(e - n), n, zlib.crc32(ids[e - n : e].tobytes()), 0 < k < last) for k, (no, own, n, e) in enumerate(zip(x["doc_no"][0], x["doc_id"][0], x["length"][0], ends))]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])

    @F.udf("long")
    def joined(parts) -> int:  # a few rows for each block: the documents at its two ends
        crc = 0
        for _, n, own in parts:
            crc = crc32_join(crc, own, 4 * n)
        return crc

    found = blocks.mapInArrow(pieces, _PIECES).join(index.select("shard", "block", "start"), ["shard", "block"])
    found = found.withColumn("start", F.col("start") + F.col("at"))
    inside = found.where("whole").select("doc_id", "start", F.col("n").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "shard")
    cut = found.where("not whole").groupBy("shard", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("parts"))
    whole = F.when(F.size("parts") == 1, F.col("parts")[0]["crc"]).otherwise(joined("parts"))
    return inside.unionByName(cut.select("doc_id", "start", "n_tokens", whole.alias("ids_crc32"), "shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "planes")
    write_token_planes(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_planes(spark, path)
