"""Removal of every byte covered by a 400-byte string that also starts elsewhere.

Windows are judged on all documents at once, exactly, without moving whole texts to one place:

1. Anchors are places whose 16-byte hash is no greater than that of the next ``REACH`` places
   (or places that have no such place among the next ``FAR``). Whether a place is an anchor
   depends on the 400 bytes from it alone, so equal windows hold their first anchor at the
   same offset. The windows of an anchor are taken ``STEP`` at a time; such a row has a *core*
   that all its windows hold, and a *snippet*, what they hold together.
2. Only keys (hashes of cores) that occur twice can have repeated windows. They are counted
   with partial aggregates; a bitmap of fixed size keeps the other rows from being shuffled
   (a false bit costs a row, nothing else).
3. Rows with equal snippets are merged and counted: all windows of a snippet that occurs
   twice are repeated, and copies need no further work.
4. Different snippets with the same core go together. The texts from their cores' starts are
   cut into blocks, the blocks ranked, and a suffix array of the resulting string is built by
   linear grouping (``suffix_grouping``). Neighbors and their common prefixes say which snippets
   agree how far to the right; with equal bytes to the left of the core that decides each
   window.
5. A core with more than ``MOST`` different snippets (a passage a little shorter than the
   window in very many documents) is not gathered; its windows are counted by hash instead, an
   exact way whose rows spread.

Nulls and ties: a null text has no bytes; texts below 400 bytes stay whole. Rows with equal id
and text are documents of their own when windows are counted, and get equal results. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_staged, partitions, possible, read, staged, text_or_empty
from .suffix_grouping import suffix_array

WINDOW = 400
REACH, FAR, STEP = 120, 256, 64
CORE = WINDOW - STEP
GRAM = 16
#: Bits of the map of repeated keys (8 MB on every executor).
BITS = 1 << 26
#: Different snippets of a core that one task compares.
MOST = 2000
#: Bytes of a block that is one symbol of the string whose suffix array is built.
SYMBOL = 40
#: Snippets in a suffix array, about; whole cores only.
BATCH = 12_000


def anchors(data: np.ndarray) -> np.ndarray:
    """Places of the anchors that windows can begin with, ascending."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        x = data.astype(np.uint64)
        for step in (1, 2, 4):
            x = x[:-step] | (x[step:] << np.uint64(8 * step))
        x = (x[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ ((x[8:] ^ (x[8:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
        x = ((x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(32)).astype(np.uint32)
    least, width = x, 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])  # over REACH places
    found = np.flatnonzero(x[: len(least) - 1] <= least[1:])
    # where the next one is more than FAR away, every place stands for itself
    edges = np.concatenate([[-1], found, [n - WINDOW + FAR + 1]])
    far = np.flatnonzero(np.diff(edges) > FAR + 1)
    if len(far):
        extra = [np.arange(edges[k] + 1, edges[k + 1] - FAR) for k in far]
        found = np.unique(np.concatenate([found, *extra]))
    return found.astype(np.int64)


def places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a text: start of the core, and least and greatest number of bytes before it at
    which one of its windows starts."""
    found, n = anchors(data), len(data)
    reach = np.minimum(np.diff(found, prepend=-1) - 1, FAR)
    times = reach // STEP + 1
    back = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    back *= STEP
    start = np.repeat(found, times) - back
    most = np.minimum(np.repeat(reach, times) - back, STEP - 1)
    least = np.maximum(0, start + WINDOW - n)
    keep = least <= most
    return start[keep], least[keep], most[keep]


_RATIO = 0x9E3779B97F4A7C15
_STRETCH = 1 << 17


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64."""
    n = _STRETCH + CORE
    out = []
    for base in (_RATIO, pow(_RATIO, -1, 1 << 64)):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def core_keys(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``CORE`` bytes from each start: sums of mixed 8-byte grams times
    powers, from running sums. They choose candidates only; digests decide."""
    out = np.empty(len(start), dtype=np.uint64)
    up, down = _powers()
    many = len(data) > _STRETCH
    for lo in range(0, len(data), _STRETCH):
        own = np.flatnonzero((start >= lo) & (start < lo + _STRETCH)) if many else slice(None)
        at = start[own] - lo
        if not len(at):
            continue
        with np.errstate(over="ignore"):
            x = data[lo : lo + _STRETCH + CORE].astype(np.uint64)
            for step in (1, 2, 4):
                x = x[:-step] | (x[step:] << np.uint64(8 * step))
            x *= np.uint64(0xC2B2AE3D27D4EB4F)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            x *= up[: len(x)]
            sums = np.cumsum(x)
            h = (sums[at + CORE - 8] - np.where(at > 0, sums[at - 1], np.uint64(0))) * down[at]
            h ^= h >> np.uint64(31)
            out[own] = h * np.uint64(0xFF51AFD7ED558CCD)
    return out


def _valid(least: int, most: int) -> int:
    return ((1 << (most + 1)) - 1) & ~((1 << least) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def repeated(lefts: list[bytes], rights: list[bytes], least: np.ndarray, most: np.ndarray, core: np.ndarray) -> list[int]:
    """For each snippet the windows (bit e: starting e bytes before the core) that another
    snippet with the same core holds too."""
    m = len(rights)
    blocks = [[r[k : k + SYMBOL] for k in range(0, len(r), SYMBOL)] for r in rights]
    rank = {b: k + 1 for k, b in enumerate(sorted({b for own in blocks for b in own}))}
    symbols: list[int] = []
    begin = {}
    for k, own in enumerate(blocks):
        begin[len(symbols)] = k
        symbols += [rank[b] for b in own]
        symbols.append(0)
    order = np.array([begin[i] for i in suffix_array(symbols).tolist() if i in begin], dtype=np.int64)
    matrix = np.zeros((m, WINDOW), dtype=np.uint8)
    size = np.array([len(r) for r in rights])
    for k, r in enumerate(rights):
        matrix[k, : len(r)] = np.frombuffer(r, np.uint8)
    same = matrix[order[1:]] == matrix[order[:-1]]
    common = np.where(same.all(axis=1), WINDOW, np.argmin(same, axis=1)) if m > 1 else np.zeros(0, dtype=int)
    common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
    common[core[order[1:]] != core[order[:-1]]] = 0
    before = np.zeros((m, STEP), dtype=np.uint64)
    for k, x in enumerate(lefts):
        before[k, : len(x)] = np.frombuffer(x, np.uint8)[::-1]
    out = [0] * m
    code = np.zeros(m, dtype=np.uint64)
    group = np.empty(m, dtype=np.uint64)
    for e in range(STEP):
        with np.errstate(over="ignore"):
            if e:
                code = (code + before[:, e - 1] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(32)
            group[order] = np.append(0, np.cumsum(common < WINDOW - e)).astype(np.uint64)
            able = np.flatnonzero((least <= e) & (e <= most))
            if len(able) < 2:
                continue
            key = code[able] ^ (group[able] * np.uint64(0xC2B2AE3D27D4EB4F))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        for k in able[count[back] > 1].tolist():
            out[k] |= 1 << e
    return out


def _batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, tk and ``found`` (start, mask of windows) of every document with repeated
    windows; ``docs`` has doc_id, tk (hash of the text), text."""
    import xxhash

    spark = docs.sparkSession
    own_hash = xxhash.xxh3_64_intdigest

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) >= WINDOW:
                    data = np.frombuffer(raw, np.uint8)
                    held.append(core_keys(data, places(data)[0]))
                    n += len(held[-1])
                if n > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["key"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["key"])

    twice = docs.select("text").mapInArrow(keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bit = F.pmod(F.col("key"), F.lit(BITS))
    maps = twice.select((bit / 32768).cast("int").alias("part"), (bit % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for part, own in zip(maps["part"].to_pylist(), maps["bits"].to_pylist()):
        bits[part * 4096 : (part + 1) * 4096] = np.frombuffer(own, np.uint8)
    shared = spark.sparkContext.broadcast(bits)  # BITS / 8 bytes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        names = ["doc_id", "tk", "key", "digest", "start", "least", "most"]
        owners: list[tuple[int | None, int, int]] = []
        parts: list[tuple[np.ndarray, ...]] = []

        def done() -> pa.RecordBatch:
            own = [pa.array([x[k] for x in owners for _ in range(x[2])], pa.int64()) for k in (0, 1)]
            rest = [pa.array(np.concatenate([x[k] for x in parts]).view(np.int64)) for k in range(5)]
            owners.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([*own, *rest], names=names)

        n = 0
        for batch in batches:
            for own, tk, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < WINDOW:
                    continue
                data = np.frombuffer(raw, np.uint8)
                start, least, most = places(data)
                key = core_keys(data, start)
                at = (key & np.uint64(BITS - 1)).astype(np.int64)
                hit = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if not len(hit):
                    continue
                start, least, most = start[hit], least[hit], most[hit]
                digest = np.array([own_hash(raw[s - b : s + WINDOW - a], seed=a * 64 + b) for s, a, b in zip(start.tolist(), least.tolist(), most.tolist())], dtype=np.uint64)
                owners.append((own, tk, len(hit)))
                parts.append((key[hit], digest, start, least, most))
                n += len(hit)
                if n > 50_000:
                    yield done()
                    n = 0
        if n:
            yield done()

    cand = staged(docs.select("doc_id", "tk", "text").mapInArrow(rows, "doc_id long, tk long, key long, digest long, start long, least long, most long"), "rows")
    shared.destroy()
    kinds = cand.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tk", "start", "least", "most")).alias("of"))
    kinds = staged(kinds, "kinds")
    cores = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    folders: list[str] = []
    different = staged(kinds.join(cores, "key").select("key", "digest", "d", "of.*"), "different", folders)
    at = different.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("key", "digest", "d", "start", "least", "most")).alias("spots"))
    at = at.select(F.col("doc_id").alias("of_id"), F.col("tk").alias("of_tk"), "spots")
    where = possible(docs, different, ["doc_id", "tk"]).join(at, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("tk") == F.col("of_tk"))).select("text", "spots")

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["key", "digest", "d", "least", "most", "before", "after"], [pa.int64()] * 5 + [pa.binary()] * 2
        found: list[tuple] = []
        for batch in batches:
            for r in range(batch.num_rows):
                raw = batch.column(0)[r].as_py().encode("utf-8", "surrogatepass")
                found += [(x["key"], x["digest"], x["d"], x["least"], x["most"], raw[x["start"] - x["most"] : x["start"]], raw[x["start"] : x["start"] + WINDOW - x["least"]]) for x in batch.column(1)[r].as_py()]
                if len(found) > 10_000:
                    yield _batches(found, names, types)
                    found = []
        yield _batches(found, names, types)

    cut = where.mapInArrow(snippets, "key long, digest long, d long, least long, most long, before binary, after binary")
    cut = staged(cut, "snippets")
    drop_staged(spark, folders)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            masks = repeated([x[4] for x in held], [x[5] for x in held], np.array([x[2] for x in held]), np.array([x[3] for x in held]), np.array([x[0] for x in held]))
            return _batches([(x[0], x[1], _signed(k)) for x, k in zip(held, masks) if k], ["key", "digest", "mask"], [pa.int64()] * 3)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:2] == held[-1][:2]:
                    continue  # its text is there twice
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    columns = ["key", "digest", "least", "most", "before", "after"]
    few = cut.where(F.col("d") <= MOST).select(columns).repartition(partitions(spark), "key").sortWithinPartitions("key", "digest")
    by_array = few.mapInArrow(judge, "key long, digest long, mask long")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, least, most, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                text = before + after
                yield _batches([(key, digest, e, _signed(own_hash(text[most - e : most - e + WINDOW]))) for e in range(least, most + 1)], ["key", "digest", "e", "window"], [pa.int64(), pa.int64(), pa.int32(), pa.int64()])

    many = cut.where(F.col("d") > MOST).select(columns).dropDuplicates(["key", "digest"]).mapInArrow(windows, "key long, digest long, e int, window long")
    again = many.groupBy("key", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "window")
    by_hash = many.join(again, ["key", "window"]).groupBy("key", "digest").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("e"))).alias("mask"))
    valid = F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("of.least").cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(63) - F.col("of.most")).cast("int")))
    equal = kinds.where("n > 1").select("key", "digest", valid.alias("mask"))
    masks = equal.unionByName(by_array).unionByName(by_hash).groupBy("key", "digest").agg(F.bit_or("mask").alias("mask"))
    masks = staged(masks, "masks")  # both sides are tables: the rows of a hot snippet can be split among tasks
    return cand.join(masks, ["key", "digest"]).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "mask")).alias("found"))


def covered(n: int, start: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Whether each of n bytes is in a repeated window; bit e of a mask: one starts e bytes
    before ``start``."""
    bits = np.unpackbits(np.ascontiguousarray(mask, dtype="<i8").view(np.uint8), bitorder="little").reshape(-1, STEP)
    row, e = np.nonzero(bits)
    windows = np.zeros(n + 1, dtype=bool)
    windows[start[row] - e] = True
    change = windows.astype(np.int32)
    change[WINDOW:] -= windows[:-WINDOW]
    return np.cumsum(change[:-1]) > 0


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("tk", F.xxhash64("text"))
    found = repeats(own.select("doc_id", "tk", "text")).select(F.col("doc_id").alias("of_id"), F.col("tk").alias("of_tk"), "found")
    both = own.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("tk") == F.col("of_tk")), "left").select("doc_id", "text", "found")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spots = batch.column(2)
            n = pc.fill_null(pc.list_value_length(spots), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            start, mask = (x.to_numpy(zero_copy_only=False) for x in spots.flatten().flatten())
            for own, text, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1), (ends - n).tolist(), ends.tolist()):
                raw = text.as_buffer().to_pybytes()
                if lo == hi:
                    out.append((own, len(raw), 0, 0, raw))
                    continue
                gone = covered(len(raw), start[lo:hi], mask[lo:hi])
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((own, len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            yield _batches(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64()] * 4 + [pa.binary()])

    return both.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
