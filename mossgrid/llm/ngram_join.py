"""Similarity join on word shingles with several global token orders.

A pair with Jaccard ``t`` or more shares a token among the first ``n - ceil(t n) + 1`` of
either set under *every* order of all tokens. Each order here goes by frequency class (that
of a shingle's least frequent word; shingles with a word outside the list of common words come
first) and permutes the shingles of one class by its own multiplier. The first order makes candidate groups (a shuffle by
token); in a group a pair is verified only if its prefixes meet under the other orders too.

Steps: (1) count the documents of each word, keep the ``COMMON`` most frequent (a fixed
bound, for the orders only; a word that is missing there costs time, never a link); (2) sets, prefixes and a 128-bit digest per document; documents with equal sets become
one class; (3) classes that share a prefix token get the smallest class of that token's list
as label; the members of a label first meet with small sketches of their sets, which bound every
intersection from above, and only classes with a partner left there go on, in groups named by the
smallest class that they are tied to; all pairs of a group's members are judged by their sets; (4) a label with more than ``BLOCK``
members is cut into blocks and every pair of blocks is a group of its own, so a hot group is
spread over tasks and no pair is lost; groups emit a spanning forest of their links instead
of all links; (5) components by star contraction, written per round.

Sets are only made again for classes that have a partner left by the sketches.

Nulls and ties: null or blank texts have empty sets, link with nothing and are their own
component; a null doc_id counts as no id (a component of such rows only is null). Rows with
equal sets link, whatever their ids; rows sharing an id count under that id. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import of_worker, partitions, possible, read, staged, text_or_empty, without

SHINGLE = 3
PERCENT = 90
#: Words in most documents, which the orders go by (16 bytes each, sent to every executor).
COMMON = 1 << 20
#: Members of a group that one task compares with each other or with as many others.
BLOCK = 256
_ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = of_worker("word hashes", _WordHashes)
    if len(hashes) > 400_000:
        hashes.clear()
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str, size: int = SHINGLE, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Sorted distinct tokens of a text: 60 bits hash a word shingle, the upper 4 are its
    frequency class, that of its least frequent word (0: not among the common ones)."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    width = min(size, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ h[k : n - width + 1 + k]) * _M1
            out ^= out >> np.uint64(32)
        out *= _M2
        out ^= out >> np.uint64(29)
    out >>= np.uint64(4)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        level = np.where(common[0][at] == h, common[1][at], np.uint64(0))
        least = level[: n - width + 1]
        for k in range(1, width):
            least = np.minimum(least, level[k : n - width + 1 + k])
        out |= least << np.uint64(60)
    return np.unique(out)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def prefix(own: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set under one of the orders: by frequency class, then permuted."""
    with np.errstate(over="ignore"):
        key = (own * _ORDERS[order]) >> np.uint64(4) | own >> np.uint64(60) << np.uint64(60)
    return own[np.argsort(key, kind="stable")[: prefix_length(len(own), percent)]]


def common_words(docs: DataFrame, keep: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and frequency classes (1 to 15) of the words in most documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            word, c = np.unique(np.concatenate(held), return_counts=True)
            often = c > 1
            return pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(c[often].astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(np.unique(word_hashes(text.as_py())))
                n += len(held[-1])
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(keep)
    found = rows.toArrow()
    word = found["word"].to_numpy().view(np.uint64)
    level = np.clip(np.log2(np.maximum(found["n"].to_numpy(), 1)), 1, 15).astype(np.uint64)
    order = np.argsort(word)
    return word[order], level[order]


def _pairs_that_share(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, from the tokens that two sets or more hold."""
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[code] > 1
    shared = np.cumsum(n > 1) - 1
    own, code = own[keep], shared[code[keep]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    own, code = own[order], code[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[own[a:b], code[a:b] - lo] = 1
        used = part.any(axis=0)
        part = part[:, used]
        out += part @ part.T
    return out


def sketch(own: np.ndarray) -> bytes:
    """How many tokens of a set have each value of their lowest bits: a byte for each value, two
    to four tokens a value. Empty where a byte is not enough (then nothing is known)."""
    width = max(32, 1 << max(0, (len(own) - 1) // 4).bit_length())
    n = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


class _Forest:
    """Sets of numbers that grow together; the least number stands for its set."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def tie(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def _may_link(n: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (above the diagonal) that sizes and sides leave."""
    out = np.triu(np.ones((len(n), len(n)), dtype=bool), 1) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
    return out & (side[:, None] != side[None, :]) if side.any() and not side.all() else out


def tied(sketches: list[bytes], n: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Members with a partner that sizes and sketches leave, and for each the first of those it
    is tied to by such partners. Never without a pair that is linked."""
    open_pairs = _may_link(n, side, percent)
    open_pairs |= open_pairs.T
    width = np.array([len(x) for x in sketches])
    forest, some = _Forest(len(n)), np.zeros(len(n), dtype=bool)

    def meet(i: int, with_: np.ndarray) -> None:
        if len(with_):
            some[i] = some[with_] = True
            for j in with_.tolist():
                forest.tie(i, j)

    for i in np.flatnonzero(width == 0).tolist():
        meet(i, np.flatnonzero(open_pairs[i]))
    for w in np.unique(width[width > 0]).tolist():
        wide = np.flatnonzero(width >= w)  # wider ones are folded: their lowest bits
        held = np.stack([np.frombuffer(sketches[i], np.uint8).reshape(-1, w).sum(axis=0, dtype=np.int32) for i in wide.tolist()])
        for at in np.flatnonzero(width[wide] == w).tolist():
            i = int(wide[at])
            left = np.flatnonzero(open_pairs[i, wide] & ((wide > i) | (width[wide] > w)))
            if len(left):
                most = np.minimum(held[left], held[at]).sum(axis=1, dtype=np.int64)
                meet(i, wide[left[(100 + percent) * most >= percent * (n[i] + n[wide[left]])]])
    kept = np.flatnonzero(some)
    return kept, np.array([forest.find(i) for i in kept.tolist()], dtype=np.int64)


def links(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs; ``side`` 0/1 is the block, pairs of one block
    are left out if both blocks have members (they have a group of their own)."""
    m, n = len(sets), np.array([len(s) for s in sets])
    possible = _may_link(n, side, percent)
    for order in range(len(_ORDERS)):
        if not possible.any():
            return []
        possible &= _pairs_that_share([prefix(s, order, percent) for s in sets]) > 0
    a, b = np.nonzero(possible)
    if len(a) > 4 * m:
        both = _pairs_that_share(sets)[a, b].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], dtype=np.int64)
    good = 100 * both >= percent * (n[a] + n[b] - both)
    forest = _Forest(m)
    return [(i, j) for i, j in zip(a[good].tolist(), b[good].tolist()) if forest.tie(i, j)]


def _in_blocks(members: DataFrame, own: DataFrame, columns: list[str]) -> DataFrame:
    """Members (label, cid) with the ``columns`` of ``own`` by cid, a task's group after another:
    label, lo, hi, cid, side, blocks, columns. A label of more than ``BLOCK`` members is cut into
    blocks, each pair of which is a group."""
    counts = members.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    placed = members.join(counts, "label").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = staged(placed.select("label", "cid", "blocks", "own"), "placed")
    spread = placed.join(own.select("cid", *columns), "cid").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("label", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "cid", (F.col("own") > F.col("with")).cast("int").alias("side"), "blocks", *columns)
    return spread.repartition(partitions(members.sparkSession), "label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """The groups of ``_in_blocks``: (label, lo, hi, blocks) and lists of cids, sides and the
    values of each further column (token lists as arrays)."""
    key, held = None, []
    for batch in batches:
        names = [batch.column(k).to_pylist() for k in (0, 1, 2, 5)]
        columns = [batch.column(k).to_pylist() for k in (3, 4)]
        for c in batch.columns[6:]:
            if pa.types.is_list(c.type):
                flat, ends = c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy() - c.offsets[0].as_py()
                columns.append([flat[a:b] for a, b in zip(ends, ends[1:])])
            else:
                columns.append(c.to_pylist())
        for own, row in zip(zip(*names), zip(*columns)):
            if own != key:
                if held:
                    yield key, held
                key, held = own, [[] for _ in row]
            for into, x in zip(held, row):
                into.append(x)
    if held:
        yield key, held


def classes_and_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; also text_key (a hash of its text) and
    ``first``: whether its id and text are those of its component's first row (lowest id, a
    null before all others; then lowest hash). A row with an empty set is first."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    shared = spark.sparkContext.broadcast(common_words(own))  # at most COMMON entries

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                sets = [shingles(x, size, shared.value) for x in batch.column(1).slice(k, 1024).to_pylist()]
                with np.errstate(over="ignore"):
                    d1 = np.array([(s * _M2).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                    d2 = np.array([np.bitwise_xor.reduce((s ^ (s >> np.uint64(31))) * _M3) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
                first = [prefix(s, 0, percent).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, len(sets)), batch.column(2).slice(k, len(sets)), pa.array(d1), pa.array(d2), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.binary())],
                    names=["doc_id", "text_key", "d1", "d2", "n", "prefix", "sketch"],
                )

    keyed = own.withColumn("text_key", F.xxhash64("text"))
    rows = staged(keyed.mapInArrow(describe, "doc_id long, text_key long, d1 long, d2 long, n long, prefix array<long>, sketch binary"), "sets")
    whole = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("root"), F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    classes = staged(whole.withColumn("cid", F.monotonically_increasing_id()), "classes")

    postings = classes.select("cid", F.explode("prefix").alias("token"))
    lists = postings.groupBy("token").agg(F.min("cid").alias("label"), F.max("cid").alias("other")).where("label <> other").select("token", "label")
    members = postings.join(lists, "token").select("label", "cid").distinct().join(classes.select("cid", "n"), "cid")
    # a set without another of like size under its label has no link there: sizes are cut into
    # steps of the threshold, and linked sets are in the same or in neighboring steps
    members = staged(members.withColumn("step", F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).cast("int")), "members")
    near = members.select("label", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step")).groupBy("label", "step").count().where("count > 1").drop("count")
    members = staged(members.join(near, ["label", "step"]).select("label", "cid"), "members")

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _groups(batches):
            if len(group[0]) > 1:
                kept, first = tied(group[3], np.array(group[2]), np.array(group[1]), percent)
                ids = np.array(group[0], dtype=np.int64)
                # named by the least class, so that groups of several labels become one; blocks by their label
                least = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(least, first, ids[kept])
                yield pa.RecordBatch.from_arrays([pa.array(least[first] if key[3] == 1 else np.full(len(kept), key[0])), pa.array(ids[kept])], names=["label", "cid"])

    members = staged(_in_blocks(members, classes, ["n", "sketch"]).mapInArrow(left, "label long, cid long").distinct(), "tied")

    need = classes.select("cid", "of").join(members.select("cid").distinct(), "cid").select("cid", F.col("of.doc_id").alias("of_id"), F.col("of.text_key").alias("of_key"))
    need = staged(need, "need")
    n_need = need.count()
    some = possible(keyed, need.select(F.col("of_id").alias("doc_id"), F.col("of_key").alias("text_key")), ["doc_id", "text_key"])
    found = some.join(need, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))).select("cid", "text")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, size, shared.value).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "tokens"])

    sets = staged(found.mapInArrow(resolve, "cid long, tokens array<long>"), "tokens")
    shared.destroy()
    if sets.count() > n_need:  # repeated rows gave a set more than once
        sets = staged(sets.dropDuplicates(["cid"]), "tokens")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, side, held) in _groups(batches):
            found = links(held, np.array(side), percent) if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"])

    linked = _in_blocks(members, sets, ["tokens"]).mapInArrow(judge, "a long, b long")
    of = components(linked)
    named = classes.select("cid", "d1", "d2", "n", "root", "of").join(of.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = staged(named, "named")
    roots = named.groupBy("component").agg(F.min("root").alias("component_id"), F.min("of").alias("of"))
    by_class = named.select("d1", "d2", "n", "component").join(roots, "component").select("d1", "d2", "n", "component_id", "of")
    first = F.col("doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("text_key") == F.col("of.text_key"))
    full = rows.where("n > 0").select("doc_id", "text_key", "d1", "d2", "n").join(by_class, ["d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key", first.alias("first"))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key", F.lit(True).alias("first"))
    return full.unionByName(empty)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: its first; rows without words all stay. Of
    rows that agree in id and text one stays."""
    found = classes_and_components(docs, id_col, text, size, percent)
    found = staged(found.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    kind = docs.schema[id_col].dataType
    named = lambda x: x.select(F.col("doc_id").cast(kind).alias(id_col), F.col("text_key").alias("row text key"))
    keyed = docs.withColumn("row text key", F.xxhash64(text_or_empty(text)))
    out = without(keyed, named(found.where("not first")), [id_col, "row text key"])
    again = staged(found.where("first AND n > 1"), "again")
    if again.limit(1).count():  # repeated rows are copies as well
        once = possible(keyed, named(again), [id_col, "row text key"])
        once = once.join(named(again).withColumn("row twice", F.lit(True)).withColumnRenamed(id_col, "row id").withColumnRenamed("row text key", "row key"), F.col(id_col).eqNullSafe(F.col("row id")) & (F.col("row text key") == F.col("row key")), "left_semi")
        once = once.groupBy(id_col, "row text key").agg(*[F.first(c, ignorenulls=False).alias(c) for c in docs.columns if c != id_col])
        out = without(out, named(again), [id_col, "row text key"]).unionByName(once.select(out.columns))
    return out.select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_and_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
