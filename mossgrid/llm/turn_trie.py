"""The trie of conversation prefixes, by distributed radix partitioning from the first turn on.

Turns (role and text) are coded by a dictionary; a conversation is an array of ids. Equal
conversations are merged first, with their number and least id. A *bucket* holds what agrees
on its first turns. All begins as one bucket; a round deals the conversations of each bucket
that is larger than ``LOCAL_TURNS`` into new buckets by the id that follows what the whole
bucket has in common (the common prefix of its least and its greatest sequence, so turns that
all share take no round). A bucket that is small enough is finished by one task: multikey
quicksort (three parts around a pivot id, one turn at a time) puts its sequences in order, and
each part of equal ids is a node. Numbers of leaves and saved tokens are summed up the nodes,
within tasks for small buckets and round by round, backwards, for large ones.

Rounds are as many as branchings with large buckets on one path; every table of a round is
written to the shared folder. Nothing about a conversation but its ids and text lengths, 12
bytes a turn, is ever in one row; the ids of conversations that end at one node stream in
order through the task that hashes them.

Nodes are distinct sequences of turns, told by 256-bit digests of role and text.

Nulls and ties: rows of a conversation are in order of turn (nulls first), then role, then
text; a null role or text is empty; rows without conv_id belong to no conversation. Repeated
rows are turns like others. An empty table has no nodes. Columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read, staged
from .turn_repair import CRC_TABLE, crc_sql

#: Turns (and ends) of a bucket that a task finishes by itself.
LOCAL_TURNS = 8192
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NODES = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE) + ", start long"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_END = -1


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids and sizes (code points of the texts) of every conversation, in order."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    turns = rows.select("conv_id", place.alias("place"), digest.alias("digest"), F.length("text").alias("chars"))
    entries = turns.groupBy("digest").agg(F.first("chars").alias("size")).select("digest", "size", F.monotonically_increasing_id().alias("id"))
    coded = turns.drop("chars").join(staged(entries, "turn-ids"), "digest")
    own = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "size"))).alias("turns"))
    return own.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """Equal sequences as one: conv (least id), n, ids, sizes, ends (hash of all ids, ascending)."""
    keyed = sequences.withColumn("key", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256))
    merged = keyed.groupBy("key").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes"))
    members = keyed.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["key", "ends"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, digest.hexdigest())], names=["key", "ends"])

    return merged.join(members.mapInArrow(hashed, "key string, ends string"), "key").drop("key")


def bucket_nodes(parent: int | None, start: int, rows: list[tuple]) -> list[tuple]:
    """All nodes from depth ``start`` on of (conv, n, ids, sizes, ends) rows, different
    sequences that agree on their first ``start`` turns; the node they share comes first."""
    nodes: list[list] = []
    above: list[int] = []

    def node(begin: int, end: int, depth: int, parent_at: int) -> int:
        some = rows[begin:end]
        conv, n = min(x[0] for x in some), sum(x[1] for x in some)
        saved = (n - 1) * rows[begin][3][depth - 1] if depth else 0
        nodes.append([conv, depth, nodes[parent_at][0] if parent_at >= 0 else parent, n, 0, 0, saved, _NO_ENDS, start])
        above.append(parent_at)
        return len(nodes) - 1

    def letter(k: int, depth: int) -> int:
        ids = rows[k][2]
        return ids[depth] if depth < len(ids) else _END

    todo = [(0, len(rows), start, node(0, len(rows), start, -1))]
    while todo:
        begin, end, depth, at = todo.pop()
        if end - begin == 1:
            for d in range(depth + 1, len(rows[begin][2]) + 1):
                at = node(begin, end, d, at)
            nodes[at][7] = rows[begin][4]
            continue
        pivot = sorted(letter(k, depth) for k in (begin, (begin + end) // 2, end - 1))[1]
        less, k, more = begin, begin, end
        while k < more:
            own = letter(k, depth)
            if own < pivot:
                rows[less], rows[k] = rows[k], rows[less]
                less, k = less + 1, k + 1
            elif own > pivot:
                more -= 1
                rows[k], rows[more] = rows[more], rows[k]
            else:
                k += 1
        todo += [(a, b, depth, at) for a, b in ((begin, less), (more, end)) if a < b]
        if pivot == _END:
            nodes[at][7] = rows[less][4]
        else:
            todo.append((less, more, depth + 1, node(less, more, depth + 1, at)))
    for x, up in zip(nodes[::-1], above[::-1]):  # a node stands behind the one above it
        x[5] = x[5] or 1
        if up >= 0:
            nodes[up][4] += 1
            nodes[up][5] += x[5]
            nodes[up][6] += x[6]
    return [tuple(x) for x in nodes]


def _finished(small: DataFrame) -> DataFrame:
    """Nodes of small buckets."""
    rows = small.select("top", "parent", "start", "conv", "n", "ids", "sizes", "ends").repartition("top").sortWithinPartitions("top")
    kinds = [pa.string() if c == "ends_sha256" else pa.int64() for c in [*_NODE, "start"]]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, out = None, [], []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[*_NODE, "start"])
            out.clear()
            return batch

        for batch in batches:
            for top, parent, start, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and top != now[0]:
                    out += bucket_nodes(*now[1:], own)
                    own = []
                    if len(out) > LOCAL_TURNS:
                        yield flush()
                now = (top, parent, start)
                own.append(tuple(row))
        if now is not None:
            out += bucket_nodes(*now[1:], own)
        if out:
            yield flush()

    return rows.mapInArrow(step, _NODES)


def _stats() -> list[Column]:
    """Of a bucket: least conversation, conversations, turns, and what its sequences share."""
    ids = [F.min(F.struct("ids", "sizes")).alias("least"), F.max("ids").alias("most")]
    return [F.min("conv").alias("child"), F.sum("n").alias("n_convs"), F.sum(F.size("ids").cast("long") + 1).alias("load"), *ids]


def _with_shared(buckets: DataFrame) -> DataFrame:
    """Depth that all of a bucket share, and the text sizes on the way there."""
    differ = F.array_position(F.zip_with("least.ids", "most", lambda a, b: ~a.eqNullSafe(b)), True)
    shared = F.when(differ > 0, differ - 1).otherwise(F.size("least.ids")).cast("long")
    return buckets.withColumn("shared", shared).withColumn("shared_sizes", F.slice("least.sizes", F.lit(1), F.col("shared").cast("int"))).drop("least", "most")


def prefix_trie(sequences: DataFrame, local_turns: int | None = None) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, ids, sizes)."""
    most = LOCAL_TURNS if local_turns is None else local_turns
    rows = staged(distinct_sequences(sequences), "trie-sequences")
    root = _with_shared(rows.agg(*_stats())).where("child IS NOT NULL")
    buckets = staged(root.select(F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("start"), "child", "n_convs", "load", "shared", "shared_sizes"), "trie-buckets")
    moved = rows.crossJoin(F.broadcast(buckets.select("parent", "start", F.col("child").alias("top"), "load", "shared")))  # one row
    rounds, finished = [], []
    while True:
        finished.append(moved.where(F.col("load") <= most))
        large = buckets.where(F.col("load") > most)
        if large.isEmpty():
            break
        active = moved.where(F.col("load") > most).select("top", "shared", "conv", "n", "ids", "sizes", "ends")
        going = active.where(F.size("ids") > F.col("shared")).withColumn("letter", F.get("ids", F.col("shared").cast("int")))
        children = _with_shared(going.groupBy("top", "letter", F.col("shared").alias("before")).agg(*_stats()))
        children = staged(children.withColumnRenamed("top", "parent").withColumn("start", F.col("before") + 1).drop("before"), "trie-buckets")
        own = children.select(F.col("parent").alias("top"), "letter", F.col("child").alias("new"), "start", "load", F.col("shared").alias("new_shared"))
        dealt = going.drop("shared").join(own, ["top", "letter"])
        dealt = dealt.select(F.col("top").alias("parent"), "start", F.col("new").alias("top"), "load", F.col("new_shared").alias("shared"), "conv", "n", "ids", "sizes", "ends")
        rounds.append((large, active.where(F.size("ids") == F.col("shared")).select(F.col("top").alias("child"), "ends")))
        moved, buckets = staged(dealt, "trie-rows"), children.drop("letter")
    small = finished[0].select("top", "parent", "start", "conv", "n", "ids", "sizes", "ends")
    for x in finished[1:]:
        small = small.unionByName(x.select(small.columns))
    nodes = staged(_finished(small), "trie-nodes")
    tops = nodes.where("depth = start")  # nodes at which buckets begin, of all rounds
    parts = [nodes]
    for large, ended in reversed(rounds):
        # a large bucket is the node at ``start`` and those below it down to where it branches
        below = tops.where("parent_conv_id IS NOT NULL").select(F.col("parent_conv_id").alias("child"), (F.col("start") - 1).alias("shared"), "n_leaves", "saved_tokens")
        below = below.groupBy("child", "shared").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        known = large.join(below, ["child", "shared"], "left").join(ended, "child", "left")
        chain = known.withColumn("depth", F.explode(F.sequence("start", "shared")))
        size = F.coalesce(F.get("shared_sizes", F.col("depth").cast("int") - 1), F.lit(0))  # the root has no text
        last = F.col("depth") == F.col("shared")
        own = (F.col("n_convs") - 1) * size + F.when(last, F.coalesce("below", F.lit(0))).otherwise(0)
        down = Window.partitionBy("child").orderBy(F.desc("depth"))
        made = chain.select(
            F.col("child").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("child")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.sum(own).over(down).cast("long").alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(_NO_ENDS))).otherwise(_NO_ENDS).alias("ends_sha256"), "start",
        )
        made = staged(made, "trie-nodes")
        parts.append(made)
        tops = tops.unionByName(made.where("depth = start"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select(_NODE)


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of the one that begins its hundred."""
    first = F.crc32(F.col("conv_id").cast("string")) % 6
    own = sequences.withColumn("h", first.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    others = sequences.select(F.col("conv_id").alias("base"), F.slice("ids", 1, 5).alias("base_ids"), F.slice("sizes", 1, 5).alias("base_sizes"))
    both = own.join(others, "base", "left")

    def mixed(name: str) -> Column:
        head = F.coalesce(F.slice(f"base_{name}", F.lit(1), F.col("h")), F.slice(name, 1, 0))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.size(name))).alias(name)

    return both.select("conv_id", mixed("ids"), mixed("sizes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(staged(sequences(read(spark, sf_dir, "conversations")), "conversations")))


SQL = f"""
WITH {CRC_TABLE}, placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY place) AS turns, any_value({crc_sql("conv_id::VARCHAR")}) % 6 AS h FROM placed, crc_table GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), members AS (
  SELECT conv_id, turns[1:depth] AS path, depth, depth = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(path[-1].text) END AS saved
  FROM members GROUP BY depth, path
), places AS (
  SELECT m.conv_id, m.depth, n.conv_id AS node FROM members m JOIN nodes n ON m.depth = n.depth AND m.path = n.path
), linked AS (
  SELECT n.*, p.node AS parent_conv_id FROM nodes n LEFT JOIN places p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT p.node AS conv_id, p.depth, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM nodes n JOIN places p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.conv_id = n.conv_id AND c.depth = n.depth GROUP BY ALL
)
SELECT l.conv_id, l.depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked l JOIN sums s ON s.conv_id = l.conv_id AND s.depth = l.depth LEFT JOIN children c ON c.conv_id = l.conv_id AND c.depth = l.depth
"""
