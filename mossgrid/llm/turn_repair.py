"""Finds faults in conversations, and their cheapest repair by a retained-subsequence program.

A repair keeps, reroles or deletes each row, and inserts empty rows anywhere, so that the
initials of the roles read ``(s?(ua)+)?``. Rows that are kept or reroled are *retained*. What
lies between two retained rows is priced at once: the rows between are deleted, a difference
of two prefix sums of deletion prices, and the pair of roles tells which rows are inserted.
So the best repair of what follows a retained row is, over the roles of the next retained row,
the least of (best repair from there + deletions up to there), of which one running minimum is
kept for each role. It goes through a conversation once, from its end to its start.

Of equally cheap repairs the one whose audit (the edits' initials) is least by ASCII is taken.
Deletions stand before insertions in a gap, and D < I < K < R, so among repairs that follow one
retained row alike the one with the later next retained row is less, then the one with more
insertions; running minima keep the later row when they are equal.

Rows of a conversation are ordered by turn (nulls first), then role, then text. Faults: blank
(nothing but white space), duplicate (a row before it has the same role and text), truncated
(the last character but white space is not one of ``.!?``); the first that holds counts.

A conversation's texts are never held together: they stream through the task in order. What
is held is one byte and a few numbers a row while its audit is found, and the audit itself,
which is one cell of the result. Order within a conversation is what both are about, so one
conversation's rows are not spread over tasks.

Nulls and ties: a null role or text is one space; null turns come first and are ignored by
``gaps``; the rows without conv_id are one conversation. Equal rows are duplicates but for the
first. An empty table gives an empty one. Columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read, staged

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
_START, _S, _U, _A, _END = range(5)
_NAMES = {_U: "user", _A: "assistant"}
#: Rows to insert between one retained role and the next (or the start and the end).
_BETWEEN = {
    _START: {_S: 0, _U: 0, _A: 1, _END: 0},
    _S: {_U: 0, _A: 1, _END: 2},
    _U: {_U: 1, _A: 0, _END: 1},
    _A: {_U: 0, _A: 1, _END: 0},
}
_STEPS = {role: [(to, n, INSERT * n) for to, n in steps.items()] for role, steps in _BETWEEN.items()}
#: A row's code: the role by its initial (0 if it is another), and 4 or 8 if it must go or is truncated.
_MUST_GO, _CUT = 4, 8
_LEGAL = [4 * a + b for a, b in ((_S, _U), (_U, _A), (_A, _U))]
_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ROWS = "conv_id long, position long, turn long, role string, text string, edit string"


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation's rows."""
    n = len(codes)
    # by role: least (best repair from a retained row on + deletions before it), and that row
    lows: list[tuple[int, int] | None] = [None, None, None, None, (DELETE * n, n)]

    def follow(role: int) -> tuple[int, int, int]:
        """The best way on from a retained row: price less deletions before it, next row, its role."""
        best, at, by, ins = None, 0, 0, 0
        for to, inserts, price in _STEPS[role]:
            low = lows[to]
            if low is None:
                continue
            value = low[0] + price
            if best is None or value < best or (value == best and (low[1], inserts) > (at, ins)):
                best, at, by, ins = value, low[1], to, inserts
        return best, at, by

    next_row, next_role = array("q", bytes(8 * 4 * n)), bytearray(4 * n)
    for j in range(n - 1, -1, -1):
        code = codes[j]
        if code & _MUST_GO:
            continue
        own, extra = code & 3, TRUNCATED if code & _CUT else 0
        found = []
        for role in (own, _U, _A) if own == _S else (_U, _A):
            value, at, by = follow(role)
            next_row[4 * j + role], next_role[4 * j + role] = at, by
            found.append((role, value - DELETE * (j + 1) + extra + (0 if role == own else REROLE)))
        for role, value in found:
            low = lows[role]
            if low is None or value + DELETE * j < low[0]:
                lows[role] = (value + DELETE * j, j)
    cost, at, by = follow(_START)
    audit, role, before = [], _START, -1
    while True:
        audit.append("D" * (at - before - 1) + "I" * _BETWEEN[role][by])
        if by == _END:
            return cost, "".join(audit)
        audit.append("K" if codes[at] & 3 == by else "R")
        role, before = by, at
        at, by = next_row[4 * at + role], next_role[4 * at + role]


def faults(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0, in order), turn, role, text, fault of every row."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long") - 1)
    # the window below is within the partitions of the one above
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1)
    ending = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\u000b\f\r")), -1, 1)
    fault = F.when(F.length(ending) == 0, "blank").when(F.col("seen"), "duplicate").when(~ending.isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "place", "turn", "role", "text", fault.alias("fault"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation in one partition, its rows in a row and in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation of ``faults``' result: counts of faults, cost and audit of its repair."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", _S).when(initial == "u", _U).when(initial == "a", _A).otherwise(0)
    kind = F.when(F.col("fault") == "blank", 1).when(F.col("fault") == "duplicate", 2).when(F.col("fault") == "truncated", 3).otherwise(0)
    slim = turns.select("conv_id", "place", "turn", (role + 4 * kind).cast("byte").alias("code"))

    def summed(conv, codes: np.ndarray, turns: np.ndarray) -> tuple:
        roles, kinds = codes & 3, codes >> 2
        pairs = 4 * roles[:-1] + roles[1:]
        gaps = int(turns.max() - turns.min() + 1 - 1 - np.count_nonzero(np.diff(turns))) if len(turns) else 0
        cost, audit = cheapest((roles + _MUST_GO * np.isin(kinds, (1, 2)) + _CUT * (kinds == 3)).astype(np.uint8).tobytes())
        return (conv, gaps, *(int(np.count_nonzero(kinds == k)) for k in (1, 2, 3)), int(np.count_nonzero(~np.isin(pairs, _LEGAL))), cost, audit)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SUMMARY.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()]
        conv, codes, turns, any_row = None, [], [], False
        for batch in batches:
            out = []
            convs = batch.column(0).to_pylist()
            own_codes = batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint8)
            own_turns, known = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(convs):
                end = begin + 1
                while end < len(convs) and convs[end] == convs[begin]:
                    end += 1
                if any_row and convs[begin] != conv:
                    out.append(summed(conv, np.concatenate(codes), np.concatenate(turns)))
                    codes, turns = [], []
                conv, any_row = convs[begin], True
                codes.append(own_codes[begin:end])
                turns.append(own_turns[begin:end][known[begin:end]])
                begin = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if any_row:
            last = summed(conv, np.concatenate(codes), np.concatenate(turns))
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, kinds)], names=names)

    return _in_order(slim).mapInArrow(step, _SUMMARY)


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of repaired conversations: conv_id, position (from 0), turn (null if inserted),
    role, text, edit (K, R or I). A conversation's rows are in one partition, in order."""
    head = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = _in_order(head.unionByName(turns.select("conv_id", "place", "turn", "role", "text")))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ROWS.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] * 3
        conv, audit, at, position, before = None, "", 0, 0, _A
        out: list[tuple] = []

        def add(turn, role, text, edit) -> None:
            nonlocal position, before
            expected = _A if before == _U else _U  # of a reroled or inserted row
            if edit == "K":
                before = {"s": _S, "u": _U}.get(role[:1], _A)
            else:
                before, role = expected, _NAMES[expected]
            out.append((conv, position, turn, role, text, edit))
            position += 1

        def inserted() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                add(None, None, "", "I")
                at += 1

        for batch in batches:
            for own, place, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place < 0:
                    inserted()
                    conv, audit, at, position, before = own, role, 0, 0, _A
                    continue
                inserted()
                if audit[at] != "D":
                    add(turn, role, text, audit[at])
                at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(step, _ROWS)


def _hashes(rows: DataFrame) -> DataFrame:
    """conv_id and the hash of its ``role:text`` lines, from rows in order."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, []
        for batch in batches:
            for own, position, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if position == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256()
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()))], names=["conv_id", "repaired_sha256"])
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(step, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the damage that the hash of conv_id and turn deals to each."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deed = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    role = F.when(deed == 4, "user").otherwise(filled("role"))
    text = F.when(deed == 1, "").when(deed == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    copies = F.when(deed == 0, 0).when(deed == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(True), copies)).alias("copy"))
    return rows.drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    turns = staged(faults(damaged(conversations)), "turns")
    sums = staged(audits(turns), "audits")
    lines = _hashes(repaired(turns, sums))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("o")
    out = out.join(sums.alias("s"), F.expr("o.conv_id <=> s.conv_id"), "left").join(lines.alias("l"), F.expr("o.conv_id <=> l.conv_id"), "left")
    counts = [F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("o.conv_id", *counts, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("l.repaired_sha256", nothing).alias("repaired_sha256"))


#: Table of crc32 and its use on ASCII digits, blanks and colons, for SQL without such a function.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS entries
  FROM (SELECT unnest(range(256))::BIGINT AS i))"""


def crc_sql(text: str) -> str:
    """crc32 of a text of at least one character, in a query that has ``entries`` at hand."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, x: xor(a >> 8, entries[(xor(a, x) & 255) + 1])))"


def _sql() -> str:
    """Forward over the rows with one (cost, audit, lines) for the start and each role."""
    never = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
    codes = {"start": _START, "s": _S, "u": _U, "a": _A}

    def arrive(to: str) -> str:
        """Least way to retain row r with role initial ``to``."""
        ways = []
        for old, steps in ((o, _BETWEEN[k]) for o, k in codes.items()):
            if codes[to] not in steps:
                continue
            n = steps[codes[to]]
            first = "'assistant:'" if old == "u" else "'user:'"
            ins = f"[{first}]" if n else "[]::VARCHAR[]"
            for role, price, edit, when in [("r.role", 0, "K", f"r.role[1] = '{to}'"), *([(f"'{_NAMES[codes[to]]}'", REROLE, "R", "true")] if to != "s" else [])]:
                ways.append(
                    f"CASE WHEN {when} THEN {{'c': d.{old}.c + {INSERT * n + price} + CASE WHEN r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, 'a': d.{old}.a || '{'I' * n}{edit}', "
                    f"'t': d.{old}.t || {ins} || [{role} || ':' || r.text]}} ELSE {never} END"
                )
        gone = f"{{'c': d.{to}.c + {DELETE}, 'a': d.{to}.a || 'D', 't': d.{to}.t}}"
        return f"CASE WHEN r.fault IN ('blank', 'duplicate') THEN {gone} ELSE list_min([{gone}, {', '.join(ways)}]) END"

    ends = []
    for old, steps in ((o, _BETWEEN[k]) for o, k in codes.items()):
        n = steps[_END]
        more = {0: "[]::VARCHAR[]", 1: "['assistant:']", 2: "['user:', 'assistant:']"}[n]
        ends.append(f"{{'c': d.{old}.c + {INSERT * n}, 'a': d.{old}.a || '{'I' * n}', 't': d.{old}.t || {more}}}")
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE {CRC_TABLE}, dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql(key)} % 20 AS deed FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN deed = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN deed = 1 THEN '' WHEN deed = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE deed WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM damaged
), judged AS (
  SELECT *, right(rtrim(text, {space}), 1) AS ending, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] AS pair FROM placed
), faulted AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM judged
), counts AS (
  SELECT conv_id, max(place) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulted GROUP BY conv_id
), d AS (
  SELECT conv_id, 0::BIGINT AS place, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS start, {never} AS s, {never} AS u, {never} AS a FROM counts
  UNION ALL
  SELECT d.conv_id, r.place, {{'c': d.start.c + {DELETE}, 'a': d.start.a || 'D', 't': d.start.t}}, {arrive("s")}, {arrive("u")}, {arrive("a")}
  FROM d JOIN faulted r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.place = d.place + 1
), best AS (
  SELECT c.*, list_min([{", ".join(ends)}]) AS way FROM d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.place
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit, sha256(coalesce(array_to_string(way.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
"""


SQL = _sql()
