import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from mossgrid.llm import turn_repair
from mossgrid.llm.queries import ORACLE_SQL

LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\f\r"


def brute(rows):
    """Cost, audit and rows of the cheapest repair by trying every edit: rows are (role, text, fault)."""
    n = len(rows)

    @lru_cache(None)
    def best(i, last):  # last: initial of the last row, "" at the start
        if i == n:
            ways = [] if last in ("s", "u") else [(0, "", ())]
        else:
            role, text, fault = rows[i]
            c, a, r = best(i + 1, last)
            ways = [(c + 2, "D" + a, r)]
            extra = 5 if fault == "truncated" else 0
            for edit, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                if fault in ("blank", "duplicate") or (last, new[:1]) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    continue
                c, a, r = best(i + 1, new[:1])
                ways.append((c + price + extra, edit + a, ((new, text), *r)))
        # at most two insertions in a row are ever of use
        return min([*ways, *inserted(i, last, 2)])

    def inserted(i, last, left):
        if not left:
            return []
        new = "assistant" if last == "u" else "user"
        if left == 2:
            c, a, r = min([*plain(i, new[0]), *inserted(i, new[0], 1)], default=(10**9, "~", ()))
        else:
            c, a, r = min(plain(i, new[0]), default=(10**9, "~", ()))
        return [(c + 5, "I" + a, ((new, ""), *r))]

    @lru_cache(None)
    def plain(i, last):
        if i == n:
            return [] if last in ("s", "u") else [(0, "", ())]
        role, text, fault = rows[i]
        c, a, r = best(i + 1, last)
        ways = [(c + 2, "D" + a, r)]
        extra = 5 if fault == "truncated" else 0
        for edit, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
            if fault in ("blank", "duplicate") or (last, new[:1]) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                continue
            c, a, r = best(i + 1, new[:1])
            ways.append((c + price + extra, edit + a, ((new, text), *r)))
        return ways

    out = best(0, "")
    assert LEGAL.fullmatch("".join(role[:1] for role, _ in out[2]))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        f = lambda x: " " if x is None else x
        k = zlib.crc32(f"{f(conv)}:{f(turn)}".encode()) % 20
        role, text = f(role), f(text)
        if k == 4:
            role = "user"
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def expected(rows):
    after, out = damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = sorted((x[1:] for x in after if x[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faulted = set(), []
        for _, role, text in own:
            core = text.rstrip(SPACE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            faulted.append((role, text, fault))
        turns = [x[0] for x in own if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, left = brute(tuple(faulted))
        count = lambda kind: sum(x[2] == kind for x in faulted)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha)
    return out


def found(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("place", "fault", "code", "seen", "audit", "copy")})
    df.repartition(3).write.parquet(f"{path}/conversations.parquet")
    got = turn_repair.query(spark, path)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = got.collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "ux"]), st.sampled_from([None, None, None, "blank", "truncated"])), max_size=9))
def test_program_equals_all_repairs(rows):
    rows = tuple((role, str(k), fault) for k, (role, fault) in enumerate(rows))
    roles = {"s": turn_repair._S, "u": turn_repair._U, "a": turn_repair._A}
    codes = bytes(roles.get(r[:1], 0) + {"blank": 4, "truncated": 8}.get(f, 0) for r, _, f in rows)
    assert turn_repair.cheapest(codes) == brute(rows)[:2]


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "Übung"], ["Yes.", "no", " ", None, "", "Why?\n ", "a ", "line\n.", "x!"]
    rows = [(rng.choice([*range(40), None]), rng.choice([*range(7), None]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [rows[0]] * 5 + [(77, None, None, None), (78, 3, "user", "alone.")]
    rows += [(k, 0, "user", "gone?") for k in range(100, 160)]  # some of these lose their only row
    got = found(spark, tmp_path, rows)
    want = expected(rows)
    assert got == want
    assert any(x[6] == "" and x[5] == 0 for x in want.values())


def test_long_conversation(spark, tmp_path):
    rng = random.Random(5)
    rows = [(5, k, rng.choice(["user", "assistant", "assistant", "system"]), f"{k}" + rng.choice(["", ".", "!"])) for k in range(300)]
    assert found(spark, tmp_path, rows) == expected(rows)
    many = bytes(rng.choice([1, 2, 3, 3, 0, 6, 10, 11]) for _ in range(200_000))
    cost, audit = turn_repair.cheapest(many)
    assert len(audit.replace("I", "")) == len(many) and cost == sum({"D": 2, "I": 5, "R": 1, "K": 0}[x] for x in audit) + 5 * sum(c >= 8 and e != "D" for c, e in zip(many, audit.replace("I", "")))


def test_empty(spark, tmp_path):
    assert found(spark, tmp_path, [(1, 1, "user", "x")][:0]) == {}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello there."), (1, 2, "assistant", "cut of"), (2, 0, "assistant", "Yes."), (2, 1, "user", "x.")]
    turns = turn_repair.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [tuple(r) for r in turn_repair.repaired(turns, turn_repair.audits(turns)).orderBy("conv_id", "position").collect()]
    assert got == [
        (1, 0, 0, "user", "Hi.", "K"), (1, 1, 1, "assistant", "Hello there.", "R"),
        (2, 0, 0, "user", "Yes.", "R"), (2, 1, 1, "assistant", "x.", "R"),
    ]


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in turn_repair.query(spark, sf).collect()} == expected(rows)


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{sf}/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op11_turn_repair"])
    got = turn_repair.query(spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
