import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from mossgrid.llm import turn_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def of_paths(paths):
    """Nodes of {conv: tuple of (role, text)} by brute force."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = sum(saved[c] for c in children[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    sha = lambda path: hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: tuple((r.decode(), t.decode()) for _, _, r, t in sorted(x)) for c, x in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: own.get(c - c % 100, ())[: h(c)] + x[h(c) :] for c, x in own.items()}


def collected(df):
    assert df.columns == COLUMNS
    return sorted((*(-1 if x is None else x for x in tuple(r)[:7]), r["ends_sha256"]) for r in df.collect())


def found(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("ids", "sizes", "h", "base", "place", "digest", "n")})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return collected(turn_trie.query(spark, str(tmp_path)))


@pytest.fixture(params=[8192, 30])
def local(request, monkeypatch):
    monkeypatch.setattr(turn_trie, "LOCAL_TURNS", request.param)


def test_odd_rows(spark, tmp_path, local):
    rng = random.Random(1)
    rows = [(rng.choice([*range(12), *range(100, 130), 205, None]), rng.choice([*range(9), None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bb", None, "", "é漢🙂"])) for _ in range(300)]
    rows += [rows[3]] * 4 + [(777, 0, "user", "only"), (778, 0, "user", "only")]  # no base; turnless where h > 0
    paths = rebuilt(rows)
    assert any(not p for p in paths.values())
    assert found(spark, tmp_path, rows) == of_paths(paths)


def test_copies_long_paths_and_prefixes(spark, local):
    paths = {k: (("user", "hot"), ("assistant", "same")) for k in range(100, 160)}
    paths |= {k: tuple(("user", "x" * (j % 3)) for j in range(k)) for k in range(0, 9)}  # one path of nodes
    paths |= {900: tuple(("user", str(j)) for j in range(500)), 901: (*(("user", str(j)) for j in range(480)), ("user", "z")), 902: ()}
    names = {t: k for k, t in enumerate({t for p in paths.values() for t in p})}
    rows = [(c, [names[t] for t in p], [len(t[1]) for t in p]) for c, p in paths.items()]
    got = turn_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, ids array<long>, sizes array<int>").repartition(3))
    assert collected(got) == of_paths(paths)


def test_bucket_nodes_alone():
    rng = random.Random(8)
    for _ in range(200):
        paths = {}
        while len(paths) < rng.randrange(1, 30):
            p = tuple(("u", "t" * rng.randrange(4)) for _ in range(rng.randrange(6)))
            if p not in paths.values():
                paths[rng.randrange(10**6)] = p
        if paths:
            rows = [(c, 1, [len(t[1]) for t in p], [len(t[1]) for t in p], hashlib.sha256(str(c).encode()).hexdigest()) for c, p in paths.items()]
            got = sorted((x[0], x[1], -1 if x[2] is None else x[2], *x[3:8]) for x in turn_trie.bucket_nodes(None, 0, rows))
            assert got == of_paths(paths)


def test_empty(spark, tmp_path):
    assert found(spark, tmp_path, [(1, 1, "user", "x")][:0]) == []


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{sf}/conversations.parquet'")
    want = con.sql(turn_trie.SQL)
    got = collected(turn_trie.query(spark, sf))
    assert got == sorted((*(-1 if x is None else x for x in r[:7]), r[7]) for r in want.select(*COLUMNS).fetchall())
    rows = con.sql("select conv_id, turn, role, text from conversations").fetchall()
    assert got == of_paths(rebuilt(rows))
