import collections
import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mossgrid.llm import components, decontaminate, line_templates, ngram_join, suffix_dedup
from mossgrid.llm.suffix_grouping import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute_repeats(rows):
    c = collections.Counter()
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raws:
        c.update(b[i : i + 400] for i in range(len(b) - 399))
    out = collections.Counter()
    for d, b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if c[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[d, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    return out


@pytest.mark.parametrize("most", [2000, 3])
def test_suffix_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef \n") for _ in range(900))
    rows = []
    for k in range(60):
        a, n = rng.randint(0, 500), rng.randint(330, 480)
        rows.append((k, "".join(rng.choice("abcdé\0") for _ in range(rng.randint(0, 300))) + passage[a : a + n] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 700)))))
    rows += [(200, "a" * 2000), (201, "a" * 399), (202, "a" * 400), (203, "ab" * 900), (204, None), (205, ""), (206, "xyz" * 300 + "q" + "xyz" * 300), (None, passage), (None, passage), (207, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.deduplicated(df).collect())
    assert got == brute_repeats(rows)
    assert suffix_dedup.deduplicated(df.limit(0)).count() == 0


def test_core_keys(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STRETCH", 700)
    suffix_dedup._powers.cache_clear()
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    data[3000:3900] = data[100:1000]
    start = np.arange(0, 5000 - suffix_dedup.CORE)
    keys = suffix_dedup.core_keys(data, start)
    by_text = collections.defaultdict(set)
    for s, k in zip(start.tolist(), keys.tolist()):
        by_text[data[s : s + suffix_dedup.CORE].tobytes()].add(k)
    assert all(len(x) == 1 for x in by_text.values()) and len(set(keys.tolist())) == len(by_text) < len(start)
    suffix_dedup._powers.cache_clear()


def test_suffix_dedup_of_a_long_text(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(300_000))
    rows = [(1, long), (2, "before " + long[150_000:151_000] + " after"), (3, long[299_500:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.deduplicated(df).collect()}
    assert got == {1: (300_000, 1500, 2), 2: (1013, 1000, 1), 3: (500, 500, 1)}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def brute_join(rows, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [256, 4])
def test_ngram_join(spark, odd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    for base in range(4):
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for k in range(30):
            own = list(text)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((1000 * (base + 1) + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(0))
    got = collections.Counter(tuple(r) for r in ngram_join.classes_and_components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_join(rows)
    assert ngram_join.classes_and_components(df.limit(0)).count() == 0


def test_orders_differ_and_prefixes_meet():
    rng = np.random.default_rng(0)
    for _ in range(100):
        both = np.unique(rng.integers(0, 2**62, 60).astype(np.uint64))
        x, y = np.sort(both[:58]), np.sort(both[2:])
        if 100 * 56 >= 90 * 60:
            for order in range(3):
                assert set(ngram_join.prefix(x, order).tolist()) & set(ngram_join.prefix(y, order).tolist())


def test_line_templates(spark, odd, empty):
    common = [f"Page {k} of 12 printed on day {k * 3} for the archive" for k in range(8)]
    rows = [(100 + k, f"own first line number {'abcdefgh'[k]} is here\n{common[k]}\nThe same line stands in all of these\nshort") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in line_templates.clean(df).collect()}
    assert got[100][0] == 0
    for k in range(1, 8):
        assert "The same line" not in got[100 + k][1] and "Page" not in got[100 + k][1]
        assert got[100 + k][1].endswith("short")
    out = line_templates.clean(odd)
    assert out.columns == [*odd.columns] and out.count() == odd.count()
    assert line_templates.clean(empty).count() == 0


def test_decontaminate(spark, odd, empty):
    item = "If a train leaves with 12 coaches and Maria waits 5 hours near the old bridge how many coaches are left over"
    same = item.replace("12", "30").replace("Maria", "Peter").replace("5 hours", "7 days")
    mixed = "We saw it. " + same + ". Then nothing."
    rows = [(1, "Before. " + item + " After."), (2, mixed), (3, "nothing of that kind is said in this text at all, really nothing"), (4, None), (5, " ".join(item.split()[:9]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (7, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 7): False, (2, 7): True}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()) == [3, 4, 5]
    inconsistent = "x " + item.replace("12 coaches", "30 coaches") + " y"
    twice = spark.createDataFrame([(1, "if a train has 12 wagons and another train has 12 wagons how many wagons are there in both")], "item_id long, text string")
    other = spark.createDataFrame([(1, "so if a train has 12 wagons and another train has 13 wagons how many wagons are there in both"), (2, "so if a train has 15 wagons and another train has 15 wagons how many wagons are there in both")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(other, twice).collect()] == [2]
    assert inconsistent
    assert decontaminate.leaks(odd, bench).count() == 0
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_decontaminate_in_any_case(spark):
    item = "Here is a list, Anna: blue ink, red paper, green glass, old wood, 12 nails, thin wire; which of these does she need to build a small house for birds"
    other = item.replace("red paper", "white salt").replace("green glass", "cold milk").replace("old wood", "brown bread").replace("thin wire", "warm rice").replace("small house for birds", "table")
    rows = [(1, "Before. " + item.upper() + " AFTER."), (2, item.lower()), (3, item.title()), (4, other.upper()), (5, item.replace("Anna", "Clara").replace("12", "30"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()] == [4]
    assert 1 not in {r["doc_id"] for r in decontaminate.leaks(df, bench).collect()}


def test_decontaminate_long_runs(spark):
    """Very many names or parts of a number in a row."""
    prose = "the wizard asked seven small dragons for a map of the old northern castle"
    runs = ["said " + "Anna " * 60_000, "at " + "1.2," * 60_000 + "3 km"]
    docs = spark.createDataFrame([(k, f"{run} . {prose}") for k, run in enumerate(runs)] + [(2, prose)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, prose)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()) == [0, 1, 2]
    assert decontaminate.decontaminated(docs, bench).count() == 0


@pytest.mark.parametrize("n", [(10, 7), (8, 8), (5, 40)])
def test_several_line_templates_in_a_leaf(spark, n):
    words = [a + b for a in "abcdefgh" for b in "klmnop"]
    lines = [f"click here to read more about {x} in our blog" for x in words[: n[0]]] + [f"click here to buy the new {x} from partner shops" for x in words[: n[1]]]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_templates.clean(df, several=True).collect()}
    assert got == {k: int(k not in (0, n[0])) for k in range(sum(n))}


def brute_templates(rows, least=5):
    """(row, place) of the lines that go where a leaf has several templates; one text an id."""
    share, leaves = line_templates.AGREEMENT, collections.defaultdict(lambda: collections.defaultdict(list))
    for r, (_, text) in enumerate(rows):
        for place, line in enumerate(text.split("\n")):
            raw = line.split()
            if len(raw) >= 3:
                t = tuple(raw) if all(any(c.isdigit() for c in x) for x in raw) else tuple("<*>" if any(c.isdigit() for c in x) else x for x in raw)
                leaves[len(t), t[:3]][t].append((r, place))
    docs = lambda spots: len({r for r, _ in spots})
    gone = set()
    for leaf in leaves.values():
        if docs([x for spots in leaf.values() for x in spots]) < least:
            continue

        def carried(lines):
            n = collections.Counter()
            for t in lines:
                n.update({(at, x): docs(leaf[t]) for at, x in enumerate(t)})
            return n

        def template(lines):
            best = {}
            for (at, x), n in carried(lines).items():
                best[at] = max(best.get(at, (0, "")), (n, x))
            return tuple(best[at][1] if best[at][0] >= least else None for at in sorted(best))

        def fit(lines, own):
            return [t for t in lines if sum(x == y for x, y in zip(t, own)) >= share * len(t)]

        kind = {t: t for t in leaf if docs(leaf[t]) >= least}
        first = fit(leaf, template(leaf))
        first = first if docs([x for t in first for x in leaf[t]]) >= least else []
        rest, nodes, found = [t for t in leaf if t not in first], collections.defaultdict(list), collections.defaultdict(dict)
        n = carried(rest)
        for t in rest:
            ranked = sorted((-n[at, x], at, x) for at, x in enumerate(t) if n[at, x] >= least)
            if len(ranked) >= share * len(t):
                free = tuple(x for x in ranked if x[1] >= 3)
                keys = [free[:d] for d in line_templates.DEPTHS] + [tuple(ranked[: math.ceil(share * len(t))]), free[-1:]]
                for depth, key in enumerate(keys):
                    nodes[depth, key].append(t)
        for (depth, _), lines in nodes.items():
            own = template(lines)
            for t in fit(lines, own):
                found[own][t] = min(depth, found[own].get(t, depth))
        for own, lines in found.items():
            if docs([x for t in lines for x in leaf[t]]) >= least:
                for t, depth in lines.items():
                    if not isinstance(kind.get(t), list) or depth < kind[t][0]:
                        kind[t] = [depth, own]
        kind |= {t: "first" for t in first}
        groups = collections.defaultdict(list)
        for t, k in kind.items():
            groups[repr(k[1]) if isinstance(k, list) else k].extend(leaf[t])
        for spots in groups.values():
            gone |= set(spots) - {min(spots, key=lambda x: (rows[x[0]][0], x[1]))}
    return gone


def test_several_templates_against_brute_force(spark):
    rng = random.Random(8)
    words = lambda few: [a + b for a in "bcdfg" for b in few]
    made = []
    for k in range(9):  # one leaf: some constants are shared by several templates, fields vary much or little
        made.append([rng.choice(words("ae")) if at not in (3 + k % 5, 9) else None for at in range(11)])
    lines = [" ".join(["all", "lines", "begin", *(x or rng.choice(words("ou")) + "xyz"[rng.randrange(3)] for x in t)]) for t in made for _ in range(rng.randint(3, 14))]
    lines += [f"{a} {b} {rng.choice('uvw')} {rng.randint(1, 99)} {rng.choice(words('a'))}" for a in "kl" for b in "mn" for _ in range(12)]
    lines += ["all lines begin"] * 4 + ["1 2 3"] * 6 + ["short one"] * 6 + [f"{k} {k + 1} {k + 2}" for k in range(6)]
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[k::60])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_templates.clean(df, several=True).collect()}
    gone = brute_templates(rows)
    want = {d: "\n".join(x for at, x in enumerate(t.split("\n")) if (r, at) not in gone) for r, (d, t) in enumerate(rows)}
    assert got == want
    assert len(gone) > line_templates.recurring(df).count()


def test_many_templates_of_one_leaf(spark):
    letters = [a + b for a in "abcdefgh" for b in "klmnop"]
    lines = [f"see this page about{letters[k]} topic{letters[k]} read{letters[k]} by {letters[j]}" for k in range(40) for j in range(6)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {r["doc_id"] for r in line_templates.clean(df, several=True).where("n_dropped = 0").select("doc_id").collect()}
    assert kept == {6 * k for k in range(40)}


def test_staged_tables_of_threads(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30) if k % 10 != 9], "a long, b long")
    with ThreadPoolExecutor(3) as pool:
        for got in pool.map(lambda _: {tuple(r) for r in components.components(links).collect()}, range(3)):
            assert got == {(k, k // 10 * 10) for k in range(30)}


def test_short_lines(spark):
    rows = [(k, f"Read more\n{'abcdefgh'[k]} own text\n{k + 100}\n7\nPage {k}\n\nStop") for k in range(6)] + [(9, "Read this")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_templates.clean(df, short=True).collect()}
    assert got[0] == rows[0][1].split("\n") and got[9] == ["Read this"]
    for k in range(1, 6):
        assert got[k] == [f"{'abcdefgh'[k]} own text", str(k + 100), ""]


def test_rows_of_numbers_are_no_template(spark):
    rows = [(k, f"{k}1 {k}2 {k * 7}.5 {k + 100} 2{k}\n7 7 7 7\nrow {k} of 9") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"short": True, "several": True}):
        got = {r["doc_id"]: r["text"].split("\n") for r in line_templates.clean(df, **options).collect()}
        assert got[0] == rows[0][1].split("\n")
        assert all(got[k] == rows[k][1].split("\n")[:1] for k in range(1, 8))


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_lose_no_link(percent):
    rng = np.random.default_rng(percent)
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 40, 127, 129, 260, 900, 3000) for _ in range(4)]
    near = [np.unique(np.concatenate([s[rng.random(len(s)) > 0.06], rng.integers(0, 2**63, len(s) // 40 + 1, dtype=np.uint64)])) for s in base]
    sets = [*base, *near, *base[::3]]
    n, side = np.array([len(s) for s in sets]), np.arange(len(sets)) % 2
    for own in (np.zeros(len(sets), int), side):
        for hidden in (set(), {1, 30}):  # a sketch that tells nothing
            kept, first = ngram_join.tied([b"" if k in hidden else ngram_join.sketch(s) for k, s in enumerate(sets)], n, own, percent)
            of = dict(zip(kept.tolist(), first.tolist()))
            for i, a in enumerate(sets):
                for j in range(i):
                    both = len(np.intersect1d(a, sets[j]))
                    if 100 * both >= percent * (len(a) + len(sets[j]) - both) and (not own.any() or own[i] != own[j]):
                        assert of[i] == of[j]


def test_sets_go_only_to_those_left_by_sketches(spark, monkeypatch):
    # texts of one size that share rare words, and two that link
    common = " ".join(f"rare{k}" for k in range(6))
    rows = [(k, " ".join(f"own{k}x{j}" for j in range(60)) + " " + common) for k in range(30)]
    rows += [(100, rows[0][1] + " end")]
    seen = {}
    plain = ngram_join.staged

    def watched(df, name, held=None):
        out = plain(df, name, held)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(ngram_join, "staged", watched)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.classes_and_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{k: k for k in range(30)}, 100: 0}
    assert seen["tokens"][0].count() == 2


def test_covered_bytes():
    rng = np.random.default_rng(6)
    for n in (400, 463, 900, 2500):
        start = rng.integers(0, n - 399, 9)
        bits = (rng.random((9, suffix_dedup.STEP)) < 0.2) & (start[:, None] >= np.arange(suffix_dedup.STEP))
        mask = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()  # bit 63 is the sign
        want = np.zeros(n, dtype=bool)
        for k, e in np.argwhere(bits):
            want[start[k] - e : start[k] - e + suffix_dedup.WINDOW] = True
        np.testing.assert_array_equal(suffix_dedup.covered(n, start, mask), want)
