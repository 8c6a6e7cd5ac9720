import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from mossgrid.llm import license_texts, licenses, shared
from mossgrid.llm.shared import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    letters = lambda n: chr(97 + n // 26 % 26) + chr(97 + n % 26)
    prose = [" ".join(a + letters(n) for a in ("wa", "ku", "mi") for n in (k, k * 3, k * 7, k + 111, k * k + 222, 600 + k, 300 - k)) for k in range(12)]
    item = "which of the four seasons brings the longest night of the year to people who live in the far north of the world"
    docs = [(k, f"{p}\nThis line stands in every text of this table", "en", "s", 1) for k, p in enumerate(prose)]
    docs += [(50, prose[3] + "\nThis line stands in every text of this table", "en", "s", 1), (60, "Well: " + item + "? indeed", "en", "s", 1), (70, None, None, None, None), (71, "", "en", "s", 0)]
    bad = [(100 + k, f"{prose[k % 12]} you moron{'x' * (k % 2)} {k}", "en", "s", 1) for k in range(30)]
    spark.createDataFrame(docs + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{out}/documents.parquet")
    spark.createDataFrame([(d[0], 1, 0) for d in docs if d[0] < 50] + [(d[0], 0, 1) for d in bad], "doc_id long, quality int, toxic int").write.parquet(f"file://{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), name)
        assert docs.columns == COLUMNS
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept["toxicity"] == {*range(12), 50, 60, 70, 71}
    assert kept["line_dedup"] == kept["toxicity"]
    assert docs.where(F.col("text").contains("This line stands")).count() <= 1
    assert kept["near_duplicates"] == kept["line_dedup"] - {50}
    assert kept["decontaminate"] == kept["near_duplicates"] - {60}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in last.collect()} == kept["decontaminate"]


def test_run(spark, sf):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == {*range(12), 70, 71}


def test_near_duplicates_of_five_words(spark):
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    cut = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    like = lambda x, y, n: len(cut(x, n) & cut(y, n)) / len(cut(x, n) | cut(y, n))
    near = [*words[:30], "other", *words[31:70], "more", *words[71:]]
    assert 0.8 <= like(words, near, 5) < 0.9 and like(words, near, 3) < 0.9
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()} == {1, 3}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


@pytest.mark.parametrize("name", ["op1_decontaminate", "op3_line_templates", "op5_quality_cascade", "op9_license_digests"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    plain = lambda df: sorted(repr([None if x is None or x != x else x for x in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert sorted(got.columns) == columns and plain(got) == plain(want)


def test_whole_licenses_against_sql(spark):
    import duckdb

    rows = [(n, f"Copyright (c) The Authors of {n}\n\n" + t.replace("License", "Licence")) for n, t in enumerate(license_texts.KNOWN.values())]
    rows += [(100 + n, head + license_texts.KNOWN["ISC"]) for n, head in enumerate(("© Someone\n", "(c) 2020 Someone\n", "(c) Someone\n", "Copyright 2001-2004, Someone\n", "* Copyright © Someone\n", "A copyright (c) Someone\n"))]
    folder = "/usr/share/common-licenses"
    for n, name in enumerate(sorted(os.listdir(folder)) if os.path.isdir(folder) else []):
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as h:
            text = h.read()
        rows += [(200 + n, text), (300 + n, text.upper().replace("\n", "\r\n   ")), (400 + n, text + "\nand more")]
    rows += [(None, None), (500, ""), (501, "All rights reserved.\nall RIGHTS reserved\nno")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    documents = df.toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    columns = ["doc_id", "text_license", "line_licenses", "n_license_lines"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({licenses.SQL})").fetchall()
    got = [tuple(r) for r in licenses.scan(df).select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    found = {r[0]: r[1] for r in got}
    assert all(found[n] for n in range(len(license_texts.KNOWN)))
    assert [found[100 + n] for n in range(6)] == ["ISC", "ISC", None, "ISC", "ISC", None]
    if os.path.isdir(folder):
        whole = {found[n] for n in found if n is not None and 200 <= n < 300} - {None}
        assert whole and whole <= set(license_texts.WHOLE) | set(license_texts.KNOWN)


def test_no_other_module_imports_this_package():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, files in os.walk(os.path.join(top, "mossgrid")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as h:
                    assert "mossgrid.llm" not in h.read()


CLASHING = ["score", "predicted", "n_dropped", "line_key", "gone_key", "gone_pos", "leaking_id", "text_key", "first", "n", "column 2"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_on_odd_rows(spark, sf):
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    one, other = " ".join(words), " ".join(reversed(words))
    long = " ".join(f"w{k}{'xyz'[k % 3]}" for k in range(40_000))
    rows = [(1, one), (5, one), (5, other), (5, other), (None, long), (None, long), (8, None), (8, None), (None, None), (9, ""), (10, " \n "), (11, long + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c + " "), F.xxhash64("doc_id", "text").cast("string")) for c in CLASHING})
    value = {tuple(r[:2]): tuple(r) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, sf)
        assert got.columns == df.columns and got.dtypes == df.dtypes
        want = [(1, one), (5, other), (None, long), (8, None), (8, None), (None, None), (9, ""), (10, " \n ")] if name == "near_duplicates" else rows
        assert rows_of(got) == sorted((value[x] for x in want), key=repr), name
        empty = stage(spark, df.limit(0), sf)
        assert empty.columns == df.columns and empty.count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf).collect()
    assert sum(r["start"] == 0 for r in packed) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), sf).count() == 0


def test_stages_drop_what_they_staged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = set(shared.staged_folders())
    rows_of(corpus_pipeline.near_duplicate_stage(spark, docs, sf))
    made = set(shared.staged_folders()) - before
    assert made
    rows_of(corpus_pipeline.toxicity_stage(spark, docs, sf))
    assert not made & set(shared.staged_folders())
