import collections
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mossgrid.llm import attention_lm, license_texts, licenses, quality, toxicity


def test_quality(spark, odd, empty):
    out = quality.cascade(odd)
    got = [r for r in out.collect()]
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["base_failed"] and by[3]["base_failed"] and not by[2]["kept"]
    assert by[1]["kept"] and by[9]["n_dup_lines"] == 1
    for r, text in ((by[x], t) for x, t in ((5, odd.where("doc_id = 5").first()["text"]), (9, "a\n\na\na  b \n"))):
        w = text.split()
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {i for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
    assert quality.cascade(empty).count() == 0


def test_quality_order(spark):
    df = spark.createDataFrame([("word " * 30 + "#" * k,) for k in range(40)], "text string").withColumn("doc_id", F.lit(1))
    rules = {"never": lambda: F.lit(False), "often": lambda: F.length("text") > 155}
    sample = quality.base(df).drop("doc_id")
    assert quality.measured_order(sample, rules)[0][0] == "often"


def test_licenses(spark, odd, empty):
    mit = license_texts.KNOWN["MIT"]
    variant = "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ,").replace("LICENSE", "LICENCE")
    df = spark.createDataFrame([(1, variant), (2, "Some prose.\nReleased under the MIT Licence!\nAll rights reserved"), (3, None), (4, mit[:-20]), (4, mit[:-20])], "doc_id long, text string").withColumn("digest", F.lit(0))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert got[1]["text_license"] == "MIT"
    assert got[2]["text_license"] is None and got[2]["line_licenses"] == "MIT-notice,reserved-notice" and got[2]["n_license_lines"] == 2
    assert got[3]["line_licenses"] == "" and got[4]["text_license"] is None
    known = licenses.known(spark)
    assert known.count() == len(license_texts.KNOWN)
    texts = spark.createDataFrame(list(license_texts.KNOWN.items()), "doc_id string, text string")
    assert licenses.scan(texts).where("text_license is null").count() == 0
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd).count() == odd.select("doc_id", "text").distinct().count()


def test_licenses_in_full(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for name in names:
        if not os.path.exists(f"{folder}/{name}"):
            pytest.skip("the texts are not on this machine")
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            rows.append((names[name], f.read()))
    rows += [("Apache-2.0", rows[0][1][: rows[0][1].index("END OF TERMS")]), (None, rows[0][1][:5000])]
    rows += [("MIT", license_texts.KNOWN["MIT"].replace("\n\n", f"\n\n{line}\n\n", 1)) for line in ("Copyright (c) The Authors", "Copyright © the authors and others", "Copyright (C) 2021 Someone")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan(df).collect()}
    assert got == {k: name for k, (name, _) in enumerate(rows)}


def test_given_texts(spark):
    df = spark.createDataFrame([(1, "Use it as you LIKE!"), (2, "x\nuse it, as you like\ny"), (3, "use it")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text_license"], r["line_licenses"]) for r in licenses.scan(df, texts={"free": "Use it as you like."}).collect()}
    assert got == {1: ("free", "free"), 2: (None, "free"), 3: (None, "")}


def toxic_rows(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioutnrslhd") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    bad = ["idiot", "worthless", "pathetic"]
    rows = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(60)]
        toxic = k % 4 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(w[:30]) + ". " + " ".join(w[30:]), int(toxic)))
    return rows


def test_toxicity(spark, odd, empty):
    rows = toxic_rows()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    extra = spark.createDataFrame([(1000, "you are an i.d.i.o.t here"), (1001, "you i d i o t there"), (1002, "some worthlesss thing"), (1003, None), (1004, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scored(docs.unionByName(extra), labels).collect()}
    y = {d: v for d, _, v in rows}
    right = sum(got[d]["predicted"] == v for d, v in y.items())
    assert right >= 0.97 * len(y)
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == 1 and got[1002]["score"] > got[1003]["score"]
    assert 0 <= got[1003]["score"] == got[1004]["score"] < 0.5
    assert toxicity.scored(odd, labels).count() == odd.count()
    assert toxicity.scored(empty, labels).count() == 0
    assert toxicity.scored(odd, labels.limit(0)).agg(F.max("score")).first()[0] == 0


def test_kernel_against_definition():
    def direct(s, t):
        def feature(w):
            out = collections.Counter()
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, len(w)):
                        out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        a, b = feature(s), feature(t)
        return sum(a[x] * b[x] for x in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    landmarks = ["idiot", "worthless", "stupid", "pathetic", "moron", "loser"]
    kernel = toxicity.Kernel(landmarks)
    rng = random.Random(4)
    words = ["stup", "idiot", "id1ot", "worthlesss", "éidiot", "ab", "aaaa", "漢字漢字", "moronmoronmoronmoro"]
    for w in landmarks:
        for _ in range(120):
            x = list(w)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é", w[0], rng.choice("aeiorst")])
            words.append("".join(x))
    words = [w for w in words if len(w) > 2]
    for w, found in zip(words, kernel.near(words)):
        want = {k: direct(w, x) for k, x in enumerate(landmarks)}
        want = {k: v for k, v in want.items() if v >= toxicity.FLOOR + 1e-5}  # none of them may be lost
        assert set(want) <= set(found), w
        for k, v in found.items():
            assert v == pytest.approx(direct(w, landmarks[k]), rel=1e-4)
    assert kernel.near(["idiot"])[0][0] == pytest.approx(1)


def test_language_model(spark, odd, empty):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "Zebra"]) for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit("clash"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = attention_lm.scored(df, path).collect()
    counts, end = collections.Counter(), object()
    part = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10
    for d, t in rows:
        if part(d):
            counts.update((t or "").encode().lower().split())
            counts[end] += 1
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), end]
        want[d, part(d) == 0, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert attention_lm.scored(empty, path).count() == 0


def test_model_learns_from_all_documents(spark, monkeypatch):
    path, end = public_tokenizers.path("byte_bpe_50k.json"), 50256
    texts = [f"the cat number{'abcdefgh'[k % 8]}{'klmnopqrst'[k // 8]} sat thereabouts and wondered" for k in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = attention_lm.Words(path)
    sequences = [words.subwords(words.codes([attention_lm.split_words(t)])[0]) for t in texts]
    want, pairs = np.zeros(end + 1), collections.Counter()
    for ids, per in sequences:
        want += np.bincount(ids, minlength=end + 1)
        of = np.repeat(np.arange(len(per)), per)
        pairs.update((int(a), int(b)) for a, b, x, y in zip(ids, ids[1:], of, of[1:]) if x == y)
    got, (a, b, n) = attention_lm.id_statistics(attention_lm.word_counts(df), path, end)
    np.testing.assert_array_equal(got, want)
    found = dict(zip(zip(a.tolist(), b.tolist()), n.tolist()))
    common = set(np.argsort(-want, kind="stable")[: attention_lm.CLASSES].tolist())
    assert found and all(pairs[k] == v for k, v in found.items())
    assert {k for k in pairs if k[1] not in common} <= set(found)
    monkeypatch.setattr(attention_lm, "SAMPLE", 8)
    seen = []
    plain = attention_lm.trained
    monkeypatch.setattr(attention_lm, "trained", lambda *x: seen.append(plain(*x)))
    attention_lm.scored(df, path)
    train = [len(ids) + 1 for k, (ids, _) in enumerate(sequences) if zlib.crc32(str(k).encode()) % 10]
    assert seen == [sum(train)]


def test_probabilities_add_up_and_windows_agree():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, 600).astype(float)
    begins = np.arange(600) % 2 == 0
    sequences = [rng.integers(0, 600, rng.integers(1, 90)).astype(np.uint16) for _ in range(40)]
    flat = np.concatenate(sequences).astype(np.int64)
    model = attention_lm.fit(sequences, counts, 599, begins, (flat[:-1], flat[1:], np.ones(len(flat) - 1)))
    one = np.array([5, 9, 17, 200], dtype=np.uint16)
    mass = sum(10 ** (model.score([np.append(one, np.uint16(k))])[0] - model.score([one])[0]) for k in range(600))
    assert mass == pytest.approx(1, abs=1e-3)
    together = model.score(sequences)
    np.testing.assert_allclose(together, [model.score([s])[0] for s in sequences], rtol=1e-4)


def test_gradients():
    rng = np.random.default_rng(2)
    w = {k: rng.standard_normal(s).astype(np.float64) * 0.3 for k, s in (("E", (attention_lm.INPUTS, attention_lm.WIDTH)), ("P", (2 * attention_lm.BLOCK, attention_lm.WIDTH)), ("Q", (16, 16)), ("K", (16, 16)), ("V", (16, 16)), ("O", (16, attention_lm.CLASSES)), ("b", (attention_lm.CLASSES,)))}
    before, own = rng.integers(0, 20, (2, 3, attention_lm.BLOCK))
    goal, valid, first = rng.integers(0, attention_lm.CLASSES, own.shape), rng.random(own.shape) < 0.8, np.array([True, False, False])

    def loss():
        x = w["E"][np.concatenate([before, own], axis=1)] + w["P"]
        q, k, v = x[:, 16:] @ w["Q"] / 4, x @ w["K"], x @ w["V"]
        s = q @ k.transpose(0, 2, 1) + np.where(np.arange(32)[None] <= np.arange(16)[:, None] + 16, 0, -1e9)
        s[first, :, :16] = -1e9
        a = np.exp(s - s.max(2, keepdims=True))
        a /= a.sum(2, keepdims=True)
        z = (x[:, 16:] + a @ v) @ w["O"] + w["b"]
        p = np.log(np.exp(z).sum(2)) - np.take_along_axis(z, goal[..., None], 2)[..., 0]
        return (p * valid).sum() / valid.sum()

    slopes = attention_lm._slopes(w, before, own, goal, valid, first)
    for name in w:
        at = tuple(rng.integers(0, min(n, 16)) for n in w[name].shape)
        if name == "E":
            at = (int(own[1, 3]), 4)
        old = w[name][at]
        w[name][at] = old + 1e-5
        up = loss()
        w[name][at] = old - 1e-5
        down = loss()
        w[name][at] = old
        assert slopes[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_weights_start_from_some_documents_at_every_size():
    assert [attention_lm._drawn(n) for n in (0, 1, 1200, 12_000, 10**10, 10**15)] == [1_000_000, 1_000_000, 1_000_000, 100_000, 1, 1]


def test_pairs_that_share_a_slot_keep_their_probability(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"zq{'abcdefgh'[(k * j) % 8]}xv{'klmnopqrst'[(k + j) % 10]}kj" for j in range(1, 9)) for k in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (60, None), (61, "")], "doc_id long, text string").repartition(3)
    score = lambda: {r["doc_id"]: r["score"] for r in attention_lm.scored(df, path).collect()}
    want = score()
    monkeypatch.setattr(attention_lm, "_SLOTS", 2)
    got = score()
    assert got.keys() == want.keys() and len(got) == 62
    assert all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_texts_are_encoded_once(spark):
    path, end = public_tokenizers.path("byte_bpe_50k.json"), 50256
    texts = [f"The cat number{'abcdefgh'[k % 8]} sat thereabouts, wondéred {k}" for k in range(40)] + ["", " \n", "word " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.lit(False)).repartition(3)
    words = attention_lm.Words(path)
    hot = np.sort(words.hash[words.codes([[b"cat", b"word"]])[0]])
    rows = attention_lm.encoded(docs.select("doc_id", "held_out", "text"), path, end, hot, np.array([5.0, 5.0]))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert len({r["row"] for r in got.values()}) == len(texts)
    for k, t in enumerate(texts):
        own = attention_lm.split_words(t)
        codes = words.codes([own])[0]
        assert np.frombuffer(got[k]["ids"], "<u2").tolist() == [*words.subwords(codes)[0].tolist(), end]
        known = sum(w in (b"cat", b"word") for w in own)
        assert (got[k]["n_tokens"], got[k]["known"], len(got[k]["tail"])) == (len(own) + 1, known, len(own) - known)
        assert got[k]["value"] == pytest.approx(known * math.log10(5.1))
    flat = np.concatenate([np.frombuffer(r["ids"], "<u2") for r in got.values()]).astype(np.int64)
    counts = np.bincount(flat, minlength=end + 1).astype(float)
    model = attention_lm.fit([flat], counts, end, np.arange(end + 1) % 2 == 0, (flat[:-1], flat[1:], np.ones(len(flat) - 1)))
    before = model.score([flat])[0]
    assert attention_lm.trained(model, rows.select("doc_id", "ids")) == len(flat)  # ids alone, no texts
    assert np.isfinite(model.score([flat])[0]) and model.score([flat])[0] != before


def test_large_scores_and_logits(monkeypatch):
    rng = np.random.default_rng(5)
    w = {k: (rng.standard_normal(s) * x).astype(np.float32) for k, s, x in (("E", (attention_lm.INPUTS, 16), 1.5), ("P", (32, 16), 1.0), ("Q", (16, 16), 1.5), ("K", (16, 16), 1.5), ("V", (16, 16), 0.5), ("O", (16, attention_lm.CLASSES), 5.0), ("b", (attention_lm.CLASSES,), 0.1))}
    before, own = rng.integers(0, 20, (2, 3, attention_lm.BLOCK))
    goal, valid, first = rng.integers(0, attention_lm.CLASSES, own.shape), np.ones(own.shape, dtype=bool), np.array([True, False, False])
    large = attention_lm._slopes(w, before, own, goal, valid, first)
    want = attention_lm._slopes({k: x.astype(np.float64) for k, x in w.items()}, before, own, goal, valid, first)
    for k, x in want.items():
        assert np.isfinite(large[k]).all()
        np.testing.assert_allclose(large[k], x, atol=0.02 * np.abs(x).max())
