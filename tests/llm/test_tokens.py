import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mossgrid.llm import bpe, packing, token_planes
from mossgrid.llm.shared import shared_dir

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


def plain(kind, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(FILES[kind]))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_units_equal_whole_texts(kind):
    rng = random.Random(5)
    texts = ["", " ", "  a", "a  b\n\nc", "it's don't, x.", "\u0000x \u0000y", "Éa ñb ΑΣ ǅ İ", "<|endoftext|> hi", "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>.", "it's*** 'll é́! ñ̃* İ, İx### 漢字。", "CAPS!!! (856) l'été,$$$"]
    texts += ["".join(rng.choice(" \n\tab'1.,é́\u0000　SÀ") for _ in range(40)) for _ in range(400)]
    got = bpe.encoder(public_tokenizers.path(FILES[kind]), kind).encode(texts, 7)
    t = Tokenizer.from_file(public_tokenizers.path(FILES[kind]))
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 7], repr(text)


def test_forgetting_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PASSING", 7)
    e = bpe.UnitEncoder(public_tokenizers.path(FILES["word"]), "word")
    texts = [f"alpha beta {k} gamma{k}, delta." for k in range(50)] + [" ".join(f"q{k}" for k in range(40))]
    for text, ids in zip(texts, e.encode(texts, 2)):
        assert np.frombuffer(ids, "<u4").tolist() == plain("word", text, 2)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.booleans())
def test_planes_round_trip(ids, bits):
    x = np.array(ids, dtype=np.uint32)
    assert token_planes.from_planes(token_planes.to_planes(x, bits), len(x)).tolist() == ids


def test_crc_join():
    rng = random.Random(1)
    for n in (0, 4, 400, 70_000):
        a, b = rng.randbytes(37), rng.randbytes(n)
        assert token_planes.crc32_join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


@pytest.mark.parametrize("bits", [False, True])
def test_token_planes(spark, odd, bits):
    path = shared_dir(spark, "test")
    token_planes.write_token_planes(odd, path, public_tokenizers.path(FILES["byte"]), bits=bits, block=64)
    got = token_planes.read_token_planes(spark, path).collect()
    want = sorted((plain("byte", r["text"], 0) for r in odd.collect()), key=len)
    assert sorted(r["n_tokens"] for r in got) == [len(x) for x in want]
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in want)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0, *[r["n_tokens"] for r in order]])[:-1].tolist()
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert [r["start"] for r in index] == np.cumsum([0, *[r["n_ids"] for r in index]])[:-1].tolist()


def test_token_planes_empty(spark, empty):
    path = shared_dir(spark, "test")
    token_planes.write_token_planes(empty, path, public_tokenizers.path(FILES["byte"]))
    assert token_planes.read_token_planes(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    room, want = [], []
    for n in lengths:
        b = next((k for k, r in enumerate(room) if r >= n), None)
        if b is None:
            room.append(50)
            b = len(room) - 1
        want.append((b, 50 - room[b]))
        room[b] -= n
    assert packing.first_fit_decreasing(lengths, 50) == want


def test_packing(spark, odd, empty):
    path = public_tokenizers.path(FILES["word"])
    rows = packing.packed(odd, path, size=128).collect()
    docs = [plain("word", r["text"], 2) for r in odd.collect()]
    assert sum(r["length"] for r in rows) == sum(map(len, docs))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
        assert sum(n for _, n in own) <= 128
    five = sorted((r for r in rows if r["doc_id"] == 5), key=lambda r: r["start"])
    ids = next(plain("word", r["text"], 2) for r in odd.collect() if r["doc_id"] == 5)
    assert [r["ids_crc32"] for r in five] == [zlib.crc32(np.array(ids[k : k + 128], "<u4").tobytes()) for k in range(0, len(ids), 128)]
    assert packing.packed(empty, path).count() == 0


def test_repeated_rows_are_spread(spark):
    df = spark.range(6000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    path = shared_dir(spark, "test")
    token_planes.write_token_planes(df, path, public_tokenizers.path(FILES["byte"]))
    shards = token_planes.read_token_planes(spark, path).groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == 6000 and max(r["count"] for r in shards) < 3000
    cut = packing.pieces(df, public_tokenizers.path(FILES["word"]))
    groups = packing.pack(cut, 6000, group=500).selectExpr("shiftright(sequence_id, 32) as g").groupBy("g").count().collect()
    assert len(groups) == 12 and max(r["count"] for r in groups) < 1000
