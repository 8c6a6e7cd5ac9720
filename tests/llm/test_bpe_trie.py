import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mossgrid.llm import bpe_trie

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def trie():
    return bpe_trie.TrieTokenizer(FILE)


def ids_of(trie, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in trie.ids_of(texts)]


def test_equals_library(trie, library):
    rng = random.Random(5)
    texts = ["", " ", "  a", "a  b\n\nc", "it's don't, x.", "\u0000x \u0000y", "Éa ñb ΑΣ ǅ İ", "<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "a" * 300, "-" * 70 + "====", " " * 50 + "x", "\t\r\n x y"]
    texts += ["".join(rng.choice(" \n\tab'1.,é́\u0000　SÀ漢🙂") for _ in range(40)) for _ in range(500)]
    texts += ["".join(rng.choice("abcdethinor ") for _ in range(200)) for _ in range(300)]
    texts += ["".join(rng.choice("ab") for _ in range(60)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD000), rng.randrange(0x1F300, 0x1FA00)])) for _ in range(60)) for _ in range(300)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(trie, texts) == want
    assert ids_of(trie, texts[::-1]) == want[::-1]  # with all prefixes known


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    trie = bpe_trie._worker(FILE)
    assert ids_of(trie, [text])[0] == trie.tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_does_not_change_ids(monkeypatch, library):
    for name in ("NODES", "WORDS", "PAIRS"):
        monkeypatch.setattr(bpe_trie, name, 7)
    trie = bpe_trie.TrieTokenizer(FILE)
    texts = [f"alpha beta {k} gamma{k}, deltas gammas." for k in range(60)]
    assert ids_of(trie, texts) == [library.encode(x).ids for x in texts]


def test_shared_prefixes_are_worked_out_once(library):
    trie = bpe_trie.TrieTokenizer(FILE)
    trie.encode_words(["restless", "restlessness", "rest", "resting"])
    assert len(trie.last) == 1 + len("restlessness") + len("ing")


def test_other_vocabularies_raise():
    with pytest.raises(ValueError):
        bpe_trie.TrieTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(2)
    lists = [[], None, [50256, 0, 50256], [255, 254], [-1, 90_000, 64]] + [[rng.randrange(50257) for _ in range(30)] for _ in range(60)]
    got = bpe_trie.decoded(spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>"), FILE)
    want = {k: library.decode([i for i in x or [] if i in range(50257)], skip_special_tokens=False) for k, x in enumerate(lists)}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_rows(spark, odd, empty, library):
    got = bpe_trie.encoded(odd, FILE)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got.collect()) == sorted((r["doc_id"] or 0, library.encode(r["text"] or "").ids) for r in odd.collect())
    both = bpe_trie.there_and_back(odd, FILE)
    assert both.exceptAll(bpe_trie.decoded(got, FILE)).count() == 0
    assert sorted(r["text"] for r in both.collect()) == sorted(r["text"] or "" for r in odd.collect())
    assert bpe_trie.encoded(empty, FILE).count() == bpe_trie.there_and_back(empty, FILE).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = bpe_trie.query(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(docs) == got.count()
