"""Byte-pair encoding and decoding of whole texts by a trie of words whose prefixes share work.

For every prefix of a word the last token of its encoding is a fixed one: the token that ends
there and that stays apart from the last token of what is before it. So each node of a trie
of words holds one number, the last token of the prefix that it stands for, and a word's
encoding is read from its node backwards. Distinct words are put into the trie in ascending
order, which creates nodes depth first; a prefix that several words share is worked out once.

Two tokens stay apart where undoing the merges that made them, the latest first, never shows
a pair at the boundary that merges before the two pieces are used up (of equal merges the one
further left comes first).

Texts are cut at added tokens of the vocabulary, then into units (see ``bpe``), then into
words by the vocabulary's own rule. Python workers remember units, words and nodes up to
fixed numbers; nothing is shuffled, and a task holds a slice of documents at a time.

Vocabularies are byte level ones without normalizer, whose every token but the bytes is made
by one merge, in the order of the list; others raise.

Nulls and ties: a null text is empty and gives no ids; a null array of ids decodes to an empty
text, ids outside the vocabulary to nothing, bytes that are no UTF-8 to replacement characters.
Every row is encoded by itself, so rows that share an id or a text stay as they are. An empty
table gives an empty one. Columns besides id and text (or ids) are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import of_worker, read, text_or_empty

#: Nodes, words and pairs that a worker keeps before it starts anew, and documents of a slice.
NODES, WORDS, PAIRS, SLICE = 1_000_000, 400_000, 500_000, 256
_NONE = -1


class TrieTokenizer(bpe.UnitEncoder):
    """Maps a unit to its ids as bytes, as its parent does, without asking the library for any."""

    def __init__(self, path: str):
        super().__init__(path, "byte")
        spec = json.loads(self.tokenizer.to_str())
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and cut == cut | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        tokens = {x["content"]: x for x in spec["added_tokens"]}
        if not plain or odd or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in tokens.values()):
            raise ValueError("a byte level vocabulary without normalizer and options is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.lengths = {i: len(x) for x, i in self.ids.items()}
        #: tokens, and what tokens begin with
        self.begins = {x[:n]: _NONE for x in self.ids for n in range(1, len(x))} | self.ids
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = dict.fromkeys(self.ids.values(), _NONE)
        self.merge: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(model["merges"]):
            left, right = (self.ids[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.ids["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            if made in self.parts or max(self.rank[left], self.rank[right]) >= k:
                raise ValueError("every token needs one merge, after those of its parts")
            self.parts[made], self.rank[made], self.merge[left, right] = (left, right), k, k
        if sum(len(x) == 1 for x in self.ids) + len(self.parts) != len(self.ids):
            raise ValueError("every token but the bytes must be made by a merge")
        self.special = {x: t["id"] for x, t in tokens.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(tokens, key=len, reverse=True)))) if tokens else None
        self.added = self.added_in_any_case = []  # encode() has cut them out already
        self.apart: dict[tuple[int, int], bool] = {}
        self.child: dict[int, int] = {}
        self.last, self.first = [_NONE], [0]  # by node: last token, first place where it or a longer one may begin
        self.words: dict[str, bytes] = {}
        letters = {chr(c): b for b, c in bpe._LETTERS.items()} | {chr(b): b for b in bpe._PRINTABLE}
        named = {i: x for x, i in self.ids.items()} | {i: x for x, i in self.special.items()}
        text = [named.get(i, "") for i in range(max(named) + 1)] + [""]
        self.pieces = pa.array([bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in text], pa.binary())

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens in a row are what encoding their text gives."""
        used_up = len(self.merge) + 1  # merges below this number come first
        while True:
            if self.merge.get((left, right), used_up) < used_up:
                return False
            made_left, made_right = self.rank[left], self.rank[right]
            if made_left > made_right:
                used_up, left = made_left, self.parts[left][1]
            elif made_right > _NONE:
                used_up, right = made_right + 1, self.parts[right][0]
            else:
                return True

    def insert(self, word: str) -> list[int]:
        """Put a word into the trie; the last tokens of its prefixes, the empty one first."""
        node, path, child, nodes, known, apart = 0, [_NONE], self.child, self.last, self.begins, self.apart
        for end, letter in enumerate(word, 1):
            at = node * 512 + ord(letter)  # letters that stand for bytes are below 512
            before, node = node, child.get(at, 0)
            if not node:
                node = child[at] = len(nodes)
                begin = self.first[before]  # no token begins further left and reaches this far
                while (token := known.get(word[begin:end])) is None:
                    begin += 1
                self.first.append(begin)
                while True:
                    if token is not None and token != _NONE:
                        if not begin:
                            break
                        pair = (path[begin], token)
                        fits = apart.get(pair)
                        if fits is None:
                            fits = apart[pair] = self.stay_apart(*pair)
                        if fits:
                            break
                    begin += 1
                    token = known.get(word[begin:end])
                nodes.append(token)
            path.append(nodes[node])
        return path

    def encode_words(self, words: Iterable[str]) -> None:
        """Remember the ids of words, written in the letters that stand for bytes."""
        lengths = self.lengths
        for word in sorted({w for w in words if w not in self.words}):
            if len(self.last) > NODES:
                self.child, self.last, self.first = {}, [_NONE], [0]
            if len(self.apart) > PAIRS:
                self.apart.clear()
            path, at, out = self.insert(word), len(word), []
            while at:
                out.append(path[at])
                at -= lengths[path[at]]
            out.reverse()
            self.words[word] = array("I", out).tobytes()

    def words_of(self, unit: str) -> list[str]:
        """A unit's words in the letters that stand for bytes."""
        raw = self.raw(unit)
        if unit.isalpha():
            return [bpe._SPACE + (unit if unit.isascii() else bpe._in_bytes(unit))]
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(raw)]

    def learn(self, units: Iterable[str]) -> None:
        if len(self.passing) > bpe.PASSING:
            for u in self.passing:
                self.pop(u, None)
            self.passing = []
        if len(self.words) > WORDS:
            self.words.clear()
        made = [(u, self.words_of(u)) for u in dict.fromkeys(units) if u not in self]
        self.encode_words(w for _, words in made for w in words)
        for u, words in made:
            self[u] = self.words[words[0]] if len(words) == 1 else b"".join(map(self.words.__getitem__, words))
        if len(self) > bpe.REMEMBERED:
            self.passing += [u for u, _ in made]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        if self.cut is None or not any(x in t for t in texts for x in self.special):
            return [x[:-4] for x in self.encode(texts, 0)]
        out = []
        for text in texts:
            marks = [np.asarray([self.special[m.group()]], dtype="<u4").tobytes() for m in self.cut.finditer(text)]
            between = [x[:-4] for x in self.encode(self.cut.split(text), 0)]
            out.append(between[0] + b"".join(m + x for m, x in zip(marks, between[1:])))
        return out

    def texts_of(self, ids: pa.Array) -> list[str]:
        """The text of each list of ids."""
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        known = len(self.pieces) - 1
        flat = np.where((flat >= 0) & (flat < known), flat, known)[offsets[0] : offsets[-1]]
        pieces = self.pieces.take(pa.array(flat))
        ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset)[offsets - offsets[0]].tolist()
        data = memoryview(pieces.buffers()[2] or b"")
        return [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _worker(path: str) -> TrieTokenizer:
    return of_worker(("trie", path), lambda: TrieTokenizer(path))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _ids(docs: DataFrame, tokenizer: str, id_col: str, text: str, back: bool) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(tokenizer)
        for part in _slices(batches):
            ids = worker.ids_of(part.column(1).to_pylist())
            ends = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            texts = [pa.array(worker.texts_of(lists), pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([part.column(0), lists, *texts], names=["doc_id", "ids", "text"][: 2 + back])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(step, "doc_id long, ids array<int>" + ", text string" * back)


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (in order) of every whole text."""
    return _ids(docs, tokenizer, id_col, text, back=False)


def there_and_back(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``decoded(encoded(...))`` in one pass: doc_id, ids and the text that they decode to."""
    return _ids(docs, tokenizer, id_col, text, back=True)


def decoded(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, ids and the text that the ids stand for, special tokens included."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = _worker(tokenizer).texts_of
        for part in _slices(batches):
            texts = pa.array(texts_of(part.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["doc_id", "ids", "text"])

    known = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.transform(known, lambda x: F.coalesce(x, F.lit(_NONE))).alias("ids"))
    return rows.mapInArrow(step, "doc_id long, ids array<int>, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = there_and_back(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
