"""Language-model scoring by a small causal self-attention model in numpy.

Tokens are subword ids: each lower-cased word is encoded by a public byte-level vocabulary
with a space before it, and an end id closes the text. One attention layer (one head, a
residual path) predicts the class of the next id; the ``CLASSES - 2`` most frequent ids are
classes of their own, the others that begin a word share one class and those that continue a
word another. In the former an id has its smoothed frequency, in the latter its frequency
after the id before it, backed off to the former; the probabilities of all ids add up to 1. A context window is a block of ``BLOCK`` ids and the
block before it; windows overlap by half and each id is scored once, by the window whose
newer half holds it, for many windows at a time with masked attention.

The corpus statistics cover all training documents: word counts are summed exactly over the
cluster (they grow with the input), and each distinct word is encoded once, with its exact
count, for the counts of ids and of pairs inside words. The ``HOT`` most frequent words go to the executors with
their counts (a fixed bound); for other words each document's rows are joined to the counts
by a shuffle. Texts are encoded once: their ids are staged (two bytes each), and training and scoring read those. Pairs of ids likewise: the most frequent of each of 2^20 slots goes to the
executors, the others are joined to the documents that hold them. The attention weights start from a fit on at most ``SAMPLE`` training documents;
then every training document is a part of one of ``ROUNDS`` rounds, in which each task goes on
from the same weights over its documents and the weights are averaged, by ids seen.

Nulls and ties: a null text is empty and has the end token alone. A null id counts as the
empty string for the split. Rows are scored one by one, repeated rows alike and also counted
repeatedly. Without training documents N and V are 0 and base_score is the sum of
log10(0.1/0.1) = 0. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import of_worker, read, staged, text_or_empty

CLASSES = 48
INPUTS = 1024
WIDTH = 16
BLOCK = 16
#: Blocks that are scored at a time: what is made for them stays in a core's cache.
_SCORED = 128
#: What each place of a block sees of the block before it and of its own.
_SEEN = (np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK).astype(np.float32)
#: Words whose counts every executor holds (16 bytes each, and a remembered encoding).
HOT = 1 << 18
#: Documents that the attention weights start from, about, and ids of them at most.
SAMPLE, SAMPLE_IDS = 1200, 600_000
#: Parts of all training documents, after each of which the tasks' weights are averaged, and
#: the step of the first of them.
ROUNDS, STEP = 4, 0.004
#: Words that a worker remembers for good, and with those that it remembers for a while.
CORE, REMEMBERED = 450_000, 700_000


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


class Words(dict):
    """Word to code; arrays by code hold its hash and subword ids."""

    def __init__(self, path: str):
        super().__init__()
        self.encoder = bpe.UnitEncoder(path, "byte", ordinary=True)
        self.order: list[bytes] = []
        self.forgotten = 0  # how often words were
        self.figures, self.figured, self.figures_of = np.zeros(0), 0, None
        self.hash = np.zeros(REMEMBERED + 1, dtype=np.uint64)
        self.start = np.zeros(REMEMBERED + 2, dtype=np.int64)
        self.ids = np.zeros(8 * REMEMBERED, dtype=np.uint16)

    def learn(self, words: list[bytes]) -> None:
        import xxhash

        words = list(dict.fromkeys(words))
        if len(self.order) + len(words) > REMEMBERED:
            keep = CORE if len(self.order) > CORE and CORE + len(words) <= REMEMBERED else 0
            self.forgotten += 1
            for w in self.order[keep:]:
                del self[w]
            del self.order[keep:]
        units = [w.decode("utf-8", "replace") for w in words]
        self.encoder.learn(units)
        raw = list(map(self.encoder.__getitem__, units))
        first, n = len(self.order), len(words)
        ends = int(self.start[first]) + np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=n) // 4)
        ids = np.frombuffer(b"".join(raw), "<u4")
        if n and ends[-1] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), len(ids)), dtype=np.uint16))
        self.ids[self.start[first] : self.start[first] + len(ids)] = ids
        self.start[first + 1 : first + 1 + n] = ends
        self.hash[first : first + n] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
        self.update(zip(words, range(first, first + n)))
        self.order += words
        self.encoder.clear()
        self.encoder.passing = []

    def codes(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Codes of the words of some texts (of REMEMBERED - CORE distinct words at most)."""
        found = [list(map(self.get, t)) for t in texts]
        gaps = [[k for k, x in enumerate(own) if x is None] if None in own else [] for own in found]
        unknown = [t[k] for t, own in zip(texts, gaps) for k in own]
        if unknown:
            kept = self.forgotten
            self.learn(unknown)
            if self.forgotten != kept:
                self.learn([w for t in texts for w in t if w not in self])
                return [np.fromiter(map(self.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]
            for t, own, missing in zip(texts, found, gaps):
                for k in missing:
                    own[k] = self[t[k]]
        return [np.array(own, dtype=np.int64) for own in found]

    def figures_by_code(self, key: str, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """What ``of`` gives for the hashes of all known words; asked once for a word, as long as
        ``key`` is the same."""
        if self.figures_of != (key, self.forgotten):
            self.figures, self.figured, self.figures_of = np.zeros(REMEMBERED + 1), 0, (key, self.forgotten)
        lo, hi = self.figured, len(self.order)
        if hi > lo:
            self.figures[lo:hi], self.figured = of(self.hash[lo:hi]), hi
        return self.figures

    def subwords(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each word has."""
        n = self.start[codes + 1] - self.start[codes]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[codes] - (ends - n), n)
        return self.ids[at], n


@dataclass
class Model:
    """Weights, the classes of ids and the log10 probability of an id in its class."""

    end: int
    input_of: np.ndarray
    class_of: np.ndarray
    inside: np.ndarray
    weights: dict[str, np.ndarray]
    back: np.ndarray  # by the id before: log10 of what the pairs leave to single frequencies
    pair_key: np.ndarray
    pair_log: np.ndarray
    crowded: np.ndarray  # slots that several pairs share; all but one of them are looked up by a join

    def missed(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Of each sequence the pairs that ``_inside`` scores by the back-off, though a pair of
        their slot may have been left out there."""
        n = np.array([len(s) for s in sequences], dtype=np.int64)
        b = np.concatenate(sequences).astype(np.int64)
        a = np.append(self.end, b[:-1])
        a[np.cumsum(n) - n] = self.end
        rest = np.flatnonzero(self.class_of[b] == CLASSES - 1)
        key = (a[rest] << 16) | b[rest]
        slot = _slot(key, len(self.pair_key))
        out = self.crowded[slot] & (self.pair_key[slot] != key)
        return np.split(key[out], np.searchsorted(rest[out], np.cumsum(n)[:-1]))

    def _inside(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 probability of ids in their classes."""
        out = self.inside[ids]
        rest = np.nonzero(self.class_of[ids] == CLASSES - 1)
        a, b = before[rest], ids[rest]
        key = (a << 16) | b
        slot = _slot(key, len(self.pair_key))
        out[rest] = np.where(self.pair_key[slot] == key, self.pair_log[slot], out[rest] + self.back[a])
        return out

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of ids (each with its end id)."""
        out = np.zeros(len(sequences))
        lo = 0
        while lo < len(sequences):
            hi, n = lo, 0
            while hi < len(sequences) and (n == 0 or n + len(sequences[hi]) <= 400_000):
                n += len(sequences[hi])
                hi += 1
            out[lo:hi] = self._score(sequences[lo:hi])
            lo = hi
        return out

    def _score(self, sequences: list[np.ndarray]) -> np.ndarray:
        inputs, targets, first, owner = blocked(sequences, self.end)
        w = self.weights
        meet = w["Q"] @ w["K"].T * np.float32(WIDTH**-0.5)  # q k' is (x Q K') x', and a v is (a x) V
        valid, targets = targets >= 0, np.maximum(targets, 0)
        code, goal = self.input_of[inputs], self.class_of[targets]
        total = np.empty(len(inputs))
        ones, some = np.ones(2 * BLOCK, dtype=np.float32), np.ones(CLASSES, dtype=np.float32)
        for at in range(0, len(inputs), _SCORED):
            rows = slice(at, min(at + _SCORED, len(inputs)))
            own = code[rows]
            both = np.concatenate([code[np.maximum(np.arange(rows.start, rows.stop) - 1, 0)], own], axis=1)
            x = np.take(w["E"], both, axis=0)
            x += w["P"]
            xo = x[:, BLOCK:].reshape(-1, WIDTH)
            scores = (xo @ meet).reshape(-1, BLOCK, WIDTH) @ x.transpose(0, 2, 1)
            _weigh(scores, first[rows])
            h = (scores @ x).reshape(-1, WIDTH) @ w["V"]
            h *= (1 / (scores.reshape(-1, 2 * BLOCK) @ ones))[:, None]
            h += xo
            z = h @ w["O"]
            z += w["b"]
            if _large(z):
                z -= z.max(axis=1, keepdims=True)
            picked = z[np.arange(len(z)), goal[rows].reshape(-1)]
            np.exp(z, out=z)
            logs = (picked - np.log(z @ some)).reshape(-1, BLOCK)
            total[rows] = np.where(valid[rows], logs, 0).sum(axis=1, dtype=np.float64)
        total *= 1 / np.log(10)
        total += np.where(valid, self._inside(inputs, targets), 0).sum(axis=1)
        return np.bincount(owner, total, minlength=len(sequences))


def blocked(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of inputs and targets (-1 beyond a sequence), whether a block is its sequence's
    first, and its sequence."""
    n = np.array([len(s) for s in sequences], dtype=np.int64)
    blocks = -(-n // BLOCK)
    owner = np.repeat(np.arange(len(sequences)), blocks)
    begin = (np.cumsum(blocks) - blocks) * BLOCK
    at = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    flat = np.concatenate(sequences).astype(np.int64)
    targets = np.full(int(blocks.sum()) * BLOCK, -1, dtype=np.int64)
    targets[at] = flat
    inputs = np.full(len(targets), end, dtype=np.int64)
    inputs[1:] = np.maximum(targets[:-1], 0)
    inputs[begin] = end  # a text begins after an end
    first = np.zeros(int(blocks.sum()), dtype=bool)
    first[np.cumsum(blocks) - blocks] = True
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), first, owner


_SLOTS = 20
#: Weight of single frequencies against pairs, in pairs.
_BACK_OFF = 20.0


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return ((key * 2654435761) & 0xFFFFFFFF) >> (33 - slots.bit_length())


def fit(sequences: list[np.ndarray], id_counts: np.ndarray, end: int, begins: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], seed: int = 3, passes: int = 2, after: np.ndarray | None = None, crowded: np.ndarray | None = None) -> Model:
    """Fit the attention weights by Adam on blocks of the sequences. ``begins``: whether an
    id begins a word; ``pairs``: ids in a row inside words, and how often. Where these are not
    all pairs, ``after`` has the counts of all by their first id, ``crowded`` the slots of more
    than one."""
    order = np.argsort(-id_counts, kind="stable")
    input_of = np.full(len(id_counts), INPUTS - 1, dtype=np.int32)
    input_of[order[: INPUTS - 1]] = np.arange(min(INPUTS - 1, len(order)))
    class_of = np.where(begins, CLASSES - 2, CLASSES - 1).astype(np.int32)
    class_of[order[: CLASSES - 2]] = np.arange(min(CLASSES - 2, len(order)))
    inside = np.zeros(len(id_counts), dtype=np.float64)
    for kind in (CLASSES - 2, CLASSES - 1):
        rest = class_of == kind
        inside[rest] = np.log10((id_counts[rest] + 0.1) / (id_counts[rest] + 0.1).sum())
    a, b, n = (np.asarray(x) for x in pairs)
    some = class_of[b.astype(np.int64)] == CLASSES - 1
    key, at = np.unique((a[some].astype(np.int64) << 16) | b[some], return_inverse=True)
    n = np.bincount(at, n[some], minlength=len(key))
    pair_key, pair_n = np.full(1 << _SLOTS, -1, dtype=np.int64), np.zeros(1 << _SLOTS)
    rising = np.argsort(n, kind="stable")
    slot = _slot(key[rising], len(pair_key))
    pair_key[slot], pair_n[slot] = key[rising], n[rising]  # the most frequent of a slot stays
    if after is None:
        after = np.bincount(np.maximum(pair_key, 0) >> 16, pair_n, minlength=len(id_counts))
    if crowded is None:
        crowded = np.zeros(len(pair_key), dtype=bool)
    back = np.log10(_BACK_OFF / (after + _BACK_OFF))
    one = np.maximum(pair_key, 0)
    pair_log = np.log10((pair_n + _BACK_OFF * 10 ** inside[one & 0xFFFF]) / (after[one >> 16] + _BACK_OFF))
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(shape) * s).astype(np.float32) for k, shape, s in (("E", (INPUTS, WIDTH), 0.3), ("P", (2 * BLOCK, WIDTH), 0.1), ("Q", (WIDTH, WIDTH), 0.25), ("K", (WIDTH, WIDTH), 0.25), ("V", (WIDTH, WIDTH), 0.25), ("O", (WIDTH, CLASSES), 0.1), ("b", (CLASSES,), 0.0))}
    model = Model(end, input_of, class_of, inside, w, back, pair_key, pair_log, crowded)
    if not sequences:
        return model
    inputs, targets, first, _ = blocked(sequences, end)
    adam = Adam(w)
    total = passes * -(-len(inputs) // 256)
    for _ in range(passes):
        for at in np.array_split(rng.permutation(len(inputs)), max(1, len(inputs) // 256)):
            slopes = _slopes(adam.weights, input_of[inputs[np.maximum(at - 1, 0)]], input_of[inputs[at]], class_of[np.maximum(targets[at], 0)], targets[at] >= 0, first[at])
            adam.move(slopes, 0.02 * max(0.05, 1 - (adam.count + 1) / total))
    model.weights = adam.weights
    return model


class Adam:
    """Weights that move against their slopes; all of them lie in one array, ``flat``."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.flat = np.concatenate([x.ravel() for x in weights.values()])
        cuts = np.cumsum([x.size for x in weights.values()])[:-1]
        self.weights = {k: part.reshape(x.shape) for (k, x), part in zip(weights.items(), np.split(self.flat, cuts))}
        self.mean, self.square, self.count = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def move(self, slopes: dict[str, np.ndarray], rate: float) -> None:
        g = np.concatenate([slopes[k].ravel() for k in self.weights])
        self.count += 1
        self.mean += np.float32(0.1) * (g - self.mean)
        g *= g
        g -= self.square
        g *= np.float32(0.01)
        self.square += g
        np.multiply(self.square, np.float32(1 / (1 - 0.99**self.count)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.divide(self.mean, g, out=g)
        g *= np.float32(rate / (1 - 0.9**self.count))
        self.flat -= g


def _large(x: np.ndarray) -> bool:
    """Whether exponentials, or all of a row, may be beyond single precision."""
    return not (x.max() < 60 and x.min() > -60)


def _weigh(scores: np.ndarray, first: np.ndarray) -> None:
    """Exponentials of attention scores, up to a factor for each row; 0 at places not seen."""
    if _large(scores):
        scores += np.where(_SEEN > 0, 0, -1e9).astype(scores.dtype)
        scores[first, :, :BLOCK] = -1e9
        scores -= scores.max(axis=2, keepdims=True)
    np.exp(scores, out=scores)
    scores *= _SEEN
    scores[first, :, :BLOCK] = 0


def _slopes(w: dict, before: np.ndarray, own: np.ndarray, goal: np.ndarray, valid: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log likelihood of one batch of windows."""
    kind, n = w["E"].dtype, len(own)
    scale = kind.type(WIDTH**-0.5)
    both = np.concatenate([before, own], axis=1)
    x = np.take(w["E"], both, axis=0)
    x += w["P"]
    xo = x[:, BLOCK:].reshape(-1, WIDTH)
    # q k' is (xo Q K') x', and a v is (a x) V: keys and values need not be made
    meet = w["Q"] @ w["K"].T * scale
    left = np.empty((n, 2 * BLOCK, WIDTH), dtype=kind)  # xo Q K', and below it the slopes of a x
    q, dax = left[:, :BLOCK], left[:, BLOCK:]
    q[:] = (xo @ meet).reshape(q.shape)
    twice = np.empty((n, 2 * BLOCK, 2 * BLOCK), dtype=kind)  # slopes of scores, and attention
    ds, a = twice[:, :BLOCK], twice[:, BLOCK:]
    np.matmul(q, x.transpose(0, 2, 1), out=a)
    _weigh(a, first)
    a *= 1 / (a @ np.ones((2 * BLOCK, 1), dtype=kind))
    ax = (a @ x).reshape(-1, WIDTH)
    h = ax @ w["V"]
    h += xo
    p = h @ w["O"]
    p += w["b"]
    if _large(p):
        p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    share = valid.reshape(-1) * kind.type(1 / max(1, valid.sum()))
    p *= (share / (p @ np.ones(CLASSES, dtype=kind)))[:, None]
    p[np.arange(len(p)), goal.reshape(-1)] -= share
    out = {"O": (p.T @ h).T, "b": np.ones(len(p), dtype=kind) @ p}
    dh = p @ w["O"].T
    out["V"] = (dh.T @ ax).T
    own_dax = dh @ w["V"].T
    dax[:] = own_dax.reshape(dax.shape)
    np.matmul(dax, x.transpose(0, 2, 1), out=ds)
    ds -= np.einsum("ij,ij->i", own_dax, ax).reshape(n, BLOCK, 1)
    ds *= a
    dq = (ds @ x).reshape(-1, WIDTH)
    dx = twice.transpose(0, 2, 1) @ left
    dh += dq @ meet.T
    dx[:, BLOCK:] += dh.reshape(n, BLOCK, WIDTH)
    dmeet = xo.T @ dq * scale
    out |= {"Q": dmeet @ w["K"], "K": dmeet.T @ w["Q"]}
    out["P"] = (np.ones(n, dtype=kind) @ dx.reshape(n, -1)).reshape(2 * BLOCK, WIDTH)
    ids, by_column = both.reshape(-1), np.ascontiguousarray(dx.reshape(-1, WIDTH).T)
    return out | {"E": np.stack([np.bincount(ids, c, minlength=INPUTS) for c in by_column], axis=1).astype(kind)}


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, word and n of every word of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(words, pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["hash", "word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split_words(text))
                if len(seen) > 1_000_000:
                    yield flush()
                    seen = Counter()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(count, "hash long, word binary, n long").groupBy("hash").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def _table(tokenizer: str) -> Words:
    return of_worker(("words", tokenizer), lambda: Words(tokenizer))


def counted_ids(counts: DataFrame, tokenizer: str) -> DataFrame:
    """key and n: how often each id (key -1 - id) and each pair of ids in a row inside a word
    (first id << 16 | second) is in all words of ``counts``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer)
        for batch in batches:
            names, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for k in range(0, len(names), 50_000):
                got, per = table.subwords(table.codes([names[k : k + 50_000]])[0])
                of = np.repeat(np.arange(len(per)), per)
                n = times[k : k + 50_000][of]
                inner = of[:-1] == of[1:]
                key = np.concatenate([-1 - got.astype(np.int64), (got[:-1].astype(np.int64) << 16 | got[1:])[inner]])
                key, at = np.unique(key, return_inverse=True)
                sums = np.zeros(len(key), dtype=np.int64)
                np.add.at(sums, at, np.concatenate([n, n[1:][inner]]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sums)], names=["key", "n"])

    return staged(counts.select("word", "n").mapInArrow(encode, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pairs")


@dataclass
class Statistics:
    """Figures of ids and pairs, each of a fixed greatest size, and the pairs beyond them."""

    id_counts: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]
    after: np.ndarray
    crowded: np.ndarray
    others: DataFrame  # key, n: pairs that are not the most frequent of their slot


def statistics(found: DataFrame, end: int, n_docs: int = 0) -> Statistics:
    """From ``counted_ids``: how often each id is there (the end id: ``n_docs``); of the pairs
    that share a slot the most frequent, those whose second id is not a class of its own; the
    counts of all such pairs by first id; and the other pairs of each slot."""
    id_counts, after, crowded = np.zeros(end + 1), np.zeros(end + 1), np.zeros(1 << _SLOTS, dtype=bool)
    single = found.where("key < 0").toArrow()  # a row per id of the vocabulary at most
    id_counts[-1 - single["key"].to_numpy()] = single["n"].to_numpy()
    id_counts[end] += n_docs
    own = np.argsort(-id_counts, kind="stable")[: CLASSES - 2].tolist()
    pairs = found.where("key >= 0").where(~F.col("key").bitwiseAND(F.lit(0xFFFF)).isin(own))
    sums = pairs.groupBy(F.shiftright("key", 16).alias("a")).agg(F.sum("n").alias("n")).toArrow()  # a row per id at most
    after[sums["a"].to_numpy()] = sums["n"].to_numpy()
    slot = F.shiftrightunsigned((F.col("key") * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - _SLOTS)
    slots = pairs.withColumn("slot", slot).groupBy("slot").agg(F.max(F.struct("n", "key")).alias("top"), F.count(F.lit(1)).alias("many"))
    slots = staged(slots.select("slot", "top.n", "top.key", "many"), "slots")
    best = slots.toArrow()  # a row per slot at most
    key = best["key"].to_numpy()
    crowded[best["slot"].to_numpy()[best["many"].to_numpy() > 1]] = True
    others = pairs.withColumn("slot", slot).join(slots.where("many > 1").select("slot", F.col("key").alias("top")), "slot").where("key <> top").select("key", "n")
    return Statistics(id_counts, (key >> 16, key & 0xFFFF, best["n"].to_numpy().astype(np.float64)), after, crowded, others)


def id_statistics(counts: DataFrame, tokenizer: str, end: int, n_docs: int = 0) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``statistics`` of ids and of the most frequent pair of each slot."""
    own = statistics(counted_ids(counts, tokenizer), end, n_docs)
    return own.id_counts, own.pairs


def gains(others: DataFrame, inside: np.ndarray) -> DataFrame:
    """key and gain: what the log10 probability of a pair that has no slot is above the back-off's."""

    def gain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.log10(1 + n / (_BACK_OFF * 10 ** inside[key & 0xFFFF])))], names=["key", "gain"])

    return others.mapInArrow(gain, "key long, gain double")


def trained(model: Model, training: DataFrame, rounds: int = ROUNDS, step: float = STEP) -> int:
    """Goes on with the weights of ``model`` over every training document (doc_id, ids as
    ``encoded`` has them); the number of ids, ends included, that they were trained on."""
    spark = training.sparkSession
    names = list(model.weights)
    end, total = model.end, 0
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((model.weights, model.input_of, model.class_of))  # fixed bounds
        rate = step * (1 - turn / rounds)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            start, input_of, class_of = shared.value
            adam, seen = Adam(start), 0

            def go_on(sequences: list[np.ndarray]) -> int:
                inputs, targets, first, _ = blocked(sequences, end)
                own, goal, valid = input_of[inputs], class_of[np.maximum(targets, 0)], targets >= 0
                for at in np.array_split(np.random.default_rng(adam.count).permutation(len(inputs)), max(1, len(inputs) // 256)):
                    adam.move(_slopes(adam.weights, own[np.maximum(at - 1, 0)], own[at], goal[at], valid[at], first[at]), rate)
                return sum(map(len, sequences))

            held, n = [], 0
            for batch in batches:
                for ids in _sequences(batch.column(0)):
                    for lo in range(0, len(ids), 200_000):  # a long text, a stretch at a time
                        held.append(ids[lo : lo + 200_000])
                        n += len(held[-1])
                        if n >= 100_000:
                            seen += go_on(held)
                            held, n = [], 0
            if n:
                seen += go_on(held)
            if seen:
                flat = adam.flat.astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat))), pa.array(np.append(float(seen), flat))], names=["at", "x"])

        part = training.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(rounds)) == turn).select("ids")
        sums = part.mapInArrow(learn, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # a row per weight
        shared.destroy()
        if not sums.num_rows:
            continue
        flat = np.zeros(sums.num_rows)
        flat[sums["at"].to_numpy() + 1] = sums["x"].to_numpy()
        seen, flat = flat[0], flat[1:] / flat[0]
        total += int(seen)
        for k in names:
            size = model.weights[k].size
            model.weights[k] = flat[:size].reshape(model.weights[k].shape).astype(np.float32)
            flat = flat[size:]
    return total


def _drawn(n_docs: int) -> int:
    """Millionths of the documents that the weights start from; never none of them."""
    return max(1, int(min(1.0, SAMPLE / max(1, n_docs)) * 1_000_000))


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


def encoded(own: DataFrame, tokenizer: str, end: int, hot_hash: np.ndarray, hot_n: np.ndarray) -> DataFrame:
    """Of each row of ``own`` (doc_id, held_out, text), staged: a number of its own (row), doc_id,
    held_out, n_chars, n_tokens, its ids and the end id (ids, two bytes each), how many of its
    words are among ``hot_hash`` (known, in order of hashes), the sum of what these add to the base score (value) and the
    hashes of the other words (tail)."""
    spark = own.sparkSession
    shared = spark.sparkContext.broadcast((hot_hash, np.log10(hot_n + 0.1)))  # fixed bounds
    key = uuid.uuid4().hex
    closing = np.array([end], dtype="<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_hash, hot_value = shared.value
        table = _table(tokenizer)

        def figures(hashes: np.ndarray) -> np.ndarray:
            if not len(hot_hash):
                return np.full(len(hashes), np.nan)
            place = np.minimum(np.searchsorted(hot_hash, hashes), len(hot_hash) - 1)
            return np.where(hot_hash[place] == hashes, hot_value[place], np.nan)

        def part(words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
            codes = table.codes(words)
            n = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
            flat, owner = np.concatenate(codes), np.repeat(np.arange(len(codes)), n)
            value = table.figures_by_code(key, figures)[flat]
            other = np.isnan(value)
            known = n - np.bincount(owner[other], minlength=len(n))
            tails = np.split(table.hash[flat[other]].view(np.int64), np.cumsum(n - known)[:-1])
            ids, per = table.subwords(flat)
            cuts = 2 * np.append(0, np.cumsum(per))[np.append(0, np.cumsum(n))]
            raw = ids.astype("<u2").tobytes()
            return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], known, np.bincount(owner, np.where(other, 0, value), minlength=len(n)), tails

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for k in range(0, len(texts), 128):
                cut = [split_words(x) for x in texts[k : k + 128]]
                if sum(map(len, cut)) <= REMEMBERED - CORE:
                    raw, known, value, tails = part(cut)
                else:  # a text at a time, a very long one by stretches
                    raw, known, value, tails = [], np.zeros(len(cut), dtype=np.int64), np.zeros(len(cut)), []
                    for i, own in enumerate(cut):
                        some = [part([own[lo : lo + REMEMBERED - CORE]]) for lo in range(0, max(1, len(own)), REMEMBERED - CORE)]
                        raw.append(b"".join(x[0][0] for x in some))
                        known[i], value[i] = sum(int(x[1][0]) for x in some), sum(float(x[2][0]) for x in some)
                        tails.append(np.concatenate([x[3][0] for x in some]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, len(cut)), batch.column(1).slice(k, len(cut)), pa.array([len(x) for x in texts[k : k + 128]]), pa.array([len(x) + 1 for x in cut]), pa.array([x + closing for x in raw], pa.binary()), pa.array(known), pa.array(value), pa.array(tails, pa.list_(pa.int64()))],
                    names=["doc_id", "held_out", "n_chars", "n_tokens", "ids", "known", "value", "tail"],
                )

    kind = dict(own.dtypes)["doc_id"]
    rows = own.select("doc_id", "held_out", "text").mapInArrow(encode, f"doc_id {kind}, held_out boolean, n_chars long, n_tokens long, ids binary, known long, value double, tail array<long>")
    out = staged(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")
    shared.destroy()
    return out


def scored(docs: DataFrame, tokenizer: str, end: int = 50256, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text).alias("text"))
    training = own.where("not held_out")
    counts = staged(word_counts(training), "counts")
    about = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_docs = training.count()
    n_tokens, n_kinds = (about["n"] or 0) + n_docs, about["v"] + (n_docs > 0)
    hot = counts.select("hash", "n").orderBy(F.desc("n"), "hash").limit(HOT).toArrow()
    hot_hash, hot_n = hot["hash"].to_numpy().view(np.uint64), hot["n"].to_numpy().astype(np.float64)
    at = np.argsort(hot_hash)
    hot_hash, hot_n = hot_hash[at], hot_n[at]
    floor = np.log10(n_tokens + 0.1 * (n_kinds + 1))

    texts = encoded(own, tokenizer, end, hot_hash, hot_n)
    learnt = texts.where("not held_out")
    # the sample that the weights start from; frequencies of ids and pairs are those of all words
    sequences, ids = [], 0
    for row in learnt.where("n_chars <= 100000").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < _drawn(n_docs)).select("ids").limit(2 * SAMPLE).toLocalIterator():
        if ids < SAMPLE_IDS:
            sequences.append(np.frombuffer(row["ids"], "<u2"))
            ids += len(sequences[-1]) - 1
    edge = bpe.UnitEncoder(tokenizer, "byte", ordinary=True).edge
    begins = np.append(edge, np.zeros(max(0, end + 1 - len(edge)), dtype=bool))[: end + 1]
    begins[end] = True
    known_ids = statistics(counted_ids(counts, tokenizer), end, n_docs)
    model = fit(sequences, known_ids.id_counts, end, begins, known_ids.pairs, after=known_ids.after, crowded=known_ids.crowded)
    trained(model, learnt)
    shared = spark.sparkContext.broadcast(model)  # fixed bounds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sequences = _sequences(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(model.score(sequences)), pa.array(model.missed(sequences), pa.list_(pa.int64()))],
                    names=[*part.schema.names[:-1], "score", "missed"],
                )

    kind = dict(own.dtypes)["doc_id"]
    rows = texts.select("row", "doc_id", "held_out", "n_tokens", "known", "value", "ids")
    rows = staged(rows.mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, value double, score double, missed array<long>"), "scores")
    shared.destroy()
    tail = texts.select("row", F.explode("tail").alias("hash")).join(counts.select("hash", "n"), "hash", "left")
    tail = tail.groupBy("row").agg(F.count("n").alias("tail_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1).cast("double"))).alias("tail_value"))
    missed = rows.select("row", F.explode("missed").alias("key")).join(gains(known_ids.others, model.inside), "key").groupBy("row").agg(F.sum("gain").alias("gain"))
    end_value = float(np.log10(n_docs + 0.1))
    out = rows.drop("missed").join(tail, "row", "left").join(missed, "row", "left")
    base = F.col("value") + F.coalesce("tail_value", F.lit(0.0)) + F.lit(end_value) - F.col("n_tokens") * F.lit(float(floor))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long").alias("n_known"), F.lit(int(n_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scored(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
