"""Toxicity by a subsequence string kernel and a support vector machine.

Words are compared by the gap-weighted kernel over all subsequences of three letters: each
common subsequence counts by ``DECAY`` to the power of the span it takes up, so letters put
in between or left out cost a little and an inflected or spelt-apart insult stays close to the
plain one. A sentence has, for each landmark word, the greatest normalised kernel of its words
(below ``FLOOR``: nothing); the Nyström map of the landmarks turns that into features of a
linear machine with squared hinge loss. A document's score is the calibrated decision of its
most toxic sentence.

Training uses a bounded sample of labelled documents (``SAMPLE`` of either label at most, by
a hash of the id, texts of at most ``SAMPLE_CHARS``) from rows whose crc32(doc_id as text)
mod 3 is not 1. Labels are of documents, so the toxic sentences of a toxic document are those
that hold a landmark itself, or else the one that is nearest to one.
Landmarks are the most telling words that are unlike each other. Scoring is one pass over all
whole texts without a shuffle; workers remember which words are near a landmark.

Nulls and ties: a null or empty text gets the score of a text without any telling word. A
null id counts as the empty string for the split. Rows are scored one by one, repeated rows
alike. A label that is null or missing is not used; of two labels for an id the greater
counts. Without both labels in the sample every score is 0. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import of_worker, read

SAMPLE = 2500
SAMPLE_CHARS = 50_000
LANDMARKS = 64
DECAY = 0.7
FLOOR = 0.45
#: Letters of a unit; longer strings are cut into overlapping units.
LONGEST = 20
THRESHOLD = 0.7
REMEMBERED = 600_000

_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
_NO_LETTER = re.compile(r"[\W_]+")


def units(token: str) -> list[str]:
    """What a lower-case token is compared by: its letters and digits, in overlapping parts
    if there are many."""
    plain = _NO_LETTER.sub("", token)
    if len(plain) <= LONGEST:
        return [plain] if len(plain) > 2 else []
    return [plain[k : k + LONGEST] for k in range(0, len(plain) - LONGEST // 2, LONGEST // 2)]


def spelt_out(tokens: list[str]) -> list[str]:
    """Words spelt in single characters ("a b c"), put together."""
    out, run = [], ""
    for x in [*tokens, "--"]:
        if len(x) == 1:
            run += x
        else:
            if len(run) > 2:
                out += units(run)
            run = ""
    return out


@lru_cache(maxsize=None)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(length), 3)), dtype=np.int64)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


class Kernel:
    """Normalised subsequence kernels of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.letters = {c: k + 1 for k, c in enumerate(sorted(set("".join(landmarks))))}
        self.base = len(self.letters) + 1
        self.table = np.zeros(max(map(ord, self.letters), default=0) + 2, dtype=np.int64)
        for c, k in self.letters.items():
            self.table[ord(c)] = k
        self.features = np.zeros((len(landmarks), self.base**3), dtype=np.float32)
        for k, word in enumerate(landmarks):
            at, weight = _triples(len(word))
            codes = self._codes(self._matrix([word]), at)[0]
            np.add.at(self.features[k], codes, weight)
        self.features /= np.maximum(np.linalg.norm(self.features, axis=1, keepdims=True), 1e-9)
        self.by_code = np.ascontiguousarray(self.features.T)  # no landmark has anything at code 0
        self.most = self.features.max(axis=0) if len(landmarks) else np.zeros(1, dtype=np.float32)

    def _matrix(self, words: list[str]) -> np.ndarray:
        get = self.letters.get
        return np.array([[get(c, 0) for c in w] for w in words], dtype=np.int64)

    def _codes(self, matrix: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (matrix[:, at[:, 0]] * self.base + matrix[:, at[:, 1]]) * self.base + matrix[:, at[:, 2]]

    def near(self, words: list[str]) -> list[dict[int, float]]:
        """For each word, the landmarks whose kernel with it is FLOOR or more.

        Words are left out early by bounds that no such kernel can be below: the greatest
        value of each subsequence in any landmark, and the norm that a word would have if all
        its subsequences were different.
        """
        out: list[dict[int, float]] = [{} for _ in words]
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w)].append(k)
        for length, own in by_length.items():
            at, weight = _triples(length)
            if not len(at) or not self.landmarks:
                continue
            least = FLOOR * float(np.sqrt((weight * weight).sum())) * (1 - 1e-5)
            for begin in range(0, len(own), 2048):
                part = np.array(own[begin : begin + 2048])
                points = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), length)
                matrix = self.table[np.minimum(points, len(self.table) - 1)]
                codes = self._codes(matrix, at)
                if not matrix.all():  # letters that no landmark has
                    lacks = matrix == 0
                    codes[lacks[:, at[:, 0]] | lacks[:, at[:, 1]] | lacks[:, at[:, 2]]] = 0
                some = np.flatnonzero(self.most[codes] @ weight >= least)
                step = max(1, (1 << 22) // (len(at) * len(self.landmarks)))
                for lo in range(0, len(some), step):
                    rows = some[lo : lo + step]
                    value = np.matmul(weight, self.by_code[codes[rows]])
                    hit = value.max(axis=1) >= least
                    if not hit.any():
                        continue
                    rows, value = rows[hit], value[hit]
                    value = value / self._norms(points[rows], at, weight)[:, None]
                    for r, c in zip(*(x.tolist() for x in np.nonzero(value >= FLOOR))):
                        out[part[rows[r]]][c] = float(value[r, c])
        return out

    @staticmethod
    def _norms(points: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Norms of words of one length; equal subsequences of a word count together."""
        n, length = points.shape
        first = (points[:, :, None] == points[:, None, :]).argmax(axis=2)
        code = (first[:, at[:, 0]] * length + first[:, at[:, 1]]) * length + first[:, at[:, 2]]
        out = np.empty(n)
        step = max(1, (1 << 20) // length**3)
        for lo in range(0, n, step):
            part = code[lo : lo + step]
            place = part + np.arange(len(part))[:, None] * length**3
            sums = np.bincount(place.ravel(), np.broadcast_to(weight, part.shape).ravel(), minlength=len(part) * length**3)
            out[lo : lo + step] = np.sqrt((sums.reshape(len(part), -1) ** 2).sum(axis=1))
        return out

    def matrix(self) -> np.ndarray:
        """Kernels of the landmarks with each other, with the floor that features have."""
        out = self.features @ self.features.T
        return np.where(out >= FLOOR, out, 0)


@dataclass
class Model:
    """Landmarks, the weight of each landmark's kernel, and the calibration."""

    landmarks: list[str]
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -40, 40)))


def sentences(text: str) -> list[list[str]]:
    """Units of each sentence."""
    out = []
    for part in _SENTENCE.split(text.lower()):
        tokens = part.split()
        own = [u for t in tokens for u in units(t)]
        out.append(own + spelt_out(tokens))
    return out


def _hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    keep = ridge * np.eye(x1.shape[1])
    keep[-1, -1] = 1e-9

    def loss(w: np.ndarray) -> float:
        return float((share * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum() + w @ keep @ w / 2)

    w = np.zeros(x1.shape[1])
    for _ in range(60):
        slack = np.maximum(0, 1 - y * (x1 @ w))
        on = slack > 0
        slope = -2 * x1[on].T @ (share * y * slack)[on] + keep @ w
        step = np.linalg.solve(2 * (x1[on] * share[on, None]).T @ x1[on] + keep, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() * size < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(rows: list[tuple[str, int]]) -> Model | None:
    """A model from (text, toxic) rows; None without both labels."""
    cut = [(sentences(text or ""), y) for text, y in rows]
    n = Counter(y for _, y in cut)
    if not n[0] or not n[1]:
        return None
    seen = {0: Counter(), 1: Counter()}
    for parts, y in cut:
        seen[y].update({u for p in parts for u in p})
    telling = {w: (c / n[1]) / ((seen[0][w] + 0.5) / n[0]) for w, c in seen[1].items() if c >= max(3, n[1] // 400)}
    telling = {w: x for w, x in telling.items() if x >= 8}
    if not telling:
        return None
    order = sorted(telling, key=lambda w: (-telling[w] * seen[1][w] ** 0.5, w))[:600]
    landmarks: list[str] = []
    while order and len(landmarks) < LANDMARKS:  # the most telling word, then without what it is like
        landmarks.append(order[0])
        near = Kernel([order[0]]).near(order)
        order = [w for w, k in zip(order, near) if k.get(0, 0) < 0.75 and w != landmarks[-1]]
    kernel = Kernel(landmarks)
    words = sorted({u for parts, _ in cut for p in parts for u in p})
    value = {w: k for w, k in zip(words, kernel.near(words)) if k}

    def pooled(part: list[str]) -> np.ndarray:
        out = np.zeros(len(landmarks))
        for u in part:
            for k, x in value.get(u, {}).items():
                out[k] = max(out[k], x)
        return out

    vals, vecs = np.linalg.eigh(kernel.matrix().astype(float))
    root = vecs @ np.diag(np.where(vals > 1e-3, np.maximum(vals, 1e-3) ** -0.5, 0)) @ vecs.T  # the Nyström map
    parts_of = [np.array([pooled(p) for p in parts if any(u in value for u in p)] or [np.zeros(len(landmarks))]) for parts, _ in cut]
    labels = np.array([y for _, y in cut])
    chosen = []
    for own, y in zip(parts_of, labels):
        best = own.max(axis=1)
        chosen.append(own[best >= min(0.999, best.max())] if y else own)
    x = np.vstack(chosen)
    y = np.repeat(2 * labels - 1, [len(own) for own in chosen])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = _hinge(x @ root, y, share)
    weight = root @ w
    top = np.array([float((own @ weight + b).max()) for own in parts_of])
    slope, shift = _platt(top, labels)
    return Model(landmarks, weight, b, slope, shift)


def _platt(decision: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton's method, with Platt's softened targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.column_stack([decision, np.ones(len(decision))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - target)), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


class Scorer:
    """Scores texts; remembers words that are near no landmark or near some."""

    def __init__(self, model: Model):
        self.model, self.kernel = model, Kernel(model.landmarks)
        self.known: dict[str, int] = {}  # 0: no landmark near; else the place in values
        self.values: list[np.ndarray] = [np.zeros(len(model.landmarks))]

    def learn(self, tokens: set[str]) -> None:
        cut = {t: units(t) for t in tokens}
        flat = sorted({u for own in cut.values() for u in own})
        near = dict(zip(flat, self.kernel.near(flat)))
        for t, own in cut.items():
            place = 0
            if any(near[u] for u in own):
                value = np.zeros(len(self.model.landmarks))
                for u in own:
                    for k, x in near[u].items():
                        value[k] = max(value[k], x)
                self.values.append(value)
                place = len(self.values) - 1
            self.known[t] = place

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known, self.values = {}, self.values[:1]
        cut = [x.lower().split() for x in texts]
        unknown = {t for tokens in cut for t in tokens if t not in self.known}
        if unknown:
            self.learn(unknown)
        decision = np.full(len(texts), self.model.bias)
        for k, tokens in enumerate(cut):
            apart = spelt_out(tokens) if sum(len(t) == 1 for t in tokens) > 2 else []
            if any(map(self.known.__getitem__, tokens)) or apart:
                decision[k] = max(decision[k], self._by_sentence(texts[k]))
        return self.model.probability(decision)

    def _by_sentence(self, text: str) -> float:
        best = self.model.bias
        for part in _SENTENCE.split(text.lower()):
            tokens = part.split()
            apart = spelt_out(tokens)
            missing = {t for t in [*tokens, *apart] if t not in self.known}
            if missing:
                self.learn(missing)
            places = {self.known[t] for t in [*tokens, *apart]} - {0}
            if places:
                value = np.max([self.values[p] for p in places], axis=0)
                best = max(best, float(value @ self.model.weight + self.model.bias))
        return best


def split(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SAMPLE) -> DataFrame:
    """labelled_id, text, y of at most ``size`` training texts of either label."""
    own = labels.select(F.col(id_col).alias("labelled_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (split("labelled_id") != 1) & F.col("labelled_id").isNotNull())
    own = own.groupBy("labelled_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("labelled_id"), F.col(text).alias("text")).where(F.length(text) <= SAMPLE_CHARS)
    drawn = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(size)
        drawn = part if drawn is None else drawn.unionByName(part)
    return texts.join(F.broadcast(drawn), "labelled_id").groupBy("labelled_id", "y").agg(F.min("text").alias("text"))


def fitted(rows: DataFrame) -> Model | None:
    """The model of a bounded sample, trained in one task; only the model comes back."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns))]
        model = train([(text, y) for _, text, y in sorted(held, key=lambda x: str(x[0]))])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = rows.select("labelled_id", "text", "y").repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` appended."""
    model = fitted(sample(docs, labels, id_col, text, **options))
    key = uuid.uuid4().hex
    schema = docs.drop("score", "predicted").schema.add("score", "double").add("predicted", "integer")
    if model is None:
        return docs.drop("score", "predicted").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = of_worker(("toxicity", key), lambda: Scorer(model))  # one for all tasks that use the same model
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = np.concatenate([scorer.scores([x or "" for x in texts[k : k + 512]]) for k in range(0, len(texts), 512)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return docs.drop("score", "predicted").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", (split() == 1).alias("held_out"), "score", "predicted")
