"""Language identification in two steps: a family first, then a language within it.

Both steps are one-versus-one linear support vector machines over hashed letter n-grams of the whole
text, fitted by dual coordinate descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .shared import crc32_mod

#: fixed values: families of languages; a language not listed is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
BUCKETS = 2048
#: rows whose features are held at once
ROWS = 512
LETTER = r"\p{L}"
_FOLD = np.full(256, 32, np.uint64)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x BUCKETS: square roots of counts of 1 to 3 byte letter n-grams, scaled to length 1."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    x = _FOLD[data]
    counts = np.zeros(n * BUCKETS)
    for k in (1, 2, 3):
        m = len(x) - k + 1
        if m <= 0:
            continue
        code = x[:m].copy()
        for j in range(1, k):
            code |= x[j : j + m] << np.uint64(8 * j)
        whole = doc[:m] == doc[k - 1 :]
        slot = ((code + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)).astype(np.int64)
        # white space alone says nothing
        whole &= code != sum(32 << (8 * j) for j in range(k))
        counts += np.bincount(doc[:m][whole] * BUCKETS + slot[whole], minlength=n * BUCKETS)
    out = np.sqrt(counts).reshape(n, BUCKETS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square, rng = (x * x).sum(1) + 0.5 / cost, np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - step / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Choice:
    """One-versus-one machines between classes; ties of votes go to the larger sum of margins."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @staticmethod
    def fitted(x: np.ndarray, labels: np.ndarray, names: list[str]) -> Choice:
        pairs = list(combinations(range(len(names)), 2))
        weights = np.zeros((BUCKETS + 1, len(pairs)))
        for k, (a, b) in enumerate(pairs):
            rows = (labels == names[a]) | (labels == names[b])
            weights[:, k] = svm(x[rows], np.where(labels[rows] == names[a], 1.0, -1.0))
        return Choice(names, pairs, weights)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and confidence (0 to 1) of each row."""
        votes, sure = np.zeros((len(x), len(self.names))), np.ones((len(x), len(self.names)))
        margin = x @ self.weights[:-1] + self.weights[-1]
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(3 * margin[:, k], -30, 30)))
            votes[:, a] += (margin[:, k] >= 0) + 1e-3 * p
            votes[:, b] += (margin[:, k] < 0) + 1e-3 * (1 - p)
            sure[:, a], sure[:, b] = np.minimum(sure[:, a], p), np.minimum(sure[:, b], 1 - p)
        best = votes.argmax(1)
        return best, sure[np.arange(len(x)), best]


@dataclass
class Model:
    family: Choice | None
    within: list[Choice]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        name, score = np.full(len(x), "und", object), np.zeros(len(x))
        if self.family is None:
            return name, score
        group, sure = self.family.decide(x)
        for g, choice in enumerate(self.within):
            rows = np.flatnonzero(group == g)
            best, p = choice.decide(x[rows])
            name[rows] = np.array(choice.names, object)[best]
            score[rows] = sure[rows] * p
        return name, score


def _sliced(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, n, data, offsets in W.slices(column, 1 << 20):
        for i in range(0, n, ROWS):
            part = offsets[i : i + ROWS + 1]
            yield first + i, features(data[part[0] : part[-1]], part - part[0])


def fit(docs: DataFrame, mod: int = 5, per_language: int = 1000) -> Model:
    """Model from about `per_language` rows of each lang, those least by a hash of the id, and from at most
    twice as many as that for all langs together, where ids repeat.

    Rows whose crc32(doc_id as text) mod `mod` is 0, and rows of null lang or of text without a
    letter, teach nothing.
    """
    taught = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        F.col("lang").isNotNull() & (crc32_mod("doc_id", mod) != 0) & F.col("text").rlike(LETTER)
    )
    counts = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(None, [])
    share = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, 1.2 * per_language / n))))
    picked = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, x in _sliced(b.column(1)):
                rows = pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary())
                yield pa.record_batch([b.column(0).slice(first, len(x)), b.column(2).slice(first, len(x)), rows], ["doc_id", "lang", "x"])

    place = F.xxhash64("doc_id"), F.col("doc_id"), F.col("lang"), F.col("x")
    got = picked.mapInArrow(measured, "doc_id long, lang string, x binary").orderBy(*place).limit(2 * per_language * len(counts)).collect()
    got.sort(key=lambda r: (r.lang, r.doc_id, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float)
    lang = np.array([r.lang for r in got])
    family_of = {code: name for name, codes in FAMILIES.items() for code in codes}
    family = np.array([family_of.get(v, v) for v in lang])
    families = sorted(set(family))
    within = [Choice.fitted(x[family == f], lang[family == f], sorted(set(lang[family == f]))) for f in families]
    return Model(Choice.fitted(x, family, families), within)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predicted(docs: DataFrame, model: Model, mod: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    lang_pred is `und` with score 0 for a text that is null or has no letter. held_out is false for
    a null id.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for first, x in _sliced(b.column(2)):
                name[first : first + len(x)], score[first : first + len(x)] = sent.value.predict(x)
            silent = ~np.array(b.column(3).to_pylist(), bool)
            name[silent], score[silent] = "und", 0.0
            yield pa.record_batch([b.column(0), b.column(1), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long"), F.coalesce(crc32_mod("doc_id", mod) == 0, F.lit(False)), text, F.coalesce(text.rlike(LETTER), F.lit(False)))
    return given.mapInArrow(predict, SCHEMA)
