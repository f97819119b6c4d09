"""Quality rules judged by an isolation forest over rule statistics.

Every document gets rule statistics from its whole text. Trees of random splits are grown on a
bounded sample of labelled rows, good and bad as they come; a document whose mean path is short is
anomalous. The threshold on that score is chosen on all labelled rows that grew no tree, from counts
of their scores by label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .shared import crc32_mod

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "punctuation", "repeats", "upper")
SYMBOLS = b"#*$%&|<>"
#: cells of the scores' histogram, a power of two so that their bounds are exact
BINS = 1 << 16
BLANK = b" \t\n\r\x0b\x0c"


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _UPPER = _flag(SYMBOLS), _flag(bytes(range(65, 91)))
_PUNCT = _flag(bytes(i for i in range(33, 127) if not chr(i).isalnum()))


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(w: W.Words, hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """Per document: words inside a window that stands twice or more in it."""
    doc, left = w.doc_of(), w.left()
    salt = W.mix(doc.astype(np.uint64) + np.uint64(1))
    good = np.flatnonzero(left >= size)
    _, which, times = np.unique(W.grams(hashes, size)[good] ^ salt[good], return_inverse=True, return_counts=True)
    at = good[times[which] > 1]
    edge = np.zeros(len(hashes) + size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    covered = np.cumsum(edge)[: len(hashes)] > 0
    return np.bincount(doc[covered], minlength=w.n_docs)


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(documents x COUNTS integers, documents x FEATURES floats) of whole texts; null text is empty."""
    counts, features = [np.zeros((0, len(COUNTS)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for w in W.words(column):
        n = np.diff(w.bounds)
        solid = (~W._SPACE[w.data] & ((w.data & 0xC0) != 0x80)).astype(np.int64)
        chars, symbols = _per_doc(solid, w.offsets), _per_doc(_SYMBOL[w.data], w.offsets)
        repeated = _repeats(w, w.hashes())
        raw = w.data.tobytes()
        dups = np.zeros(w.n_docs, np.int64)
        for i in range(w.n_docs):
            kept = [x for x in raw[w.offsets[i] : w.offsets[i + 1]].split(b"\n") if x.strip(BLANK)]
            dups[i] = len(kept) - len(set(kept))
        counts.append(np.stack([n, chars, symbols, dups, repeated], 1))
        some, ink = np.maximum(n, 1), np.maximum(chars, 1)
        upper, punct = (_per_doc(x[w.data], w.offsets) / ink for x in (_UPPER, _PUNCT))
        features.append(np.sqrt(np.stack([symbols / some, punct, repeated / some, upper], 1)))
    return np.concatenate(counts), np.concatenate(features)


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays over heap-ordered nodes: child of node i is 2i+1 (below the cut) or 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray  # path length at a leaf, nan elsewhere
    norm: float

    @staticmethod
    def grown(x: np.ndarray, trees: int = 200, sample: int = 128, seed: int = 0) -> Forest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
        nodes = 2 ** (depth + 1) - 1
        feature, cut, leaf = np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)), np.full((trees, nodes), np.nan)
        for t in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), sample, replace=False)])]
            while todo:
                i, d, rows = todo.pop()
                low, high = rows.min(0), rows.max(0)
                wide = np.flatnonzero(high > low)
                if d == depth or len(rows) < 2 or not len(wide):
                    leaf[t, i] = d + _expected(len(rows))
                    continue
                f = feature[t, i] = rng.choice(wide)
                c = cut[t, i] = rng.uniform(low[f], high[f])
                below = rows[:, f] <= c
                todo += [(2 * i + 1, d + 1, rows[below]), (2 * i + 2, d + 1, rows[~below])]
        return Forest(feature, cut, leaf, float(max(_expected(sample), 1)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1; larger is stranger."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            live = rows
            while len(live):
                live = live[np.isnan(leaf[at[live]])]
                here = at[live]
                at[live] = 2 * here + 1 + (x[live, feature[here]] > cut[here])
            total += leaf[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


@dataclass
class Model:
    forest: Forest | None
    threshold: float


def failed(counts: np.ndarray, min_words: int, repeat_percent: int) -> np.ndarray:
    return (counts[:, 0] < min_words) | (100 * counts[:, 4] > repeat_percent * counts[:, 0])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, clean_loss: float = 0.01, clean_weight: float = 10.0, min_words: int = 50, repeat_percent: int = 50) -> Model:
    """Forest from at most `most_rows` labelled ids (those least by a hash), and threshold from all others.

    One half of the sampled ids grows the forest, of their rows that pass the base rules at most
    4 * `most_rows`, least by a hash of the text. All other labelled rows that pass them choose the
    threshold: it loses at most `clean_loss` of the good ones; a share of them lost weighs
    `clean_weight` times as much as the same share of the bad ones kept. Without both kinds of label nothing is rejected.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.select(F.col("doc_id").cast("long").alias("label_doc_id"), F.col("quality").cast("int").alias("label_quality"), F.xxhash64("doc_id").alias("place"), crc32_mod("doc_id", 2).alias("half"))
    rows = known.orderBy("place", "label_doc_id").limit(most_rows).collect()
    if not rows:
        return Model(None, np.inf)
    sample = docs.sparkSession.createDataFrame([(r.label_doc_id, r.label_quality) for r in rows if r.half == 0], "label_doc_id long, label_quality int")
    # at most most_rows rows of two numbers: the broadcast is bounded by that parameter
    text = F.col("text").cast("string")
    picked = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_doc_id")).select("text", "label_quality", F.xxhash64("text").alias("print"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, x = statistics(b.column(0))
            out = pa.record_batch([b.column(1), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "print", "x"])
            yield out.filter(pa.array(~failed(counts, min_words, repeat_percent)))

    got = picked.mapInArrow(measured, "quality int, print long, x array<double>").orderBy("print", "quality").limit(4 * most_rows).collect()
    got.sort(key=lambda r: (r.quality, r.x))
    grow = np.array([r.x for r in got]).reshape(-1, len(FEATURES))
    if len(grow) < 2:
        return Model(None, np.inf)
    forest = Forest.grown(grow)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, x = statistics(b.column(1))
            fine = ~failed(counts, min_words, repeat_percent)
            bins = np.minimum((forest.scores(x[fine]) * BINS).astype(np.int64), BINS - 1)
            yield pa.record_batch([b.column(0).filter(pa.array(fine)), pa.array(bins)], ["doc_id", "bin"])

    last = rows[-1]
    grew = (F.col("half") == 0) & (F.struct("place", "label_doc_id") <= F.struct(F.lit(last.place).alias("place"), F.lit(last.label_doc_id).alias("label_doc_id")))
    others = known.where(~grew).select("label_doc_id", "label_quality")
    # texts stay where they are: ids and bins alone meet the labels
    scored = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(binned, "doc_id long, bin long")
    met = scored.join(others.hint("merge"), F.col("doc_id") == F.col("label_doc_id")).groupBy("label_quality", "bin").agg(F.count("*").alias("n"))
    times = np.zeros((2, BINS), np.int64)
    for r in met.collect():
        times[r.label_quality, r.bin] = r.n
    if not times.sum(1).all():
        return Model(None, np.inf)
    # a cut stands at the upper bound of a cell, so these shares are exact
    cuts = np.flatnonzero(times.sum(0))
    caught, lost = 1 - times.cumsum(1)[:, cuts] / times.sum(1)[:, None]
    fine = np.flatnonzero(lost <= clean_loss)
    best = cuts[fine[np.argmax((caught - clean_weight * lost)[fine])]]
    return Model(forest, float(np.nextafter((best + 1) / BINS, 0)) if best + 1 < BINS else 1.0)


SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"


def _judged(docs: DataFrame, model: Model, keep: tuple[str, ...], min_words: int, repeat_percent: int) -> DataFrame:
    """Columns `keep` under names of their own, so that none can clash, and the verdict."""
    given = docs.select(F.col("text").cast("string").alias("_text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, x = statistics(b.column(0))
            base = failed(counts, min_words, repeat_percent)
            anomaly = model.forest.scores(x) if model.forest else np.zeros(len(x))
            kept = ~base & (anomaly <= model.threshold)
            yield pa.record_batch([*b.columns[1:], *(pa.array(c) for c in counts.T), pa.array(base), pa.array(anomaly), pa.array(kept)], names)

    fields = given.schema.fields[1:]
    names = [f.name for f in fields] + [c.split()[0] for c in SCHEMA.split(", ")]
    return given.mapInArrow(judge, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), SCHEMA]))


def judged(docs: DataFrame, model: Model, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, COUNTS, base_failed, anomaly, kept.

    A document of fewer than `min_words` words, or with over `repeat_percent` of them in repeated
    windows, fails outright; the forest judges the others. Null or empty text has no words and fails.
    An anomaly that ties with the threshold is kept; rows that share an id are judged each for itself, so
    equal rows alike.
    """
    return _judged(docs, model, ("doc_id",), min_words, repeat_percent).withColumnRenamed("_keep0", "doc_id")


def filtered(docs: DataFrame, labels: DataFrame, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    names = tuple(docs.columns)
    out = _judged(docs, fit(docs, labels), names, min_words, repeat_percent).where("kept")
    return out.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(names)))
