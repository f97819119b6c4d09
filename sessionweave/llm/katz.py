"""Katz backoff language model of words, of any order, trained and applied in the cluster.

Documents are packed into batches of bounded size. Order by order, a batch asks for the counts of its
distinct n-grams, once each; a bucket of contexts holds the n-grams of these contexts from all batches,
and answers in the order asked. So neither texts nor occurrences travel with the counts. Counts are
Good-Turing discounted up to 5, and by a constant above, so every context keeps mass to back off with.
What a batch teaches travels with the lower-order counts of each n-gram, so a bucket can normalise the
backoff weights of its contexts exactly over their followers. The probability of a token is evaluated
recursively from the lowest order up.

Words are told apart by 64 bits of hash; from order 2 on they go by short numbers, and contexts of more
words by 64 bits of hash of these. A context that is frequent in the corpus is spread
over all buckets, and its sums are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .shared import crc32_mod, partitions, written

U = np.uint64
END, START = U(1), U(2)
TOP, TAIL = 5, 0.5
STEP = U(0x9E3779B97F4A7C15)
#: about what the n-grams of one byte of text take, and what one bucket may hold of them
GRAM_BYTES, BUCKET_BYTES = 2, 16 << 20


@dataclass
class Tokens:
    word: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # whether a token is its document's first
    names: np.ndarray  # at order 1 the words, then their numbers
    contexts: list[np.ndarray]  # of each order, what stands before each token; that of order 1 is 0

    def before(self, values: np.ndarray, at_first: int | np.integer) -> np.ndarray:
        """What the token before each one has, or at_first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_first
        return out

    def named(self, names: np.ndarray, order: int) -> None:
        """From now on words go by their numbers, and have contexts of all orders."""
        self.names, gram = names, names
        for _ in range(2, order + 1):
            self.contexts.append(self.before(gram, START))
            gram = _joined(self.contexts[-1], names)


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return W.mix(context * STEP + word)


def _tokens(column: pa.ChunkedArray | pa.Array) -> Tokens:
    """Lower-cased words of each text and an end."""
    words, docs, first = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for w in W.words(column):
        h, doc, n = w.hashes(lower=True), w.doc_of(), np.diff(w.bounds) + 1
        out = np.full(len(h) + w.n_docs, END, U)
        out[np.arange(len(h)) + doc] = h
        begins = np.zeros(len(out), bool)
        begins[np.cumsum(n) - n] = True
        words.append(out)
        first.append(begins)
        docs.append(np.repeat(np.arange(w.n_docs), n) + w.first)
    word = np.concatenate(words)
    return Tokens(word, np.concatenate(docs), np.concatenate(first), word, [np.zeros(len(word), U)])


@dataclass
class Grams:
    """Distinct n-grams of a batch in order of bucket, word and context, and their contexts by bucket."""

    of_token: np.ndarray
    bucket: np.ndarray
    word: np.ndarray
    context: np.ndarray  # of each n-gram, the number of its context
    contexts: np.ndarray  # distinct ones of each bucket, in order
    of_bucket: np.ndarray  # their buckets

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """First n-grams of each bucket and of the end, and the first contexts."""
        edges = np.append(np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])), len(self.bucket)) if len(self.bucket) else np.zeros(1, np.int64)
        return edges, np.append(np.searchsorted(self.of_bucket, self.bucket[edges[:-1]]), len(self.contexts))


def _grams(context: np.ndarray, word: np.ndarray, often: np.ndarray, buckets: int) -> Grams:
    # n-grams of a very frequent context are spread over buckets
    key = np.where(np.isin(context, often), _joined(context, word), W.mix(context))
    bucket = (key % U(buckets)).astype(np.int32)
    del key
    order = np.lexsort((context, word, bucket))
    b, c, w = bucket[order], context[order], word[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (w[1:] != w[:-1]) | (c[1:] != c[:-1])
    of_token = np.empty(len(order), np.int64)
    of_token[order] = np.cumsum(fresh) - 1
    b, c, w = b[fresh], c[fresh], w[fresh]
    order = np.lexsort((c, b))
    run = np.ones(len(order), bool)
    run[1:] = (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(run) - 1
    first = order[run]
    return Grams(of_token, b, w, number, c[first], b[first])


_ZSTD = pa.Codec("zstd")


def _planes(x: np.ndarray) -> bytes:
    """Eight-byte numbers, all first bytes first, compressed: of small ones little is left."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _from_planes(raw: bytes, kind: type = np.int64) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    flat = _ZSTD.decompress(raw[8:], size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(8, -1).T).view(kind).ravel()


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """What is left of a count r = 0..TOP after Good-Turing, from numbers of types with count 0..TOP+1.

    Katz's renormalised ratios; where they do not lie between 0 and 1 (few data, or counts that do
    not fall off), the constant discount stands in.
    """
    left = np.arange(TOP + 1) - TAIL
    left[0] = 0.0
    n = of_counts.astype(float)
    if n[1] > 0 and (n[1:] > 0).all():
        tail = (TOP + 1) * n[TOP + 1] / n[1]
        for r in range(1, TOP + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if tail < 1 else 0.0
            if 0 < d < 1:
                left[r] = d * r
    return left


def _of_counts(x: np.ndarray) -> np.ndarray:
    return np.bincount(x[(x > 0) & (x <= TOP + 1)], minlength=TOP + 2)


@dataclass
class Level:
    """What is known of all n-grams of one order."""

    left: np.ndarray  # of counts 0..TOP after discounting
    of_counts: np.ndarray
    n: int
    v: int
    often: np.ndarray  # contexts that are spread over buckets, sorted
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, TOP + 2)))  # of these, as of contexts

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= TOP, self.left[np.minimum(counts, TOP)], counts - TAIL)

    @property
    def unseen(self) -> float:
        """Probability of all words that training has not, at order 1."""
        few = self.of_counts[1 : TOP + 1]
        many, mass = self.v - few.sum(), self.n - (few * np.arange(1, TOP + 1)).sum()
        return float(1 - ((few * self.left[1:]).sum() + mass - TAIL * many) / max(self.n, 1)) if self.n else 1.0

    def freed(self, sums: np.ndarray) -> np.ndarray:
        """Counts that discounting took from contexts with these numbers of followers by count."""
        return sums[:, :TOP] @ (np.arange(1, TOP + 1) - self.left[1:]) + TAIL * sums[:, TOP]


ASK = "batch long, bucket int, contexts binary, words binary, sizes binary, context binary, learnt binary, low binary, below binary"
ANSWER = "level int, kind int, batch long, bucket int, times binary, ranks binary, sums binary, stats array<long>, context long, part array<double>"
#: kinds of answers: to a batch, numbers for the whole model, frequent contexts of the next order, sums of frequent contexts
REPLY, STATS, FREQUENT, PART = range(4)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
BATCH = "batch long, bytes long, docs long, blob binary"
TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _table(columns: list, schema: str) -> pa.Table:
    fields = [c.split() for c in schema.split(", ")]
    return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, TYPES[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _packed(batch_bytes: int):  # noqa: ANN202
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            # equal rows are scored once and count as often as they come
            t = pa.Table.from_batches([b]).group_by(b.schema.names).aggregate([([], "count_all")]).combine_chunks()
            ends = np.cumsum(np.diff(W.buffers(t["text"])[1]))
            for rows in np.split(np.arange(t.num_rows), np.flatnonzero(np.diff(ends // batch_bytes)) + 1):
                if not len(rows):
                    continue
                part = t.slice(rows[0], len(rows))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_table(part)
                size = int(ends[rows[-1]] - (ends[rows[0] - 1] if rows[0] else 0))
                docs = int((part["train"].to_numpy() * part["count_all"].to_numpy()).sum())
                yield _table([[number], [size], [docs], [sink.getvalue().to_pybytes()]], BATCH).to_batches()[0]
                number += 1

    return pack


def _unpacked(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()


@dataclass
class Model:
    """The lower orders first; those not yet counted are missing."""

    order: int
    docs: int
    buckets: int
    levels: list[Level]
    often: np.ndarray  # contexts of the next order that are spread

    def numbers(self, ranks: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
        """Numbers of words, which are short, from their places in their buckets; END and START are none of them."""
        return (ranks * self.buckets + bucket + 3).astype(U)

    def evaluated(self, t: Tokens, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probability of each token, its count, its context's count at the last order, and its count at the first."""
        value = counts = total = known = np.zeros(len(t.word))
        number = replies["level"].to_numpy()
        for k, level in enumerate(self.levels, 1):
            g = _grams(t.contexts[k - 1], t.names, level.often, self.buckets)
            mine = replies.filter(pa.array(number == k)).sort_by("bucket")
            times = np.concatenate([np.zeros(0, np.int64), *(_from_planes(x.as_py()) for x in mine["times"])])
            total = np.full(len(t.word), level.n) if k == 1 else t.before(counts, self.docs)
            counts = times[g.of_token]
            with np.errstate(divide="ignore"):
                seen = np.log10(np.maximum(level.discounted(counts), 1e-300)) - np.log10(np.maximum(total, 1))
            if k == 1:
                known, value = counts, np.where(counts > 0, seen, np.log10(max(level.unseen, 1e-300)))
                ranks = np.concatenate([np.zeros(0, np.int64), *(_from_planes(x.as_py()) for x in mine["ranks"])])
                t.named(self.numbers(ranks, g.bucket)[g.of_token], self.order)
                continue
            # contexts of n-grams that were never seen, in the order in which they were asked for
            lost = np.zeros(len(g.contexts), bool)
            lost[g.context[times == 0]] = True
            spread = np.isin(g.contexts, level.often)
            sums = np.zeros((len(g.contexts), TOP + 2))
            sums[lost & ~spread] = np.concatenate([np.zeros((0, TOP + 2)), *(_from_planes(x.as_py(), np.float64).reshape(-1, TOP + 2) for x in mine["sums"])])
            sums[spread] = level.sums[np.searchsorted(level.often, g.contexts[spread])]
            back = np.log10(np.maximum(level.freed(sums), 1e-300)) - np.log10(np.maximum(1 - sums[:, -1], 1e-300))
            value = np.where(counts > 0, seen, np.where(total > 0, value + back[g.context[g.of_token]] - np.log10(np.maximum(total, 1)), value))
        return value, counts, total, known

    def asked(self, rows: pa.Table, replies: pa.Table | None) -> pa.Table:
        """N-grams of the next order of a batch, by bucket."""
        k = len(self.levels) + 1
        batch, rows = rows["batch"][0].as_py(), _unpacked(rows["blob"][0])
        t = _tokens(rows["text"])
        counts, total = self.evaluated(t, replies)[1:3] if k > 1 else (None, None)
        g = _grams(t.contexts[k - 1], t.names, self.often, self.buckets)
        weight = (rows["train"].to_numpy() * rows["count_all"].to_numpy()).astype(float)[t.doc]
        learnt = np.bincount(g.of_token, weight, minlength=len(g.word)).astype(np.int64)
        low = below = np.zeros(len(g.word), np.int64)
        if k > 1:
            low, below = np.zeros((2, len(g.word)), np.int64)
            # all places of an n-gram have one count of the order below; it goes with what is learnt
            taught = weight > 0
            low[g.of_token[taught]], below[g.of_token[taught]] = counts[taught], total[taught]
        edges, starts = g.cuts()
        out = []
        for a, z, i, j in zip(edges[:-1], edges[1:], starts[:-1], starts[1:], strict=True):
            heads = np.flatnonzero(np.append(True, g.word[a + 1 : z] != g.word[a : z - 1]))
            numbers = (np.diff(np.append(heads, z - a)), g.context[a:z] - i, learnt[a:z], low[a:z], below[a:z])
            out.append((batch, int(g.bucket[a]), _planes(g.contexts[i:j]), _planes(g.word[a:z][heads]), *map(_planes, numbers)))
        return _table(list(zip(*out, strict=True)) if out else [[]] * 9, ASK)

    def answered(self, rows: pa.Table, often_from: int) -> pa.Table:
        """Counts of a bucket's n-grams in the order asked, and what the model needs of them."""
        k, lower = len(self.levels) + 1, self.levels[-1] if self.levels else None
        raw = lambda c: [x.as_py() for x in rows[c]]
        asked = [_from_planes(x, U) for x in raw("contexts")]
        places = [_from_planes(x) for x in raw("context")]
        context = np.concatenate([c[i] for c, i in zip(asked, places, strict=True)])
        word = np.concatenate([np.repeat(_from_planes(w, U), _from_planes(n)) for w, n in zip(raw("words"), raw("sizes"), strict=True)])
        learnt, low, below = (np.concatenate([_from_planes(x) for x in raw(c)]) for c in ("learnt", "low", "below"))
        order = np.lexsort((word, context))
        c, w = context[order], word[order]
        run, fresh = np.ones(len(order), bool), np.ones(len(order), bool)
        run[1:] = c[1:] != c[:-1]
        fresh[1:] = run[1:] | (w[1:] != w[:-1])
        starts = np.flatnonzero(fresh)
        times = np.add.reduceat(learnt[order], starts)
        c, w = c[starts], w[starts]
        owner = np.cumsum(run[starts]) - 1
        kinds = c[np.flatnonzero(run[starts])]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh) - 1
        back = times[rank]
        # followers by count, and their probability at the order below, of each context
        sums = np.zeros((len(kinds), TOP + 2))
        for r in range(1, TOP + 1):
            sums[:, r - 1] = np.bincount(owner, times == r, minlength=len(kinds))
        sums[:, TOP] = np.bincount(owner, times > TOP, minlength=len(kinds))
        if lower:
            chance = lower.discounted(np.maximum.reduceat(low[order], starts)) / np.maximum(np.maximum.reduceat(below[order], starts), 1)
            sums[:, TOP + 1] = np.bincount(owner, np.where(times > 0, chance, 0.0), minlength=len(kinds))
        spread = np.isin(kinds, self.often)
        out, begin = [], 0
        bucket = rows["bucket"][0].as_py()
        for batch, own, place in zip(rows["batch"].to_pylist(), asked, places, strict=True):
            got, ranks = back[begin : begin + len(place)], rank[begin : begin + len(place)]
            begin += len(place)
            lost = np.zeros(len(own), bool)
            lost[place[got == 0]] = True
            at = np.searchsorted(kinds, own)
            told = sums[at[lost & ~spread[at]]]
            out.append((REPLY, batch, _planes(got), None if k > 1 else _planes(ranks), _planes(told.ravel()), None, None, None))
        many = W.signed(_joined(c, w) if k > 1 else self.numbers(np.arange(len(w)), bucket))[times >= often_from]
        out.append((STATS, None, None, None, None, [*_of_counts(times).tolist(), int(times.sum()), int((times > 0).sum())], None, None))
        out.append((FREQUENT, None, None, None, None, many.tolist(), None, None))
        if lower:
            out += [(PART, None, None, None, None, None, int(v), s.tolist()) for v, s in zip(W.signed(kinds[spread]), sums[spread], strict=True)]
        kind, batch, *rest = zip(*out, strict=True)
        return _table([[k] * len(out), kind, batch, [bucket] * len(out), *rest], ANSWER)

    def scored(self, rows: pa.Table, replies: pa.Table) -> pa.Table:
        rows = _unpacked(rows["blob"][0])
        t = _tokens(rows["text"])
        value, _, _, c_word = self.evaluated(t, replies)
        n, first = rows.num_rows, self.levels[0]
        size = np.bincount(t.doc, minlength=n)
        base = np.bincount(t.doc, np.log10(c_word + 1.0), minlength=n) - size * np.log10(first.n + first.v + 1.0)
        known = np.bincount(t.doc, c_word > 0, minlength=n).astype(np.int64)
        out = _table([rows["doc_id"], rows["held_out"], size, known, base, np.bincount(t.doc, value, minlength=n)], RESULT)
        return out.take(pa.array(np.repeat(np.arange(n), rows["count_all"].to_numpy())))


def _asking(m: Model):  # noqa: ANN202
    return lambda rows, got: m.asked(rows, got)


def _asking_first(m: Model):  # noqa: ANN202
    return lambda batches: (x for b in batches for i in range(b.num_rows) for x in m.asked(pa.Table.from_batches([b.slice(i, 1)]), None).to_batches())


def _answering(m: Model, often_from: int):  # noqa: ANN202
    return lambda rows: m.answered(rows, often_from)


def _scoring(m: Model):  # noqa: ANN202
    return lambda rows, got: m.scored(rows, got)


def scored(docs: DataFrame, order: int = 2, mod: int = 7, rest: int = 2, batch_bytes: int = 8 << 20, share: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id as text) mod `mod` is `rest` are held out, and so is what has a null id
    from training, though held_out is false for it. A null or empty text is one end. Equal rows count
    each. base_score adds one to every count; score is the Katz log10 probability at `order`, in which all
    unknown words are one type. A batch holds at most about `batch_bytes` of text or one longer document.
    A context that one of some `share` words of the corpus ends is spread over buckets.
    """
    spark = docs.sparkSession
    held = crc32_mod("doc_id", mod)
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(held == rest, F.lit(False)).alias("held_out"),
        F.coalesce(held != rest, F.lit(False)).alias("train"),
    )
    batches = written(given.mapInArrow(_packed(batch_bytes), BATCH), "batches")
    total, train_docs = batches.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    batches = batches.select("batch", "blob")
    buckets = max(4 * partitions(spark), total * GRAM_BYTES // BUCKET_BYTES)
    # a word takes two bytes at least, so at most 4 * share contexts are this frequent
    often_from = 1 + total // (8 * share)
    model, replies = Model(order, train_docs, buckets, [], np.zeros(1, U)), None
    for k in range(1, order + 1):
        if replies is None:
            asked = batches.mapInArrow(_asking_first(model), ASK)
        else:
            asked = batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_asking(model), ASK)
        answers = written(asked.groupBy("bucket").applyInArrow(_answering(model, often_from), ANSWER), f"counts{k}")
        told = answers.where(F.col("kind") == STATS).agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(TOP + 4))).first()
        parts = answers.where(F.col("kind") == PART).groupBy("context").agg(*(F.sum(F.col("part")[i]) for i in range(TOP + 2))).collect()
        sums = np.zeros((len(model.often), TOP + 2))
        for r in parts:
            sums[np.searchsorted(model.often, np.array([r[0]], np.int64).view(U)[0])] = r[1:]
        stats = np.array(list(told), np.int64)
        level = Level(discounts(stats[: TOP + 2]), stats[: TOP + 2], int(stats[-2]), int(stats[-1]), model.often, sums)
        many = answers.where(F.col("kind") == FREQUENT).select(F.explode("stats").alias("context")).collect()
        often = np.unique(np.append(np.array([r.context for r in many], np.int64).view(U), START))
        model = Model(order, train_docs, buckets, [*model.levels, level], often)
        told_batches = answers.where(F.col("kind") == REPLY).select("level", "batch", "bucket", "times", "ranks", "sums")
        replies = told_batches if replies is None else replies.unionByName(told_batches)
    out = batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_scoring(model), RESULT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.levels[0].n).cast("long").alias("train_tokens"), "base_score", "score")
