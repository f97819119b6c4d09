"""Places of long passages that stand more than once, shared by both kinds of substring dedup.

1. Anchors: every window of `window` words has a minimiser, the least hash among its k-word
   sequences, so equal windows meet under one hash. Anchors whose hash stands once are done with.
2. The stretches of text around the other anchors, written with single spaces, are grouped by
   anchor. Where one anchor has very many places, its stretches are cut to single windows that are
   grouped by their own hash, so that no group follows the frequency of a passage's surroundings.
3. Equal stretches are counted where they are cut, and each distinct one goes once per batch to the
   group that decides which of its words lie in windows that stand elsewhere too.
4. Decisions go back to every place of the stretch, and by document to its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .shared import partitions, written

#: of one group's stretches (words joined by spaces), their counts and the window: per stretch, the
#: runs (first word, end) of words inside windows that stand twice or more
Decide = Callable[[list[bytes], list[int], int], list[list[tuple[int, int]]]]

K = 8
#: of stretches, and number of places, that are held before they are sent on
SENT_BYTES, SENT_PLACES = 16 << 20, 200_000
#: the most anchors that are sent to every executor
HOT_ANCHORS = 10_000
#: about what one place's stretch takes, and what the stretches of one bucket may
PLACE_BYTES, BUCKET_BYTES = 512, 16 << 20


def _anchors(given: DataFrame, k: int, window: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in W.words(b.column(2)):
                g, doc, lo, hi, _ = W.anchors(w, w.hashes(), k, window)
                at = pa.array(doc + w.first)
                yield pa.record_batch([pa.array(W.signed(g)), b.column(0).take(at), b.column(1).take(at), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["h", "row", "part", "lo", "hi"])

    return given.mapInArrow(find, "h long, row long, part long, lo int, hi int")


def _stretches(held: DataFrame, window: int, buckets: int, texts: bool) -> DataFrame:
    """Distinct stretches of each batch with their counts (texts), or the places of each stretch."""

    def told(found: dict[tuple[int, bytes], int] | list[tuple]) -> pa.RecordBatch:
        if texts:
            columns = ([k % buckets for k, _ in found], [k for k, _ in found], [s for _, s in found], list(found.values()))
            kinds, names = (pa.int32(), pa.int64(), pa.binary(), pa.int64()), ["bucket", "key", "stretch", "n"]
        else:
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds, names = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), ["key", "print", "row", "part", "at"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], int] = {}
        places: list[tuple[int, int, int, int, int]] = []
        told_of: set[tuple[int, int]] = set()
        size = 0
        for b in batches:
            for row, part, text, anchors in zip(*(b.column(i) for i in range(4)), strict=True):
                row, part = row.as_py(), part.as_py()
                if not texts:
                    if (row, part) in told_of:
                        continue
                    told_of.add((row, part))
                words = (text.as_py() or "").encode().split()
                for a in anchors.as_py():
                    spans = [(a["lo"], a["hi"])] if not a["hot"] else [(p, p) for p in range(a["lo"], a["hi"] + 1)]
                    for lo, hi in spans:
                        stretch = b" ".join(words[lo : hi + window])
                        key = a["h"] if not a["hot"] else xxhash.xxh64_intdigest(stretch, 1) - (1 << 63)
                        if not texts:
                            places.append((key, xxhash.xxh3_64_intdigest(stretch) - (1 << 63), row, part, lo))
                        elif (key, stretch) in seen:
                            seen[key, stretch] += 1
                        else:
                            seen[key, stretch] = 1
                            size += len(stretch)
                if size > SENT_BYTES or len(places) > SENT_PLACES:
                    yield told(seen if texts else places)
                    seen, places, told_of, size = {}, [], set(), 0
        yield told(seen if texts else places)
        W.release()

    return held.mapInArrow(cut, "bucket int, key long, stretch binary, n long" if texts else "key long, print long, row long, part long, at int")


def keyed(docs: DataFrame) -> DataFrame:
    """(row, part, text): the id, 0 for null, and 63 bits of hash that tell apart texts that share an id;
    the last bit of part says that there is no id."""
    text, id_ = F.col("text").cast("string"), F.col("doc_id").cast("long")
    part = F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(id_.isNull().cast("long"))
    return docs.select(F.coalesce(id_, F.lit(0)).cast("long").alias("row"), part.alias("part"), text.alias("text"))


def doc_id() -> Column:
    """The id of a row of keyed()."""
    return F.when(F.col("part").bitwiseAND(F.lit(1)) == 0, F.col("row")).alias("doc_id")


def covers(given: DataFrame, decide: Decide, window: int, k: int = K, hot: int = 5_000) -> DataFrame:
    """(row, part, spans), one for each different row of keyed() with a word in a repeated window.

    Equal rows are places of their own when windows are counted, and have equal spans, so their anchors
    and spans are kept once. spans are sorted disjoint [first word, end) pairs, flat. `hot` is the number
    of places of one anchor, or a larger one that at most HOT_ANCHORS reach, over which its stretches are
    cut to single windows. The number of buckets follows the bytes that go into them.
    """
    anchors = _anchors(given, k, window)
    counts = written(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(16 * partitions(given.sparkSession), total * PLACE_BYTES // BUCKET_BYTES)
    # at most HOT_ANCHORS have so many places: few enough to send, and their places need not meet
    least = max(hot, total // HOT_ANCHORS)
    known = anchors.join(F.broadcast(counts.where(F.col("n") > least).select("h", F.lit(True).alias("hot"))), "h", "left")
    often = counts.where(F.col("n") <= least).select(F.col("h").alias("key"))
    # places of hot anchors go by their own hash, to where nothing matches them
    spread = known.withColumn("key", F.when(F.col("hot"), F.xxhash64("h", "row", "part", "lo")).otherwise(F.col("h")))
    met = spread.join(often.withColumn("often", F.lit(True)).hint("merge"), "key", "left").where("hot or often")
    flagged = met.groupBy("row", "part").agg(F.collect_set(F.struct("h", F.coalesce("hot", F.lit(False)).alias("hot"), "lo", "hi")).alias("anchors"))
    held = given.select("row", "part", "text").join(flagged.hint("merge"), ["row", "part"])

    def decided(rows: pa.Table) -> pa.Table:
        groups: dict[int, dict[bytes, int]] = {}
        for key, stretch, n in zip(*(rows[c].to_pylist() for c in ("key", "stretch", "n")), strict=True):
            group = groups.setdefault(key, {})
            group[stretch] = group.get(stretch, 0) + n
        out = []
        flat = [(key, stretch, n) for key, group in groups.items() for stretch, n in group.items()]
        runs = decide([s for _, s, _ in flat], [n for _, _, n in flat], window)
        for (key, stretch, _), found in zip(flat, runs, strict=True):
            if found:
                out.append((key, xxhash.xxh3_64_intdigest(stretch) - (1 << 63), [x for run in found for x in run]))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)], ["key", "print", "runs"])

    stretches = _stretches(held, window, buckets, True)
    decisions = stretches.groupBy("bucket").applyInArrow(decided, "key long, print long, runs array<int>")
    at = _stretches(held, window, buckets, False).join(decisions.hint("merge"), ["key", "print"])
    runs = at.select("row", "part", F.transform("runs", lambda x: x + F.col("at")).alias("runs")).groupBy("row", "part").agg(F.flatten(F.collect_set("runs")).alias("runs"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for runs in b.column(2):
                x = np.array(runs.as_py(), np.int64).reshape(-1, 2)
                x = x[np.argsort(x[:, 0], kind="stable")]
                end = np.maximum.accumulate(x[:, 1])
                first = np.append(True, x[1:, 0] > end[:-1])
                out.append(np.stack([x[first, 0], np.append(end[np.flatnonzero(first)[1:] - 1], end[-1])], 1).ravel().tolist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["row", "part", "spans"])

    return runs.mapInArrow(merged, "row long, part long, spans array<long>")


def runs_of(owner: np.ndarray, first: np.ndarray, window: int, n: int) -> list[list[tuple[int, int]]]:
    """Windows (sorted by sequence and place) merged into runs of words, per sequence."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for o, f in zip(owner.tolist(), first.tolist(), strict=True):
        if out[o] and f <= out[o][-1][1] - window + 1:
            out[o][-1] = (out[o][-1][0], f + window)
        else:
            out[o].append((f, f + window))
    return out
