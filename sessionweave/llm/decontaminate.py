"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands.

Texts and items are compared as characters, with A-Z and the capitals of Latin-1 lower-cased and white
space collapsed to single spaces. A long item counts by overlapping pieces of it. A piece of m characters
occurs when some stretch of the text is at most e = floor(rate * m) edits away. Such a stretch shares at
least m + 1 - q * (e + 1) q-grams with the piece, all on diagonals that differ by at most e from one
another, so all lie in one of the half-overlapping bands. Bands with fewer shared q-grams are dropped;
the others are aligned within their diagonals. q is Q, or less where the bound of a short piece would
fall under one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

Q = 8
#: shared q-grams looked at together
HITS = 1 << 20
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[0xC0:0xDF] += 32
_FOLD[0xD7] = 0xD7
_FOLD[[9, 10, 11, 12, 13]] = 32


def _folded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised characters of UTF-8 texts, their document offsets, each one's place in the texts, and the texts' offsets in characters."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    char_at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    low = np.where(points < 256, _FOLD[np.minimum(points, 255)], points)
    blank = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[char_at[:-1][char_at[:-1] < len(low)]] = True
    at = np.flatnonzero(keep)
    return low[at], np.searchsorted(at, char_at), at, char_at


def folded(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low = _folded(raw, np.array([0, len(raw)]))[0]
    ink = np.flatnonzero(low != 32)
    return low[ink[0] : ink[-1] + 1] if len(ink) else low[:0]


def _grams(low: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q characters from each place on."""
    return W.grams(W.mix(low.astype(np.uint64) + np.uint64(1)), q)[: max(len(low) - q + 1, 0)]


def _wordlike(c: int) -> bool:
    return 48 <= c <= 57 or 97 <= c <= 122 or c >= 128


def cut(item: np.ndarray, piece: int) -> list[np.ndarray]:
    """The item, or, from 2 * `piece` characters on, equal pieces of at least `piece` and those half a piece further on.

    Pieces that lie side by side make up the item, so where it occurs within its budget one of them
    occurs within its own.
    """
    k = max(1, len(item) // piece)
    edges = [j * len(item) // k for j in range(k + 1)]
    middles = [(a + z) // 2 for a, z in zip(edges, edges[1:])]  # noqa: B905, RUF007
    return [item[a:z] for x in (edges, middles) for a, z in zip(x, x[1:])]  # noqa: B905, RUF007


class Table:
    """The q-grams, for one q, of pieces."""

    def __init__(self, q: int, pieces: list[np.ndarray], numbers: list[int], edits: np.ndarray):
        self.q = q
        sizes = np.array([len(t) for t in pieces], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        g = _grams(np.concatenate(pieces), q)
        piece = np.searchsorted(offsets, np.arange(len(g)), side="right") - 1
        place = np.arange(len(g)) - offsets[piece]
        whole = place + q <= sizes[piece]
        g, piece, place = g[whole], piece[whole], place[whole]
        order = np.argsort(g, kind="stable")
        g, piece, place = g[order], piece[order], place[order]
        self.keys, first, times = np.unique(g, return_index=True, return_counts=True)
        self.first, self.times = first.astype(np.int32), times.astype(np.int32)
        # of g q-grams of which t must be shared, one of any g - t + 1 = q * e + 1 is: the rarest will do
        common = np.repeat(times, times)
        ranked = np.lexsort((common, piece))
        rank = np.empty(len(g), np.int64)
        rank[ranked] = np.arange(len(g)) - np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=len(pieces)))])[piece[ranked]]
        self.rare = rank <= q * edits[piece]
        self.piece, self.place = np.array(numbers, np.int32)[piece], place.astype(np.int32)
        self.bits = max(16, min(24, int(np.ceil(np.log2(max(len(self.keys), 1) * 16)))))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def hits(self, low: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in low, its document, posting) of shared q-grams, about HITS at a time."""
        g = _grams(low, self.q)
        at = np.flatnonzero(self.maybe[self._slot(g)])
        where = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        doc = np.searchsorted(offsets, at, side="right") - 1
        real = (self.keys[where] == g[at]) & (at + self.q <= offsets[doc + 1])
        at, where, doc = at[real], where[real], doc[real]
        times = self.times[where].astype(np.int64)
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(times) // HITS)) + 1):
            n = times[part]
            begin = np.cumsum(n) - n
            post = np.repeat(self.first[where[part]] - begin, n) + np.arange(int(n.sum()))
            yield np.repeat(at[part], n), np.repeat(doc[part], n), post


class Index:
    """The q-grams of the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float, piece: int):
        self.ids = [i for i, _ in items]
        cuts = [(k, p) for k, (_, text) in enumerate(items) for p in cut(text, piece)]
        self.owner, self.pieces = [k for k, _ in cuts], [p for _, p in cuts]
        self.of = np.bincount(self.owner, minlength=len(items)) if cuts else np.zeros(0, np.int64)
        sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.edits = (sizes * rate + 1e-9).astype(np.int64)
        q = np.minimum(Q, sizes // (self.edits + 1))
        self.least = sizes + 1 - q * (self.edits + 1)
        self.width = int(self.edits.max(initial=0)) + 1
        self.shift = int(sizes.max(initial=0))
        self.tables = [Table(int(k), [self.pieces[i] for i in np.flatnonzero(q == k)], np.flatnonzero(q == k).tolist(), self.edits[q == k]) for k in np.unique(q)]

    def regions(self, low: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, piece, least diagonal, largest diagonal) of bands that meet the bound."""
        n = len(self.pieces)
        for t in self.tables:
            # pairs of document and piece that share one of its rarest q-grams; others cannot reach the bound
            pairs = [np.zeros(0, np.int64)]
            for _, doc, post in t.hits(low, offsets):
                post, doc = post[t.rare[post]], doc[t.rare[post]]
                pairs.append(np.unique(doc * n + t.piece[post]))
            known = np.unique(np.concatenate(pairs))
            if not len(known):
                continue
            bands = (len(low) + 2 * self.shift) // self.width + 2
            cells, counts = [], []
            for at, doc, post in t.hits(low, offsets):
                pair = doc * n + t.piece[post]
                where = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                met = known[where] == pair
                cell = (at - offsets[doc] - t.place[post] + self.shift)[met] // self.width
                cell, times = np.unique(where[met] * bands + cell, return_counts=True)
                cells.append(cell)
                counts.append(times)
            key, inverse = np.unique(np.concatenate(cells), return_inverse=True)
            times = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
            # a band holds two neighbouring cells, so bands overlap by half
            follows = np.zeros(len(key), np.int64)
            follows[:-1] = np.where(key[1:] == key[:-1] + 1, times[1:], 0)
            pair = known[key // bands]
            for k in np.flatnonzero(times + follows >= self.least[pair % n]):
                begin = int(key[k]) % bands * self.width - self.shift
                yield int(pair[k]) // n, int(pair[k]) % n, begin, begin + 2 * self.width - 1


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int] | None:
    """(fewest edits, end) of the item against a stretch of text, on diagonals low..high widened by edits.

    The first row is free, so the stretch starts anywhere; None beyond `edits`.
    """
    low, high = low - edits, high + edits
    width = high - low + 1
    steps, far = np.arange(width), len(item) + len(text) + 1
    column = low + steps  # of row 0
    row = np.where((column >= 0) & (column <= len(text)), 0, far)
    for i in range(1, len(item) + 1):
        column = low + i + steps
        fits = (column >= 1) & (column <= len(text))
        differs = text[np.clip(column - 1, 0, max(len(text) - 1, 0))] != item[i - 1] if len(text) else np.ones(width, bool)
        new = np.where(fits, row + differs, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where(column == 0, i, np.where((column < 0) | (column > len(text)), far, new))
        row = np.minimum.accumulate(new - steps) + steps
        row[(column < 0) | (column > len(text))] = far
        if row.min() > edits:
            return None
    best = int(row.argmin())
    return int(row[best]), int(low + len(item) + best)


def _exact(part: np.ndarray, piece: np.ndarray, apart: bool) -> int:
    """Place of the piece in part, between ends of words if `apart`; -1 where there is none."""
    raw, wanted, at = part.tobytes(), piece.tobytes(), -1
    while (at := raw.find(wanted, at + 1)) >= 0:
        a, z = at // 4, at // 4 + len(piece)
        if at % 4 == 0 and not (apart and ((a > 0 and _wordlike(part[a - 1]) and _wordlike(piece[0])) or (z < len(part) and _wordlike(part[z]) and _wordlike(piece[-1])))):
            return a
    return -1


def located(index: Index, low: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(document, piece) -> (edits, start, end) of its best occurrence, in normalised characters of the document."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, i, least, most in index.regions(low, offsets):
        best = found.get((d, i))
        if best and best[0] == 0:
            continue
        text, piece, edits = low[offsets[d] : offsets[d + 1]], index.pieces[i], int(index.edits[i])
        # one character more on both sides, to see where words end
        begin = max(0, least - edits - 1)
        part = text[begin : max(0, most + len(piece) + edits + 1)]
        at = _exact(part, piece, edits == 0)
        if at >= 0:
            hit = (0, begin + at, begin + at + len(piece))
        elif edits == 0:
            continue
        else:
            got = aligned(piece, part, least - begin, most - begin, edits)
            if got is None or got[0] > edits:
                continue
            end = got[1]
            back = aligned(piece[::-1], part[:end][::-1], -edits, edits, edits)
            hit = (got[0], begin + end - (back[1] if back else len(piece)), begin + end)
        found[d, i] = min(best or hit, hit)
    return found


SCHEMA = "doc_id long, item_id long, edits long, start long, stop long, pieces long, of_pieces long"


def occurrences(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, piece: int = 160, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs and item that occurs in it: doc_id, item_id, edits, start, stop, pieces, of_pieces.

    An item of 2 * `piece` characters or more is cut into half overlapping pieces of at least `piece`, so
    that any part of it of 3/2 such pieces counts; a shorter one is one piece. Of `of_pieces` pieces, `pieces`
    occur; edits, start and stop are of the one with the fewest edits, the first in the text among equals.
    start and stop are code points of the whole text. A piece so short that it allows no edit must stand
    between ends of words. Rows of null or empty text have no occurrence, nor have items that are null,
    empty or blank. Repeated rows of docs come each; equal items come once; items of one id and different
    texts are items of their own. Items are sent to the executors in blocks of at most about
    `block_bytes`; each block scans all documents, in slices of 1 MB or one document.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    given, out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        block = [(i, x) for i, x in ((r.item_id, folded(r.text)) for r in sorted(rows)) if len(x)]
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, rate, piece))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                ids, out = b.column(0).to_pylist(), []
                for first, _, raw, raw_offsets in W.slices(b.column(1)):
                    low, offsets, at, char_at = _folded(raw, raw_offsets)
                    of_item: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
                    for (d, p), hit in located(index, low, offsets).items():
                        of_item[d, index.owner[p]].append(hit)
                    for (d, i), hits in sorted(of_item.items()):
                        edits, start, stop = min(hits)
                        place = at[offsets[d] : offsets[d + 1]] - char_at[d]
                        out.append((ids[first + d], index.ids[i], edits, int(place[start]), int(place[stop - 1]) + 1, len(hits), int(index.of[i])))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], [c.split()[0] for c in SCHEMA.split(", ")])

        part = given.mapInArrow(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an occurrence; rows of null id stay. Rows that share an id go together."""
    found = occurrences(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
