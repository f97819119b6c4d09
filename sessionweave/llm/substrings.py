"""Substring dedup by repeated-phrase automata.

Recurring passages are confirmed by counting windows among the stretches around repeated anchors: each
passage once, from one of its places. One Aho-Corasick automaton per shard of anchors is compiled from
them, and every stretch of every document that holds an anchor of the shard is streamed through it,
which alone says where passages stand. Text without such an anchor holds no passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordhash as W
from .repeats import covers, doc_id, keyed


def _numbered(stretches: list[bytes]) -> list[np.ndarray]:
    """Words as numbers, equal for equal words of the group."""
    names: dict[bytes, int] = {}
    return [np.array([names.setdefault(w, len(names) + 1) for w in s.split(b" ")], np.int64) for s in stretches]


def phrases(ids: list[np.ndarray], counts: list[int], window: int) -> list[np.ndarray]:
    """The recurring passages of a group, each once, from sequences of word numbers and their counts.

    Windows that stand twice or more are confirmed by hash. Two of them belong to one phrase when each
    place of the first goes on to the second, and each place of the second comes from the first; so
    wherever a confirmed window stands, its whole phrase stands, and the words of one place of it do.
    """
    sizes = np.array([len(x) for x in ids], np.int64)
    flat, owner = np.concatenate(ids).astype(np.uint64), np.repeat(np.arange(len(ids)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = np.flatnonzero(np.arange(len(flat)) - begin[owner] + window <= sizes[owner])
    if not len(at):
        return []
    owner = owner[at]
    _, place, kind = np.unique(W.grams(W.mix(flat), window)[at], return_index=True, return_inverse=True)
    twice = np.bincount(kind, np.array(counts, float)[owner]) > 1
    follows = owner[1:] == owner[:-1]
    after, before = np.full(len(at), -1), np.full(len(at), -1)
    after[:-1][follows], before[1:][follows] = kind[1:][follows], kind[:-1][follows]
    only = lambda near: np.where((low := _least(kind, near, len(place))) == -_least(kind, -near, len(place)), low, -1)
    next_, prior = only(after), only(before)
    k = np.arange(len(place))
    goes_on = (next_ >= 0) & (prior[next_] == k)
    comes_from = (prior >= 0) & (next_[prior] == k)
    # from the first place of a phrase's first window, windows follow one another to its last
    last = np.flatnonzero(~goes_on[kind])
    first = place[twice & ~comes_from]
    end = last[np.searchsorted(last, first)]
    return [flat[at[a] : at[z] + window].astype(np.int64) for a, z in zip(first, end, strict=True)]


def _least(kind: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, kind, value)
    return out


def compiled(known: list[np.ndarray]) -> ahocorasick.Automaton:
    """One shard's automaton: its letters are words, its entries the phrases by number."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, phrase in enumerate(known):
        automaton.add_word(tuple(phrase.tolist()), i)
    automaton.make_automaton()
    return automaton


def located(stretches: list[bytes], counts: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Occurrences in each stretch of the shard's recurring phrases, as runs of words.

    The automaton alone finds places, by the words themselves: a phrase that it finds at one place only
    recurred by hash and not by words, and is none.
    """
    ids = _numbered(stretches)
    known = phrases(ids, counts, window)
    out: list[list[tuple[int, int]]] = [[] for _ in ids]
    if not known:
        return out
    automaton, hits = compiled(known), []
    for o, x in enumerate(ids):
        hits += [(o, last + 1 - len(known[i]), last + 1, i) for last, i in automaton.iter(tuple(x.tolist()))]
    times = [0] * len(known)
    for o, _, _, i in hits:
        times[i] += counts[o]
    for o, a, z, i in sorted(hits):
        if times[i] < 2:
            continue
        if out[o] and a <= out[o][-1][1]:
            out[o][-1] = (out[o][-1][0], max(z, out[o][-1][1]))
        else:
            out[o].append((a, z))
    return out


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def removed(docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Every word goes that a window of `window` words covers whose words also start anywhere else,
    the same document included. Null and empty texts have no words. Rows that share an id, or have
    none, are documents of their own.
    """
    given = keyed(docs)
    joined = given.join(covers(given, located, window).hint("merge"), ["row", "part"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                kept, at = [], 0
                edges = spans.as_py() or []
                for a, z in zip(edges[::2], edges[1::2], strict=True):
                    kept += words[at:a]
                    at = z
                kept += words[at:]
                whole = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode() if with_text else None))
            n, gone, sha, whole = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(whole, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = joined.select(doc_id(), "text", "spans").mapInArrow(cut, SCHEMA)
    return out if with_text else out.drop("kept_text")
