"""Substring dedup by sparse suffix arrays.

Only suffixes that start at content-selected minimisers are kept. They are sorted, each is compared
with its neighbours, and matches are extended to the left by the same sort of what stands before the
suffixes; words in a match of at least `window` words with another place are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordhash as W
from .repeats import K, covers, doc_id, keyed, runs_of


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of word numbers, and how many words each shares with its predecessor."""
    flat = np.ascontiguousarray(rows.astype(">u4"))
    order = np.argsort(flat.view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    near = rows[order]
    differ = near[1:] != near[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.concatenate([[-1], common])


def _around(ids: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where((at >= low[:, None]) & (at < high[:, None]), ids[np.clip(at, 0, len(ids) - 1)], 0)


def matched(stretches: list[bytes], counts: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Words of each stretch in matches of at least `window` words with another place.

    Suffixes that share r words stand together in the suffix array, and places that share l words
    before them stand together in the array of what stands before; a window is a match of l and
    r = window - l, so it is repeated when both neighbourhoods hold another place.
    """
    data = np.frombuffer(b"".join(stretches), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in stretches])]).astype(np.int64)
    w = W.split(data, offsets)
    hashes = w.hashes()
    ids = np.unique(hashes, return_inverse=True)[1] + 1
    _, owner, lo, hi, place = W.anchors(w, hashes, K, window)
    if not len(owner):
        return [[] for _ in stretches]
    begin, end = w.bounds[owner], w.bounds[owner + 1]
    here = begin + place
    after, shared_after = _sorted(_around(ids, here[:, None] + np.arange(window), begin, end))
    before, shared_before = _sorted(_around(ids, here[:, None] - 1 - np.arange(window - K), begin, end))
    weight = np.array(counts, float)[owner]
    owners, firsts = [], []
    group = np.zeros((2, len(owner)), np.int64)
    for left in range(window - K + 1):
        group[0, after] = np.cumsum(shared_after < window - left)
        group[1, before] = np.cumsum(shared_before < left)
        first = place - left
        fits = np.flatnonzero((first >= lo) & (first <= hi))
        if len(fits):
            _, kind = np.unique(group[0, fits] * (len(owner) + 1) + group[1, fits], return_inverse=True)
            twice = fits[np.bincount(kind, weight[fits])[kind] > 1]
            owners.append(owner[twice])
            firsts.append(first[twice])
    owners, firsts = np.concatenate(owners), np.concatenate(firsts)
    order = np.lexsort((firsts, owners))
    return runs_of(owners[order], firsts[order], window, len(stretches))


def repeated(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per row of docs with a repeated passage: doc_id, n_repeated, n_spans, spans.

    A passage is repeated when `window` or more consecutive words of it stand elsewhere too, the same
    document included; all its places are reported. spans are first:end words, comma-joined. Null and
    empty texts have none. Rows that share an id, or have none, are documents of their own, and equal
    rows come once.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [np.array(x.as_py(), np.int64).reshape(-1, 2) for x in b.column(1)]
            words = [int((x[:, 1] - x[:, 0]).sum()) for x in spans]
            shown = [",".join(f"{a}:{z}" for a, z in x) for x in spans]
            yield pa.record_batch([b.column(0), pa.array(words, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(shown, pa.string())], ["doc_id", "n_repeated", "n_spans", "spans"])

    found = covers(keyed(docs), matched, window)
    return found.select(doc_id(), "spans").mapInArrow(told, "doc_id long, n_repeated long, n_spans long, spans string")
