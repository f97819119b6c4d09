"""Words, hashes and anchors of batches against plain Python."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionweave.llm import wordhash as W

texts = st.lists(st.one_of(st.none(), st.text("ab é\t\n\x0b\x1c ", max_size=60)), max_size=8)


def plain(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


@settings(max_examples=150, deadline=None)
@given(texts, st.sampled_from([1, 20, 1 << 20]))
def test_words_and_hashes(rows, most):  # noqa: ANN001
    names: dict[bytes, int] = {}
    seen = []
    for first, _, data, offsets in W.slices(pa.array(rows, pa.string()), most):
        w = W.split(data, offsets, first)
        raw = data.tobytes()
        got = [raw[a:z] for a, z in zip(w.starts, w.ends, strict=True)]
        for i in range(w.n_docs):
            seen.append(got[w.bounds[i] : w.bounds[i + 1]])
        for word, h in zip(got, w.hashes().tolist(), strict=True):
            assert names.setdefault(word, h) == h
    assert seen == [plain(t) for t in rows]
    assert len(set(names.values())) == len(names)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["x", "y", "zz"]), max_size=40).map(" ".join), min_size=1, max_size=5))
def test_equal_windows_meet(rows):  # noqa: ANN001
    k, window = 3, 7
    meets: dict[tuple, set] = defaultdict(set)
    for w in W.words(pa.array(rows)):
        g, doc, lo, hi, at = W.anchors(w, w.hashes(), k, window)
        whole = [0] * w.n_docs
        for h, d, a, z, p in zip(g.tolist(), doc, lo, hi, at, strict=True):
            own = plain(rows[d])
            whole[d] += z - a + 1
            for s in range(a, z + 1):
                assert s <= p <= s + window - k
                meets[tuple(own[s : s + window])].add((h, p - s))
        assert whole == [max(0, len(plain(r)) - window + 1) for r in rows]
    assert all(len(v) == 1 for v in meets.values())


def test_lower_and_grams():
    a, b = (next(W.words(pa.array([t]))).hashes(lower=True) for t in ("AbC é", "aBc é"))
    assert (a == b).all()
    x = np.arange(1, 9, dtype=np.uint64)
    g = W.grams(np.concatenate([x, x]), 4)
    assert (g[:5] == g[8:13]).all() and len(set(g[:5].tolist())) == 5 and not g[13:].any()
    assert W.sliding_min(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]
