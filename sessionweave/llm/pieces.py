"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A space is written as the marker U+2581 and one is put before the text. Characters that no piece
covers, and a marker that stands in the text itself, are written as byte pieces, so decoding gives
the text back exactly. No piece has a marker after another character or a line break, so the best
path of a text is that of its stretches between such places, and frequent stretches are remembered.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import release

MARK = "▁"
#: the setting that names the model file, and where it is if that is not set
SETTING, MODEL = "sessionweave.pieces.model", "/opt/tokenizers/piece_bpe_32k.model"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Trie:
    """Double array: the child of state s by byte c is t = base[s] + c + 1, if check[t] == s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        nested: dict = {}
        for key, value in keys:
            node = nested
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        self.base, self.check, self.value = [0] * 512, [-1] * 512, [-1] * 512
        self.check[0] = 0
        # wide nodes are placed one after another, and single children fill the holes between them
        todo, free, wide = deque([(0, nested)]), 257, 0
        while todo:
            s, node = todo.popleft()
            self.value[s] = node.get(-1, -1)
            codes = sorted(c + 1 for c in node if c >= 0)
            if not codes:
                continue
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            base = free - codes[0] if len(codes) == 1 else max(wide, free - codes[0])
            base = max(base, 0)
            while True:
                if len(self.check) < base + 258:
                    grow = base + 258 + len(self.check) // 2
                    for x, empty in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        x.extend([empty] * (grow - len(x)))
                if all(self.check[base + c] < 0 for c in codes):
                    break
                base += 1
            if len(codes) > 1:
                wide = base
            self.base[s] = base
            for c in codes:
                self.check[base + c] = s
            todo.extend((base + c, node[c - 1]) for c in codes)


@dataclass
class Vocabulary:
    """Pieces with log scores; byte_ids[b] is the piece of byte b, -1 where there is none."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    trie: Trie
    raw: list[bytes] = field(default_factory=list)

    @staticmethod
    def of(pieces: list[tuple[str, float, bool]]) -> Vocabulary:
        """From (piece, log score, whether it takes part in the search), in order of id."""
        byte_ids, raw = [-1] * 256, []
        for i, (p, _, normal) in enumerate(pieces):
            m = _BYTE.fullmatch(p)
            if m and not normal:
                byte_ids[int(m[1], 16)] = i
                raw.append(bytes([int(m[1], 16)]))
            else:
                raw.append(p.replace(MARK, " ").encode() if normal else b"")
        keys = [(p.encode(), i) for i, (p, _, normal) in enumerate(pieces) if normal]
        return Vocabulary([p for p, _, _ in pieces], [s for _, s, _ in pieces], byte_ids, Trie(keys), raw)

    @staticmethod
    def loaded(path: str = MODEL) -> Vocabulary:
        """From a SentencePiece model file. Scores that are merge ranks become log scores of a Zipf law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = [(model.id_to_piece(i), model.get_score(i), not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))) for i in range(model.get_piece_size())]
        normal = [s for _, s, n in rows if n and s > -1e8]
        if all(s == int(s) for s in normal):
            total = float(np.log((1.0 / (1.0 - np.array(normal))).sum()))
            rows = [(p, -float(np.log(1.0 - max(s, -1e8))) - total if n else s, n) for p, s, n in rows]
        return Vocabulary.of(rows)


class Coder:
    def __init__(self, vocabulary: Vocabulary, remembered: int = 150_000):
        self.v = vocabulary
        self.least = min((vocabulary.scores[i] for i in vocabulary.trie.value if i >= 0), default=0.0) - 10.0
        inner = any(MARK in p.lstrip(MARK) or "\n" in p for p in vocabulary.pieces)
        # stretches: a marker of the text; a line break; spaces and what follows them
        self.cut = re.compile(f"{MARK}|[^{MARK}]+" if inner else f"{MARK}|\n| *[^ \n{MARK}]+| +").findall
        self.remembered = remembered
        self.memory: dict[str, bytes] = {}
        trie = vocabulary.trie
        spare = np.full(258, -1)
        self.base, self.check, self.value = (np.concatenate([x, spare]).astype(np.int64) for x in (trie.base, trie.check, trie.value))
        self.score = np.array(vocabulary.scores + [0.0])

    def search(self, stretch: str) -> bytes:
        """Ids of the best path as int32. Among equal sums the longer last piece wins."""
        v = self.v
        base, check, value, scores = v.trie.base, v.trie.check, v.trie.value, v.scores
        if stretch == MARK:
            return np.array(self._fallback(MARK.encode()), np.int32).tobytes()
        text = stretch.replace(" ", MARK).encode()
        n, low, size = len(text), -1e300, len(check)
        # sixteen bytes for each byte of the stretch, however long it is
        best, start, last = array("d", [low]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == low:
                continue
            first = text[i]
            char = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            s, covered = 0, False
            for j in range(i, n):
                t = base[s] + text[j] + 1
                if t >= size or check[t] != s:
                    break
                s = t
                piece = value[s]
                if piece >= 0:
                    covered |= j + 1 == i + char
                    sum_ = here + scores[piece]
                    if sum_ > best[j + 1]:
                        best[j + 1], start[j + 1], last[j + 1] = sum_, i, piece
            if not covered and here + self.least > best[i + char]:
                best[i + char], start[i + char], last[i + char] = here + self.least, i, -1
        ids, at = array("i"), n
        while at:
            i, piece = start[at], last[at]
            ids.extend([piece] if piece >= 0 else self._fallback(text[i:at])[::-1])
            at = i
        return np.array(ids, np.int32)[::-1].tobytes()

    def search_many(self, stretches: list[str], cells: int = 1 << 20, longest: int = 64) -> list[bytes]:
        """search() of many stretches at once: the trie is walked for all of one width together."""
        raw = [s.replace(" ", MARK).encode() for s in stretches]
        out: list[bytes] = [b""] * len(raw)
        order = sorted((i for i in range(len(raw)) if len(raw[i]) <= longest and stretches[i] != MARK), key=lambda i: len(raw[i]))
        for i in range(len(raw)):
            if len(raw[i]) > longest or stretches[i] == MARK:
                out[i] = self.search(stretches[i])
        at = 0
        while at < len(order):
            width = len(raw[order[min(at + cells // 16, len(order) - 1)]])
            chunk = order[at : at + max(1, cells // max(width, 16))]
            at += len(chunk)
            for i, ids in zip(chunk, self._searched([raw[i] for i in chunk]), strict=True):
                out[i] = self.search(stretches[i]) if ids is None else ids
        return out

    def _searched(self, raw: list[bytes]) -> list[bytes | None]:
        """Best paths of texts of similar length; None for one that needs byte pieces."""
        size = np.array([len(r) for r in raw])
        n, width = len(raw), int(size.max())
        text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n, width).astype(np.int64)
        best = np.full((n, width + 1), -np.inf)
        start, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0.0
        for i in range(width):
            rows = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
            first = text[rows, i]
            char = i + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            bare = np.ones(len(rows), bool)
            k, s = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for j in range(i, width):
                inside = size[rows[k]] > j
                k, s = k[inside], s[inside]
                t = self.base[s] + text[rows[k], j] + 1
                there = self.check[t] == s
                k, s = k[there], t[there]
                if not len(k):
                    break
                p = self.value[s]
                ends = p >= 0
                at, p = k[ends], p[ends]
                bare[at[char[at] == j + 1]] = False
                row = rows[at]
                total = best[row, i] + self.score[p]
                better = total > best[row, j + 1]
                row = row[better]
                best[row, j + 1], start[row, j + 1], piece[row, j + 1] = total[better], i, p[better]
            row, end = rows[bare], char[bare]
            total = best[row, i] + self.least
            better = total > best[row, end]
            row, end = row[better], end[better]
            best[row, end], start[row, end], piece[row, end] = total[better], i, -1
        steps, here = [], size.copy()
        while (live := np.flatnonzero(here > 0)).size:
            steps.append((live, piece[live, here[live]]))
            here[live] = start[live, here[live]]
        rows = np.concatenate([r for r, _ in steps])
        ids = np.concatenate([p for _, p in steps]).astype(np.int32)
        order = np.lexsort((-np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps]), rows))
        rows, ids = rows[order], ids[order]
        whole = np.ones(n, bool)
        whole[rows[ids < 0]] = False
        edges = np.searchsorted(rows, np.arange(n + 1)) * 4
        flat = ids.tobytes()
        return [flat[edges[r] : edges[r + 1]] if whole[r] else None for r in range(n)]

    def _fallback(self, raw: bytes) -> list[int]:
        ids = [self.v.byte_ids[b] for b in raw]
        if min(ids) < 0:
            raise ValueError("the vocabulary lacks byte pieces")
        return ids

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; an empty one has none."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.memory)
        if len(self.memory) + len(new) > self.remembered:
            self.memory.clear()
            new = set().union(*cut)
        new = sorted(new)
        self.memory.update(zip(new, self.search_many(new), strict=True))
        return [np.frombuffer(b"".join(map(self.memory.__getitem__, c)), np.int32) for c in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.v.raw.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", errors="replace")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_byte_tokens, token_ids, restored.

    restored says that decoding token_ids gives the text. A null text has null ids and null restored,
    and no tokens; an empty one has an empty array. Among paths of equal sums the one with the longer
    last piece is taken. A stretch without a space, however long, is searched as one; rows that share
    an id or are equal are encoded each for itself. The model file is `path`, or what SETTING names.
    """
    path = path or docs.sparkSession.conf.get(SETTING, MODEL)
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.loaded(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        is_byte = np.zeros(len(coder.v.pieces), bool)
        is_byte[[i for i in coder.v.byte_ids if i >= 0]] = True
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ids = coder.encode_many([t or "" for t in texts])
                sizes = np.array([len(x) for x in ids], np.int64)
                null = np.array([t is None for t in texts], bool)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(np.concatenate(ids)))
                same = [None if t is None else coder.decode(x) == t for t, x in zip(texts, ids, strict=True)]
                n_bytes = np.array([int(is_byte[x].sum()) for x in ids], np.int64)
                yield pa.record_batch([part.column(0), pa.array(sizes), pa.array(n_bytes), lists, pa.array(same, pa.bool_())], names)
        coder.memory.clear()
        release()

    schema = "doc_id long, n_tokens long, n_byte_tokens long, token_ids array<int>, restored boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)
