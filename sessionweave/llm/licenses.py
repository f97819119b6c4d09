"""License scans by a positional index over the rarest words of every licence notice.

Templates are word sequences of well-known licence notices, of passages of whole licence texts that are
theirs alone, and of one-line identifiers. Of each template, words are looked up
from the highest IDF over all documents down, until those left out weigh too little to make a hit;
so every place that could be a hit is voted for, whatever else the file holds. Places with the
template's mandatory phrases are hits.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: phrases whose places are counted, with their labels
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: fixed values: (label, notice, mandatory phrases), from the public texts of the licences
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("use copy modify merge publish distribute sublicense",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license version 2",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu lesser general public license",)),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish use compile sell or distribute this software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages",)),
    ("bsl-1", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to public license",)),
    ("ofl-1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
)
#: fixed values: identifiers that stand in one line of a file, with their labels
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl-3", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd",
    "mpl 2 0": "mpl-2", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc0 1 0": "cc0", "isc": "isc", "unlicense": "unlicense", "zlib": "zlib", "bsl 1 0": "bsl-1", "epl 2 0": "epl-2", "wtfpl": "wtfpl", "ofl 1 1": "ofl-1",
}
NOTICES = TEMPLATES + tuple((label, f"spdx license identifier {name}", (f"spdx license identifier {name}",)) for name, label in IDENTIFIERS.items())

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split(b" ")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    must: tuple[tuple[bytes, ...], ...]


def templates(given: tuple[tuple[str, str, tuple[str, ...]], ...] = NOTICES) -> tuple[Template, ...]:
    cut = lambda s: tuple(w for w in words(s.encode()) if w)
    return tuple(Template(label, cut(text), tuple(cut(m) for m in must)) for label, text, must in given)


def _occurs(file: list[bytes], phrase: tuple[bytes, ...], first: int) -> bool:
    return 0 <= first and tuple(file[first : first + len(phrase)]) == phrase


class Scanner:
    def __init__(self, known: tuple[Template, ...], idf: dict[bytes, float], share: float):
        self.known, self.idf, self.share = known, idf, share
        self.phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(known):
            weight = [idf.get(w, 0.0) for w in template.words]
            left = total = sum(weight)
            # a place where none of the words taken stands has at most `left` of the weight
            for place in sorted(range(len(weight)), key=lambda k: (-weight[k], template.words[k], k)):
                if left < share * total * (1 - 1e-9):
                    break
                self.postings[template.words[place]].append((t, place))
                left -= weight[place]
        self.vocabulary = frozenset(self.postings) | {p[0] for p, _ in self.phrases}
        # no hit or phrase without one of these byte strings, so most files need no word list
        self.probe = re.compile(b"|".join(sorted({re.escape(max((w for m in t.must for w in m), key=len)) for t in known} | {re.escape(max(p, key=len)) for p, _ in self.phrases})), re.I)

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        folded = text.translate(_FOLD)
        file = folded.split()
        if not self.probe.search(folded):
            return len(file), 0, None, None, [], [], 0.0
        where: dict[bytes, list[int]] = defaultdict(list)
        for i, word in enumerate(file):
            if word in self.vocabulary:
                where[word].append(i)
        places, base = [], set()
        for phrase, label in self.phrases:
            hits = [i for i in where.get(phrase[0], ()) if _occurs(file, phrase, i)]
            places += hits
            base |= {label} if hits else set()
        found, score = set(base), 1.0 if base else 0.0
        places_of = {(t, i - place) for word in where if word in self.postings for t, place in self.postings[word] for i in where[word]}
        # a posting says where its template begins; the whole template is then compared there
        for t, begin in sorted(places_of):
            template = self.known[t]
            weight = [self.idf.get(w, 0.0) for w in template.words]
            same = sum(x for k, (w, x) in enumerate(zip(template.words, weight, strict=True)) if 0 <= begin + k < len(file) and file[begin + k] == w)
            likeness = same / (sum(weight) or 1.0)
            lo, hi = max(0, begin), begin + len(template.words)
            if likeness >= self.share and all(any(_occurs(file, m, i) for i in range(lo, hi - len(m) + 1)) for m in template.must):
                found.add(template.label)
                score = max(score, likeness)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(file), len(places), first, last, sorted(base), sorted(found), min(score, 1.0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield (x.as_py() or "").encode()


def frequencies(docs: DataFrame, known: tuple[Template, ...]) -> tuple[int, dict[bytes, int]]:
    """Documents, and for each template word how many hold it, over all of docs."""
    vocabulary = sorted({w for t in known for w in t.words})
    wanted = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in _texts(b.column(0)):
                seen[b""] += 1
                seen.update(wanted.intersection(text.translate(_FOLD).split()))
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    # as many rows as there are template words
    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    held = {bytes(r.word): r.n for r in rows}
    return held.pop(b"", 0), held


def scanned(docs: DataFrame, given: tuple[tuple[str, str, tuple[str, ...]], ...] = NOTICES, share: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word, last_word and base_labels are of PHRASES; labels adds those of templates of
    which at least `share` of the IDF weight stands at its place, anywhere in the file. score is
    the best such share, 1 for a phrase; notices that tie, or hold one another, all give their labels.
    Null and empty texts have no words. Rows that share an id are files of their own.
    """
    known = templates(given)
    n, held = frequencies(docs, known)
    idf = {w: math.log((n + 1) / (held.get(w, 0) + 1)) + 1e-9 for t in known for w in t.words}
    scanner = Scanner(known, idf, share)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scanner.scan(t) for t in _texts(b.column(1))]
            yield pa.record_batch(
                [
                    b.column(0),
                    *(pa.array([g[k] for g in got], pa.int64()) for k in range(4)),
                    *(pa.array([",".join(g[k]) for g in got], pa.string()) for k in (4, 5)),
                    pa.array([g[6] for g in got], pa.float64()),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCHEMA)
