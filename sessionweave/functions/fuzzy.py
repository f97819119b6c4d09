"""Search: a small query language, substring and regular expression in SQL, fuzzy match as a UDF."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import search_key

#: fixed values: the largest score of a fuzzy token; points for runs, word starts, gaps, places and equality
WORST, RUN, START, GAP, PLACE, EQUAL, SWAPPED = 25.0, 5, 10, 2, 0.1, 100, 5
_BREAK = re.compile(r"[\s\-_./:]")


def _placed(query: str, text: str) -> float | None:
    """Score of the leftmost placing of the query's characters in order; None without one."""
    at, places = 0, []
    for c in query:
        at = text.find(c, at) + 1
        if not at:
            return None
        places.append(at - 1)
    if not places:
        return 0.0
    score, run, before = PLACE * sum(places), 0, -1
    for p in places:
        # the first character at place 0 continues a run that begins before the text
        run = run + 1 if p == before + 1 else 0
        score += -RUN * run if run else GAP * (p - before - 1) if before >= 0 else 0
        score -= START if p == 0 or _BREAK.match(text[p - 1]) else 0
        before = p
    return score - (EQUAL if query == text else 0)


def fuzzy_score(query: str, text: str) -> float | None:
    """Lower is better, None for no match. Letters then digits (or the reverse) are tried swapped too."""
    query, text = query.lower(), text.lower()
    found = _placed(query, text)
    if found is None and (m := re.fullmatch(r"([a-z]+)([0-9]+)|([0-9]+)([a-z]+)", query)):
        found = _placed((m[2] or m[4]) + (m[1] or m[3]), text)
        return None if found is None else found + SWAPPED
    return found


def fuzzy(query: str):  # noqa: ANN201
    """Column function text -> score of all words of the query summed; null where one does not match."""
    words = query.split()

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        out = np.full(len(text), np.nan)
        for i, t in enumerate(text.fillna("")):
            scores = [fuzzy_score(w, t) for w in words]
            if None not in scores:
                out[i] = sum(scores)
        return pd.Series(out)

    return lambda c: F.nanvl(run(c), F.lit(None).cast("double"))


def fuzzy_filter(df: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows that match, with `score`."""
    return df.withColumn("score", fuzzy(query)(text)).where("score is not null")


@dataclass(frozen=True)
class Query:
    pattern: str | None
    tokens: tuple[tuple[str, str], ...]
    error: bool = False


def parse_query(text: str) -> Query:
    """`re:` and a pattern, or words and "phrases"; with an open quote all are words."""
    text = text.strip()
    if text.startswith("re:"):
        pattern = text[3:].strip()
        try:
            re.compile(pattern)
        except re.error:
            return Query(None, (), True)
        return Query(pattern, (), not pattern)
    if text.count('"') % 2:
        return Query(None, tuple(("fuzzy", w) for w in text.split()))
    tokens: list[tuple[str, str]] = []
    for i, part in enumerate(text.split('"')):
        tokens += [("phrase", part.strip())] if i % 2 and part.strip() else [] if i % 2 else [("fuzzy", w) for w in part.split()]
    return Query(None, tuple(tokens))


def search_score(text: Column, query: Query) -> Column:
    """Sum over tokens of a tenth of the place of a hit, else the fuzzy score up to WORST; null for no match."""
    if query.error:
        return F.lit(None).cast("double")
    if query.pattern is not None:
        at = F.regexp_instr(text, F.lit("(?i)" + query.pattern))
        return F.when(at > 0, (at - 1) * F.lit(PLACE))
    key, total = search_key(text), F.lit(0.0)
    for kind, value in query.tokens:
        needle = " ".join(value.lower().split())
        at = F.instr(key, needle)
        hit = F.when(at > 0, (at - 1) * F.lit(PLACE))
        if kind == "fuzzy":
            close = fuzzy(value)(text)
            hit = hit.otherwise(F.when(close <= WORST, close))
        total = total + hit
    return total
