"""Ordered folds: one group's events in order, where the next step depends on all before."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = "source string, target string, type string"


def _edges_of(events: pd.DataFrame) -> list[tuple[str, str, str]]:
    """Edges of one session: inbound sources wait in `due` until a request that takes them finishes."""
    due: deque[tuple[str, str]] = deque()
    open_: dict[str, tuple[bool, list[tuple[str, str]]]] = {}
    slices: dict[str, set[str]] = {}
    made: list[tuple[str, str, str]] = []
    returned: set[str] = set()
    last: str | None = None
    spawn: str | None = None
    known = False

    def register(e: pd.Series) -> None:
        nonlocal spawn, known
        if not known:
            spawn = e.spawned_by
        known = True

    def start(e: pd.Series) -> None:
        nonlocal spawn, known
        known = True
        summary = e.compaction is not None
        taken: list[tuple[str, str]] = []
        if summary:
            slices.get(e.compaction, set()).add(e.request)
        else:
            taken = list(due)
            due.clear()
            if spawn is not None:
                taken.append((spawn, "subagent_call"))
                spawn = None
        if last is not None and last not in {s for s, _ in taken}:
            taken.append((last, "continuation"))
        open_[e.request] = (summary, taken)

    def finish(e: pd.Series) -> None:
        nonlocal last
        if e.request in open_:
            made.extend((s, e.request, t) for s, t in open_.pop(e.request)[1])
            last = e.request

    def fail(e: pd.Series) -> None:
        summary, taken = open_.pop(e.request, (True, []))
        if not summary:
            due.extendleft(reversed(taken))

    def compacted(e: pd.Series) -> None:
        own = slices.pop(e.compaction, set())
        if e.status == "completed" and last in own:
            for source in {s for s, _ in due}:
                if (source, last, "continuation") in made:
                    made.remove((source, last, "continuation"))
            made.extend((s, last, t) for s, t in due)
            due.clear()
            due.append((last, "compaction"))

    def child(e: pd.Series) -> None:
        nonlocal known
        known = True
        if e.child not in returned:
            returned.add(e.child)
            due.append((e.request, "subagent_return"))

    steps = {
        "session_registered": register,
        "request_started": start,
        "request_finished": finish,
        "request_failed": fail,
        "compaction_begun": lambda e: slices.__setitem__(e.compaction, set()),
        "compaction_finished": compacted,
        "child_returned": child,
    }
    for e in events.itertuples(index=False):
        if e.type in steps:
            steps[e.type](e)
    return made


def semantic_edges(events: DataFrame) -> DataFrame:
    """(source, target, type) from ledger events.

    Columns: file, line, type, session, request, compaction, status, child, spawned_by. Events that
    name only a request or a compaction get its session by a join first. Sessions are independent,
    so ledgers may come in any order; within a session, (file, line) is the order.
    """
    starts = events.where("type = 'request_started'").groupBy("request").agg(F.min("session").alias("_r"))
    begun = events.where("type = 'compaction_begun'").groupBy("compaction").agg(F.min("session").alias("_c"))
    placed = events.join(starts.withColumnRenamed("request", "_request"), (F.col("request") == F.col("_request")) & F.col("type").isin("request_finished", "request_failed"), "left")
    placed = placed.join(begun.withColumnRenamed("compaction", "_compaction"), (F.col("compaction") == F.col("_compaction")) & (F.col("type") == "compaction_finished"), "left")
    placed = placed.withColumn("session", F.coalesce("session", "_r", "_c")).where("session is not null")
    cols = ["file", "line", "type", "session", "request", "compaction", "status", "child", "spawned_by"]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["file", "line"]).astype(object)
        return pd.DataFrame(_edges_of(rows.where(rows.notna(), None)), columns=["source", "target", "type"])

    return placed.select(*cols).groupBy("session").applyInPandas(fold, EDGE)


def rate_limited(requests: DataFrame, key: str, order: str, at_ms: str, capacity: int = 3, refill_ms: int = 1000) -> DataFrame:
    """requests' (key, order) with `ok` and `retry_after_ms`, by a bucket of tokens that refills by whole steps."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "o"], kind="stable")
        tokens, since, out = capacity, None, []
        for now in rows["t"].tolist():
            since = now if since is None else since
            steps = max(0, now - since) // refill_ms
            tokens, since = min(capacity, tokens + steps), since + steps * refill_ms
            out.append((tokens > 0, None if tokens > 0 else max(1, since + refill_ms - now)))
            tokens -= tokens > 0
        return rows.assign(ok=[x for x, _ in out], retry=pd.array([y for _, y in out], dtype="Int64"))[["k", "o", "ok", "retry"]]

    keys = requests.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(at_ms).cast("long").alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in keys.schema.fields}
    return keys.groupBy("k").applyInPandas(fold, f"k {kinds['k']}, o {kinds['o']}, ok boolean, retry long").toDF(key, order, "ok", "retry_after_ms")


def claimed(jobs: DataFrame, ticks: DataFrame) -> DataFrame:
    """(job, tick, at, due): what each tick claims of interval jobs (job, next_ms, every_ms, busy_ms).

    At a tick a job that is due moves on to one interval after the tick (a job without an interval is
    done). It is claimed, unless its last claim still keeps it busy: then this run is skipped.
    """

    def fold(key: tuple, job: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        out, when = [], at.sort_values("at")
        times, names = when["at"].tolist(), when["tick"].tolist()
        for j in job.itertuples(index=False):
            due, free, k = j.next_ms, None, 0
            while due is not None and (k := bisect_left(times, due, k)) < len(times):
                if free is None or times[k] >= free:
                    out.append((j.job, names[k], times[k], due))
                    free = times[k] + j.busy_ms
                due, k = times[k] + j.every_ms if j.every_ms > 0 else None, k + 1
        return pd.DataFrame(out, columns=["job", "tick", "at", "due"])

    return jobs.groupBy("store").cogroup(ticks.groupBy("store")).applyInPandas(fold, "job string, tick long, at long, due long")


def applied_proposals(proposals: DataFrame) -> DataFrame:
    """(entity, version, value, conflicts) after create, update and delete in order (key `entity`, `ord`, `op`, `value`, `base`).

    An update or delete whose base version is not the current one, a create of what is there and a
    change of what is not there are conflicts and change nothing.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        version, value, alive, conflicts = 0, None, False, 0
        for e in rows.sort_values("ord").itertuples(index=False):
            fits = not alive if e.op == "create" else alive and (pd.isna(e.base) or int(e.base) == version)
            if not fits:
                conflicts += 1
                continue
            version, alive = version + 1, e.op != "delete"
            value = e.value if alive else None
        return pd.DataFrame({"entity": [rows["entity"].iloc[0]], "version": [version], "value": [value], "conflicts": [conflicts]})

    return proposals.groupBy("entity").applyInPandas(fold, "entity string, version long, value string, conflicts long")


def sessions_of_runs(events: DataFrame, session: str, order: str, is_start: Column, **aggregates: Column) -> DataFrame:
    """Runs of a session, numbered by their starts, with aggregates of each."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("run", F.sum(is_start.cast("long")).over(w)).where("run > 0")
    return numbered.groupBy(session, "run").agg(*(v.alias(k) for k, v in aggregates.items()))
