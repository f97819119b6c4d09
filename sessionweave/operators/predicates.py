"""Classes and conditions of sessions, agents, daemons and calls, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: what providers say when a prompt does not fit, and what excludes that reading
OVERFLOW = (
    r"prompt is too long",
    r"request_too_large",
    r"input is too long for requested model",
    r"exceeds the context window",
    r"input token count.*exceeds the maximum",
    r"maximum prompt length is \d+",
    r"reduce the length of the messages",
    r"maximum context length is \d+ tokens",
    r"exceeds the limit of \d+",
    r"exceeds the available context size",
    r"greater than the context length",
    r"context window exceeds limit",
    r"exceeded model token limit",
    r"too large for model with \d+ maximum context length",
    r"model_context_window_exceeded",
    r"prompt too long; exceeded (?:max )?context length",
    r"context[_ ]length[_ ]exceeded",
    r"too many tokens",
    r"token limit exceeded",
    r"^4(?:00|13)\s*(?:status code)?\s*\(no body\)",
)
NOT_OVERFLOW = (r"^(Throttling error|Service unavailable):", r"rate limit", r"too many requests")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def context_overflow(stop_reason: Column, error: Column, used: Column, window: Column) -> Column:
    """An error that says so, or a call that went through with more input than the window holds."""
    said = (stop_reason == "error") & _any(error, OVERFLOW) & ~_any(error, NOT_OVERFLOW)
    silent = (stop_reason == "stop") & (window > 0) & (used > window)
    return F.coalesce(said, F.lit(False)) | F.coalesce(silent, F.lit(False))


def should_compact(tokens: Column, window: Column, reserve: int, enabled: bool = True) -> Column:
    return F.lit(enabled) & (window > 0) & (tokens > window - reserve)


def agent_status(queued: Column, resident: Column, busy: Column) -> Column:
    return F.when(queued, "running").when(~resident, "inactive").when(busy, "running").otherwise("idle")


def lifecycle(archived: Column, messages: Column) -> Column:
    return F.when(archived, "archived").when(messages > 0, "live").otherwise("draft")


def session_state(raw: Column) -> Column:
    """Stored state as it is understood today; null for what is not valid."""
    return F.when(raw.isin("sleep", "hidden", "archived"), "archived").when(raw == "live", "live")


def limit_reason(used: list[tuple[str, Column, Column]]) -> Column:
    """Name of the first limit that is reached, in the order given as (name, used, limit)."""
    out = F
    for name, have, most in used:
        out = out.when(have >= most, name)
    return out


def idle_for(last: Column, now: Column, interval_ms: int) -> Column:
    return F.unix_millis(now) - F.unix_millis(last) >= interval_ms


def due(status: Column, next_run: Column, now: Column) -> Column:
    return (status == "active") & (next_run <= now)


def evictable(workers: DataFrame, worker: str, session_ok: Column) -> DataFrame:
    """Workers all of whose sessions may go."""
    return workers.groupBy(worker).agg(F.bool_and(session_ok).alias("evict")).where("evict").select(worker)


def reap_plan(daemons: DataFrame, force: bool) -> DataFrame:
    """daemons (pid, status, is_default, sessions) with `action`: remove-file, kill, shutdown or skip."""
    same = F.count("pid").over(Window.partitionBy("pid"))
    lost = F.when(F.lit(force) & F.col("pid").isNotNull() & (same == 1), "kill").otherwise("skip")
    action = (
        F.when(F.col("status") == "orphan-file", "remove-file")
        .when(F.col("is_default"), "skip")
        .when(F.col("status") == "unreachable", lost)
        .when(F.coalesce(F.col("sessions") != 0, F.lit(True)), "skip")
        .otherwise("shutdown")
    )
    return daemons.withColumn("action", action)


def roster_order(section: Column, messages: Column, anchor: Column, heartbeat: Column, busy_children: Column, active: Column, created: Column, title: Column, id_: Column) -> list[Column]:
    """Sort keys of a list of agents: section, empty ones last, then what matters in the section, newest first, title."""
    rank = F.when(section == "running", 0).when(section == "idle", 1).otherwise(2)
    empty = F.when((messages == 0) & ~anchor, 1).otherwise(0)
    beat = F.when(section == "inactive", F.coalesce(heartbeat, F.lit(False)).cast("int")).otherwise(0)
    quiet = section != "running"
    return [
        rank.asc(),
        empty.asc(),
        beat.desc(),
        F.when(quiet, (busy_children > 0).cast("int")).otherwise(0).desc(),
        F.when(quiet, F.coalesce(F.unix_millis(active), F.lit(0))).otherwise(0).desc(),
        F.coalesce(F.unix_millis(created), F.lit(0)).desc(),
        F.collate(title, "UNICODE").asc(),
        F.collate(id_, "UNICODE").asc(),
    ]


def shown(entries: DataFrame, mode: str, query: str = "", leaf: str | None = None) -> DataFrame:
    """Entries of a tree view: (id, type, role, text, stop_reason, label, is_tool) by mode and words of a query.

    Assistant rows without text go unless they failed or are the leaf.
    """
    bookkeeping = F.col("type").isin("label", "custom", "model_change", "thinking_level_change")
    silent = (F.col("role") == "assistant") & (F.trim("text") == "") & ~F.coalesce(F.col("stop_reason").isin("error", "aborted"), F.lit(False)) & (F.col("id") != F.lit(leaf or ""))
    by_mode = {
        "default": ~bookkeeping,
        "no-tools": ~bookkeeping & ~F.col("is_tool"),
        "user-only": F.col("role") == "user",
        "labeled-only": F.col("label").isNotNull(),
        "all": F.lit(True),
    }[mode]
    words = F.forall(F.array(*(F.lit(w) for w in query.lower().split())).cast("array<string>"), lambda w: F.contains(F.lower(F.concat_ws(" ", "label", "role", "text")), w))
    return entries.where(F.coalesce(by_mode, F.lit(False)) & ~F.coalesce(silent, F.lit(False)) & words)
