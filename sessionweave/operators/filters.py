"""Conditions and choices of reports, lists of agents and daemons, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the order of a daemon list
DAEMON_STATUS = ("current", "stale", "unreachable", "orphan-file")
#: the largest time that counts as one, in milliseconds
MOST_MS = 8_640_000_000_000_000


def of_model(provider_model: Column, part: str | None) -> Column:
    """Whether a model is asked for by a part of its name, in either case; no part asks for all."""
    return F.contains(F.lower(provider_model), F.lit(part.lower())) if part else F.lit(True)


def calls(provider_model: Column, extension: Column, success: Column, model: str | None = None, ext: str | None = None, failed_only: bool = False) -> Column:
    """Edit or read calls of a report: by model, file extension, and those known to have failed."""
    out = of_model(provider_model, model)
    out = out & (extension == ext) if ext else out
    return out & F.coalesce(~success, F.lit(False)) if failed_only else out


def reported(provider_model: Column, commands: Column, model: str | None = None, prefixes: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> Column:
    """Sessions of a report: by a part of the model, any of some prefixes of it, any of some texts in any command."""
    out, low = of_model(provider_model, model), F.lower(provider_model)
    if prefixes:
        out = out & F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(low, F.lower(p)))
    if texts:
        out = out & F.exists(commands, lambda c: F.exists(F.array(*map(F.lit, texts)), lambda t: F.contains(F.lower(c), F.lower(t))))
    return out


def cutoff(asked: Column, born: Column) -> Column:
    """From when a report counts: what was asked for, or the birth of a file."""
    return F.coalesce(asked, born)


def is_session(kind: Column, id_: Column) -> Column:
    return F.coalesce((kind == "session") & id_.isNotNull(), F.lit(False))


def has_spawn_code(code: Column) -> Column:
    return F.coalesce(F.trim(code) != "", F.lit(False))


def visible(lifecycle: Column, put_away: Column) -> Column:
    return ~put_away & (lifecycle == "live")


def is_empty(messages: Column) -> Column:
    return messages == 0


def activity(busy: Column, kind: Column, messages: Column, verdict_current: Column) -> Column:
    """working or idle: an idle session that is no subagent and not empty works until it has a verdict."""
    idle = (F.coalesce(kind, F.lit("")) == "subagent") | (messages == 0) | verdict_current
    return F.when(busy | ~idle, "working").otherwise("idle")


def selectable(pauses: Column, *busy: Column) -> Column:
    """Whether a session can take its next action: nothing is at work and nobody holds it."""
    out = pauses == 0
    for b in busy:
        out = out & ~b
    return out


def passivable(has_parent: Column, busy_below: Column, hydrating: Column, idle: Column) -> Column:
    return has_parent & ~busy_below & ~hydrating & idle


def latest_activity(ms: Column) -> Column:
    """Latest time of a group's messages that is one."""
    return F.max(F.when(F.abs(ms) <= MOST_MS, ms))


def uncached_tokens(input_: Column, output: Column, cache_write: Column) -> Column:
    return input_ + output + cache_write


def spent_tokens(*classes: Column) -> Column:
    return sum(classes[1:], classes[0])


def goal_tokens(input_: Column, output: Column) -> Column:
    return F.greatest(input_, F.lit(0)) + F.greatest(output, F.lit(0))


def daemon_order(is_default: Column, status: Column, path: Column) -> list[Column]:
    """The default one first, then by status, then by path."""
    rank = F
    for i, name in enumerate(DAEMON_STATUS):
        rank = rank.when(status == name, i)
    return [F.when(is_default, 0).otherwise(1).asc(), rank.otherwise(len(DAEMON_STATUS)).asc(), path.asc()]


def selected(rows: DataFrame, order: str, identity: Column, active: Column, session: Column) -> DataFrame:
    """The row of a list that was selected before: by identity but for agents' rows, active session, identity, session."""
    tier = F.when(identity & (F.col("kind") != "agent"), 0).when(active, 1).when(identity, 2).when(session, 3)
    return rows.where("selectable").withColumn("tier", tier).where("tier is not null").orderBy("tier", order).limit(1)


def most_recent(listing: DataFrame, cwd: str | None = None) -> DataFrame:
    """The session of a listing that was changed last, of one folder if given."""
    of_cwd = listing.where(F.col("cwd") == cwd) if cwd is not None else listing
    return of_cwd.orderBy(F.col("modified").desc_nulls_last(), "file").limit(1)
