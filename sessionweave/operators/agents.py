"""Branches, models, schedules and queues of agents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionweave.functions import content as C
from sessionweave.functions import text as T
from sessionweave.functions.fuzzy import fuzzy_filter
from sessionweave.functions.replaced import common_prefix
from sessionweave.operators import trees
from sessionweave.operators.sessions import recap


def search_text(*fields: Column) -> Column:
    """Fields that say something, joined by spaces."""
    return F.concat_ws(" ", *(F.nullif(F.trim(f.cast("string")), F.lit("")) for f in fields))


def models(catalog: DataFrame, query: str = "") -> DataFrame:
    """catalog (provider, id, ...) that a query finds, by provider and id."""
    found = fuzzy_filter(catalog, F.concat_ws(" ", "provider", "id"), query).drop("score") if query.strip() else catalog
    return found.orderBy("provider", "id")


def model_pattern(pattern: str, known: set[str], levels: tuple[str, ...] = ("off", "minimal", "low", "medium", "high", "xhigh")) -> tuple[str, str | None]:
    """(name, thinking level): a suffix after the last colon is a level unless the whole is a known name."""
    head, colon, tail = pattern.rpartition(":")
    if not colon or pattern in known:
        return pattern, None
    name, level = model_pattern(head, known, levels)
    return (name, tail) if tail in levels else (pattern, None) if name == head and level is None else (name, level)


def scoped_models(catalog: DataFrame, patterns: list[str]) -> DataFrame:
    """Models (provider, id) that any pattern names, with the place of the first one: globs or parts of names."""
    name = F.concat_ws("/", "provider", "id")
    rank = F
    for i, p in enumerate(patterns):
        hit = name.rlike(T.glob(p)) | F.col("id").rlike(T.glob(p)) if set(p) & set("*?") else F.contains(F.lower(name), F.lit(p.lower()))
        rank = rank.when(hit, i)
    return catalog.withColumn("place", rank if patterns else F.lit(None)).where("place is not null").orderBy("place", "provider", "id")


def matched_model(catalog: DataFrame, part: str) -> DataFrame:
    """The model whose id holds a part: one without a date first, then the latest."""
    found = catalog.where(F.contains(F.lower("id"), F.lit(part.lower())))
    return found.orderBy(T.is_alias(F.col("id")).desc(), F.col("id").desc()).limit(1)


def along_branch(closed: DataFrame, values: DataFrame, id_: str, value: str) -> DataFrame:
    """(id, value): the value of the nearest node at or above that has one."""
    held = values.where(F.col(value).isNotNull()).select(F.col(id_).alias("ancestor"), F.col(value).alias("_v"))
    return closed.join(held, "ancestor").groupBy(F.col("descendant").alias(id_)).agg(F.min_by("_v", "distance").alias(value))


def left_behind(closed: DataFrame, moves: DataFrame, old: str, new: str) -> DataFrame:
    """(old, new, id): what lies on the old leaf's path below the nodes that both leaves share."""
    common = trees.common_ancestor(closed, moves, old, new)
    up = closed.select(F.col("descendant").alias(old), F.col("ancestor").alias("id"), "distance")
    top = closed.select(F.col("descendant").alias(old), F.col("ancestor").alias("common"), F.col("distance").alias("_most"))
    paths = moves.join(common, [old, new], "left").join(top, [old, "common"], "left").join(up, old)
    return paths.where(F.col("_most").isNull() | (F.col("distance") < F.col("_most"))).select(old, new, "id")


def foldable(nodes: DataFrame, id_: str, parent: str) -> DataFrame:
    """nodes with `foldable`: they have children, and are roots or have siblings."""
    kids = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("_n"))
    own = kids.select(F.col("_p").alias(id_), F.col("_n").alias("_own"))
    among = kids.select(F.col("_p").alias(parent), F.col("_n").alias("_among"))
    joined = nodes.join(own, id_, "left").join(among, parent, "left")
    return joined.withColumn("foldable", F.coalesce(F.col("_own") > 0, F.lit(False)) & (F.col(parent).isNull() | (F.coalesce("_among", F.lit(0)) > 1))).drop("_own", "_among")


def segment_starts(nodes: DataFrame, closed: DataFrame, id_: str, parent: str) -> DataFrame:
    """(id, start): the highest node from which the path down to it does not branch."""
    kids = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("_n"))
    first = nodes.join(kids, F.col(parent) == F.col("_p"), "left").where(F.col(parent).isNull() | (F.col("_n") > 1)).select(F.col(id_).alias("ancestor"))
    return closed.join(first, "ancestor").groupBy(F.col("descendant").alias(id_)).agg(F.min_by("ancestor", "distance").alias("start"))


def segments(nodes: DataFrame, id_: str, parent: str) -> DataFrame:
    """segment_starts() in rounds that grow with the logarithm of the depth, on one row per node."""
    kids = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("_n"))
    counted = nodes.join(kids, F.col(parent) == F.col("_p"), "left").drop("_p")
    first = F.when(F.col(parent).isNull() | (F.col("_n") > 1), F.col(id_))
    return trees.inherited(counted, id_, parent, first).withColumnRenamed("value", "start")


def deepest_frame(frames: DataFrame, there: DataFrame, key: str, depth: str) -> DataFrame:
    """The deepest frame that still exists."""
    return frames.join(there, key, "left_semi").orderBy(F.col(depth).desc()).limit(1)


def heartbeats(jobs: DataFrame, closed: DataFrame, owner: str, job: str, next_run: str) -> DataFrame:
    """(session, jobs, next): distinct jobs of a session and all below it, and the earliest next run."""
    up = closed.join(jobs, closed.descendant == jobs[owner])
    return up.groupBy(F.col("ancestor").alias("session")).agg(F.countDistinct(job).alias("jobs"), F.min(next_run).alias("next"))


def registrations(jobs: DataFrame, *keys: str) -> dict[str, DataFrame]:
    """The distinct non-null values of several keys, for semi-joins."""
    return {k: jobs.where(F.col(k).isNotNull()).select(k).distinct() for k in keys}


def depth_of_path(path: Column) -> Column:
    """Number of folders sub-xxxxxxxx at the end of a path."""
    return F.size(F.regexp_extract_all(F.regexp_extract(path, r"((?:/sub-[0-9a-f]{8})*)(?:/[^/]*\.jsonl)?$", 1), F.lit(r"(/sub-)"), 1))


def parent_folder(path: Column) -> Column:
    """Folder of the session above: two levels up from a child's file."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/[^/]+/[^/]+$", 1), F.lit(""))


def compaction_segments(rows: DataFrame, cuts: DataFrame, session: str, order: str, is_compaction: Column, first_kept: str) -> DataFrame:
    """rows since the last compaction's boundary with `segment`: summarise, prefix or keep.

    cuts is what cut_points() gives for the rows from that boundary on.
    """
    all_ = Window.partitionBy(session)
    last = F.max(F.when(is_compaction, F.col(order))).over(all_)
    r = rows.withColumn("_last", last)
    r = r.withColumn("_from", F.coalesce(F.max(F.when(F.col(order) == F.col("_last"), F.col(first_kept))).over(all_), F.col("_last") + 1, F.min(order).over(all_)))
    cut = cuts.select(session, F.col("first_kept").alias("_cut"), F.col("turn_start").alias("_turn"))
    j = r.join(cut, session).where((F.col(order) >= F.col("_from")) & ~is_compaction)
    segment = F.when(F.col(order) >= F.col("_cut"), "keep").when(F.col("_turn").isNotNull() & (F.col(order) >= F.col("_turn")), "prefix").otherwise("summarise")
    return j.withColumn("segment", segment).drop("_last", "_from", "_cut", "_turn")


def status_context(messages: DataFrame, session: str, order: str, last: int = 10, most: int = 400) -> DataFrame:
    """(session, context): the last messages, clamped and named by role."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    recent = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    line = F.concat(F.col("role"), F.lit(": "), T.clamp(F.col("text"), most))
    return recent.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"]), "\n").alias("context"))


def status_reply(text: Column, working: Column) -> Column:
    """Struct of summary and status in a model's reply; an idle agent without a verdict needs input, no recap gives null."""
    plain = F.translate(text, "‹＜›＞", "<<>>")
    summary = recap(C.last_tag(plain, "recap"))
    status = F.when(~working, F.coalesce(F.nullif(F.lower(C.last_tag(plain, "status")), F.lit("")), F.lit("needs_input")))
    return F.when(summary.isNotNull(), F.struct(summary.alias("summary"), status.alias("status")))


def rollback(edits: DataFrame, proposal: str, order: str) -> DataFrame:
    """Edits (op, entity, before, after) of a proposal undone, last first."""
    undone = F.when(F.col("op") == "create", "delete").when(F.col("op") == "delete", "create").otherwise("update")
    w = Window.partitionBy(proposal).orderBy(F.col(order).desc())
    return edits.select(proposal, F.row_number().over(w).alias(order), undone.alias("op"), "entity", F.col("after").alias("before"), F.col("before").alias("after"))


def cached_usage(prompts: DataFrame, session: str, order: str, prompt: str) -> DataFrame:
    """prompts with tokens read from and written to a cache: what starts like the prompt before is read."""
    before = F.lag(prompt).over(Window.partitionBy(session).orderBy(order))
    same = common_prefix(F.col(prompt), F.col("_before"))
    total = C.estimate_tokens(F.col(prompt))
    read = F.when(F.col("_before").isNull(), 0).otherwise(F.floor(same / 4)).cast("long")
    return prompts.withColumn("_before", before).withColumn("cache_read", read).withColumn("cache_write", total - F.col("cache_read")).drop("_before")


def interrupted(claims: DataFrame, running: DataFrame, job: str) -> DataFrame:
    """claims with status interrupted where the job was claimed and nobody runs it now."""
    alive = running.select(job, F.lit(True).alias("_alive"))
    lost = (F.col("status") == "claimed") & F.col("_alive").isNull()
    return claims.join(alive, job, "left").withColumn("status", F.when(lost, "interrupted").otherwise(F.col("status"))).drop("_alive")


def two_lanes(actions: DataFrame, session: str, lane: str, order: str) -> DataFrame:
    """actions with their place in the queue: the urgent lane first, each in order."""
    w = Window.partitionBy(session).orderBy(F.when(F.col(lane) == "urgent", 0).otherwise(1), F.col(order))
    return actions.withColumn("place", F.row_number().over(w).cast("long"))


def by_code(children: DataFrame, code: str, order: str) -> DataFrame:
    """(code, n, first) of groups in the order first seen; blank codes are not grouped."""
    return children.where(F.trim(code) != "").groupBy(code).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy("first")


def skill(text: Column) -> Column:
    """Struct of name and body of a <skill name="..."> block, null without one."""
    pattern = r'(?s)<skill name="([^"]+)"[^>]*>\n?(.*?)\n?</skill>'
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("name"), F.regexp_extract(text, pattern, 2).alias("body")))


def sockets(line: Column) -> Column:
    """Struct of address and pid of an ss row."""
    return F.struct(F.regexp_extract(line, r"^\S+\s+\d+\s+\d+\s+(\S+)", 1).alias("address"), F.regexp_extract(line, r"pid=(\d+)", 1).try_cast("long").alias("pid"))


def path_key(path: Column) -> Column:
    """First 16 hex digits of a path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 16)


def body_hash(*fields: Column) -> Column:
    """SHA-256 of the fields as JSON, in the order given."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def register(spark: SparkSession, name: str, function: Callable, returns: str) -> None:
    """Make a function over pandas series callable from SQL."""
    spark.udf.register(name, F.pandas_udf(function, returns))
