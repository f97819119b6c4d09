"""Roll-ups of usage, tools, edits, reads, context and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionweave.functions import numbers as N


def rollup(events: DataFrame, keys: list[str], sets: list[list[str]], **aggregates: Column) -> DataFrame:
    """Several groupings in one aggregate; `level` has a bit for every key that is summed over, first key highest."""
    level = F.lit(0)
    for k in keys:
        level = level * 2 + F.grouping(k).cast("int")
    grouped = events.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys))
    return grouped.agg(level.cast("long").alias("level"), *(v.alias(k) for k, v in aggregates.items()))


def tool_statistics(calls: DataFrame, results: DataFrame, tool: str, tokens: str, is_error: str) -> DataFrame:
    """Per tool: calls, results, errors, tokens and their mean per result; tools with results alone count too."""
    a = calls.groupBy(tool).agg(F.count("*").alias("calls"))
    b = results.groupBy(tool).agg(F.count("*").alias("results"), F.count_if(is_error).alias("errors"), F.sum(tokens).alias("tokens"))
    out = a.join(b, tool, "full_outer").fillna(0, ["calls", "results", "errors", "tokens"])
    return out.withColumn("mean_tokens", N.rate(F.col("tokens"), F.col("results")))


def histogram(samples: DataFrame, group: str, value: Column) -> DataFrame:
    """Counts per group and token bin, a column for each bin."""
    bins = samples.select(group, N.token_bin(value).alias("bin"))
    counts = (F.count_if(F.col("bin") == i).alias(f"b{i:02d}") for i in range(len(N.TOKEN_EDGES)))
    return bins.groupBy(group).agg(*counts)


def edit_quality(edits: DataFrame, key: str, success: Column, multi: Column, inflation: Column) -> DataFrame:
    """Per key: calls by outcome, rates over the right denominators, median and 95th percentile inflation."""
    resolved = success.isNotNull()
    out = edits.groupBy(key).agg(
        F.count("*").alias("calls"),
        F.count_if(resolved).alias("resolved"),
        F.count_if(success).alias("success"),
        F.count_if(~success).alias("failed"),
        F.count_if(~resolved).alias("unresolved"),
        F.count_if(multi).alias("multi"),
        N.quantile(inflation, 0.5).alias("median_inflation"),
        N.quantile(inflation, 0.95).alias("p95_inflation"),
    )
    return out.withColumn("multi_rate", N.rate(F.col("multi"), F.col("calls"))).withColumn("success_rate", N.rate(F.col("success"), F.col("resolved")))


def inflation_bins(edits: DataFrame, inflation: Column, success: Column) -> DataFrame:
    out = edits.groupBy(N.ratio_bin(inflation).alias("bin")).agg(F.count("*").alias("n"), F.count_if(success.isNotNull()).alias("resolved"), F.count_if(~success).alias("failed"))
    return out.withColumn("failure_rate", N.rate(F.col("failed"), F.col("resolved")))


def huge(edits: DataFrame, size: Column, thresholds: tuple[int, ...] = N.HUGE) -> DataFrame:
    """How many are over each threshold; the counts include one another."""
    one = edits.agg(*(F.count_if(size > t).alias(str(t)) for t in thresholds))
    return one.select(F.explode(F.create_map(*(x for t in thresholds for x in (F.lit(t).cast("long"), F.col(f"`{t}`"))))).alias("threshold", "n"))


def clusters(calls: DataFrame, message: list[str], item: str, least: int = 2) -> DataFrame:
    """One row: groups of one message and item with `least` calls or more."""
    g = calls.groupBy(*message, item).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out = g.agg(F.count("*").alias("clusters"), F.countDistinct(*message).alias("messages"), F.coalesce(F.sum("n"), F.lit(0)).alias("calls"))
    return out.withColumn("mean_calls", N.rate(F.col("calls"), F.col("clusters")))


def median_of_rates(rows: DataFrame, bucket: list[str], session: str, part: Column) -> DataFrame:
    """Rate of each session in a bucket first, then the median over sessions."""
    inner = rows.groupBy(*bucket, session).agg(F.count("*").alias("n"), F.avg(part.cast("double")).alias("rate"))
    return inner.groupBy(*bucket).agg(F.count("*").alias("sessions"), F.avg("n").alias("mean_rows"), N.quantile(F.col("rate"), 0.5).alias("median_rate"))


def context_pressure(rows: DataFrame, session: str, order: str, tokens: Column, is_compaction: Column, window: Column) -> DataFrame:
    """Per session: last and largest known tokens, compactions, tokens before the first one, share of the last known window."""
    first = rows.groupBy(session).agg(F.min(F.when(is_compaction, F.col(order))).alias("_first"))
    t = rows.join(first, session)
    fold = t.groupBy(session).agg(
        F.max_by(F.when(~is_compaction, tokens), F.when(~is_compaction & tokens.isNotNull(), F.col(order))).alias("last_tokens"),
        F.max(tokens).alias("max_tokens"),
        F.count_if(is_compaction).alias("compactions"),
        F.coalesce(F.max(F.when(is_compaction & (F.col(order) == F.col("_first")), tokens)), F.max_by(tokens, F.when(~is_compaction & tokens.isNotNull() & (F.col(order) < F.col("_first")), F.col(order)))).alias("before_first"),
        F.max_by(window, F.when(window.isNotNull(), F.col(order))).alias("window"),
    )
    share = F.col("max_tokens") / F.col("window")
    return fold.withColumn("share", share).withColumn("over80", share >= 0.8).withColumn("over90", share >= 0.9).withColumn("over100", share >= 1.0)


def session_groups(sessions: DataFrame, key: str) -> DataFrame:
    """Sessions by key: only those with a known value count in its means, medians and rates."""
    known = F.col("share").isNotNull()
    return sessions.groupBy(key).agg(
        F.count("*").alias("sessions"),
        F.count_if(known).alias("known"),
        F.avg("max_tokens").alias("mean_max"),
        F.median("max_tokens").alias("median_max"),
        F.count_if(F.col("compactions") > 0).alias("compacted"),
        N.rate(F.count_if("over80"), F.count_if(known)).alias("over80_rate"),
        N.rate(F.count_if("over100"), F.count_if(known)).alias("over100_rate"),
    )


def catalog(entries: DataFrame, session: str, order: str, text_cap: int = 64 * 1024) -> DataFrame:
    """One row per session: first user text, messages, search text in order up to a cap, last speaker.

    A session's texts are gathered in one row up to the cap: of each only its share under it. Rows without text
    count as messages alone; a session without any has no search text.
    """
    from pyspark.sql import Window

    spoken = entries.where((F.col("type") == "message") & F.col("role").isin("user", "assistant"))
    before = Window.partitionBy(session).orderBy(F.col(order).asc_nulls_last(), "text").rowsBetween(Window.unboundedPreceding, -1)
    sized = spoken.withColumn("_before", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    # a text that starts right behind the cap still adds the blank before it
    share = F.left("text", F.greatest(text_cap - F.col("_before"), F.lit(0)).cast("int"))
    capped = sized.withColumn("_part", F.when(F.col("_before") <= text_cap, share))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("_before", "_part")))), lambda x: x["_part"])
    return capped.groupBy(session).agg(
        F.min_by("text", F.when((F.col("role") == "user") & F.col("text").isNotNull(), F.col(order))).alias("first_user"),
        F.count("*").alias("messages"),
        F.when(F.count("text") > 0, F.substring(F.array_join(texts, " "), 1, text_cap)).alias("search_text"),
        F.max_by("role", order).alias("last_role"),
    )


def timings(runs: DataFrame, label: str, ms: str) -> DataFrame:
    return runs.groupBy(label).agg(F.min(ms).alias("min"), F.median(ms).alias("median"), F.avg(ms).alias("mean"), F.max(ms).alias("max"))
