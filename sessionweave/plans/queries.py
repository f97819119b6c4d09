"""The operators bound to the parquet tables, each with SQL that gives the same rows.

events stand for usage: user_id is the session, event_type the provider or tool, value a cost, and
props.k a token count; an `error` marks a compaction. conversations are session logs whose parent is
the turn before. region, nation, customer and orders form a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionweave.functions import clock, numbers, text
from sessionweave.functions.content import estimate_tokens, read_mode, total_tokens, utf16
from sessionweave.functions.fuzzy import fuzzy_filter, parse_query, search_score
from sessionweave.functions.replaced import replacement, truncated
from sessionweave.operators import agents, folds, matching, merging, positions, predicates, ranking, reports, sessions, trees
from sessionweave.sources.session_log import from_conversations
from sessionweave.sources.sinks import packed
from sessionweave.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _long(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("long") for n in names}


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

#: a line's place in its order; numbers repeat, so the price decides among equal ones
_LINE = "l_linenumber * 1e9D + l_extendedprice"


# usage


@query(f"""SELECT d, event_type, CAST(grouping(d) * 2 + grouping(event_type) AS BIGINT) AS level, count(*) AS n, round(sum(value), 4) AS total, CAST(sum(k) AS BIGINT) AS tokens, count(DISTINCT user_id) AS sessions
FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, event_type, value, user_id, {K} AS k FROM events) GROUP BY GROUPING SETS ((d, event_type), (d), ())""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("d", clock.day(F.col("ts")))
    return reports.rollup(e, ["d", "event_type"], [["d", "event_type"], ["d"], []], n=F.count("*"), total=_r(F.sum("value"), 4), tokens=F.sum("k"), sessions=F.countDistinct("user_id"))


@query("""SELECT d, event_type, CAST(grouping(d) * 2 + grouping(event_type) AS BIGINT) AS level, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin', '%Y-%m-%d') AS d, event_type, value FROM events) GROUP BY GROUPING SETS ((d, event_type), (event_type), (d), ())""")
def cost_by_local_day(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("d", clock.day(F.col("ts"), "Europe/Berlin"))
    return reports.rollup(e, ["d", "event_type"], [["d", "event_type"], ["event_type"], ["d"], []], n=F.count("*"), total=_r(F.sum("value"), 4))


@query(f"""SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max({K}) AS most FROM events GROUP BY event_type""")
def usage_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = {f"p{int(p * 100)}": _r(numbers.quantile(F.col("value"), p)) for p in (0.5, 0.9, 0.95, 0.99)}
    return _events(spark, d).groupBy("event_type").agg(_r(F.avg("value")).alias("mean"), *(v.alias(k) for k, v in q.items()), F.max("k").alias("most"))


@query(f"""SELECT event_id, round(2.5 * k / 1e6, 10) AS input, round(10.0 * (k // 3) / 1e6, 10) AS output, round(2.5 * k / 1e6 + 10.0 * (k // 3) / 1e6, 10) AS total, CASE WHEN k + event_id % 5 > 0 THEN round((k * 3.125 + (event_id % 5) * 5.0) / (k + event_id % 5), 8) ELSE 3.125 END AS write_price FROM (SELECT event_id, {K} AS k FROM events)""")
def call_costs(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("c", numbers.cost({"input": F.col("k"), "output": F.floor(F.col("k") / 3)}, {"input": F.lit(2.5), "output": F.lit(10.0)}))
    write = numbers.blended_write_price(F.col("k"), F.col("event_id") % 5, F.lit(2.5))
    return e.select("event_id", *(_r(f"c.{c}", 10).alias(c) for c in ("input", "output", "total")), _r(write, 8).alias("write_price"))


# tools, edits, reads


@query(f"""WITH c AS (SELECT user_id % 7 AS tool, count(*) AS calls FROM events WHERE event_type = 'click' GROUP BY 1), r AS (SELECT user_id % 7 AS tool, count(*) AS results, count(*) FILTER (value < 20) AS errors, CAST(sum({K}) AS BIGINT) AS tokens FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(c.tool, r.tool) AS tool, coalesce(calls, 0) AS calls, coalesce(results, 0) AS results, coalesce(errors, 0) AS errors, coalesce(tokens, 0) AS tokens, round(CASE WHEN results > 0 THEN tokens / results END, 6) AS mean_tokens FROM c FULL JOIN r ON c.tool = r.tool""")
def tool_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("tool", F.col("user_id") % 7).withColumn("failed", F.col("value") < 20)
    out = reports.tool_statistics(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "tool", "k", "failed")
    return out.withColumn("mean_tokens", _r("mean_tokens"))


_BINS = ", ".join(f"count(*) FILTER (n > {a if i else -1} AND n <= {b}) AS b{i:02d}" for i, (a, b) in enumerate(zip(numbers.TOKEN_EDGES, (*numbers.TOKEN_EDGES[1:], 1 << 60), strict=True)))


@query(f"SELECT lang, {_BINS} FROM (SELECT lang, ceil(length(coalesce(text, '')) / 4) AS n FROM documents) GROUP BY lang")
def token_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(_t(spark, d, "documents"), "lang", estimate_tokens(F.col("text")))


_EDIT = f"(SELECT event_type, user_id, event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 = 1 OR value > 50 END AS success, event_id % 3 = 0 AS multi, CASE WHEN {K} % 10 > 0 THEN value / ({K} % 10) END AS inflation, value * 300 AS size FROM events)"


def _edits(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    success = F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 4 == 1) | (F.col("value") > 50))
    inflation = F.when(F.col("k") % 10 > 0, F.col("value") / (F.col("k") % 10))
    return e.select("event_type", "user_id", "event_id", success.alias("success"), (F.col("event_id") % 3 == 0).alias("multi"), inflation.alias("inflation"), (F.col("value") * 300).alias("size"))


@query(f"""SELECT event_type, count(*) AS calls, count(success) AS resolved, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed, count(*) - count(success) AS unresolved, count(*) FILTER (multi) AS multi, round(quantile_cont(inflation, 0.5), 6) AS median_inflation, round(quantile_cont(inflation, 0.95), 6) AS p95_inflation, round(count(*) FILTER (multi) / count(*), 6) AS multi_rate, round(CASE WHEN count(success) > 0 THEN count(*) FILTER (success) / count(success) END, 6) AS success_rate FROM {_EDIT} GROUP BY event_type""")
def edit_quality(spark: SparkSession, d: str) -> DataFrame:
    out = reports.edit_quality(_edits(spark, d), "event_type", F.col("success"), F.col("multi"), F.col("inflation"))
    return out.withColumns({c: _r(c) for c in ("median_inflation", "p95_inflation", "multi_rate", "success_rate")})


@query(f"""SELECT CASE WHEN inflation IS NULL THEN 'no_core_change' WHEN inflation < 4 THEN 'lt4' WHEN inflation < 10 THEN '4to10' WHEN inflation < 25 THEN '10to25' ELSE 'gte25' END AS bin, count(*) AS n, count(success) AS resolved, count(*) FILTER (NOT success) AS failed, round(CASE WHEN count(success) > 0 THEN count(*) FILTER (NOT success) / count(success) END, 6) AS failure_rate FROM {_EDIT} GROUP BY 1""")
def inflation_bins(spark: SparkSession, d: str) -> DataFrame:
    return reports.inflation_bins(_edits(spark, d), F.col("inflation"), F.col("success")).withColumn("failure_rate", _r("failure_rate"))


@query(f"""SELECT threshold, (SELECT count(*) FROM {_EDIT} WHERE size > threshold) AS n FROM (VALUES (CAST(1024 AS BIGINT)), (4096), (16384), (65536)) t(threshold)""")
def huge_replacements(spark: SparkSession, d: str) -> DataFrame:
    return reports.huge(_edits(spark, d), F.col("size"))


@query("""SELECT count(*) AS clusters, count(DISTINCT (user_id, day)) AS messages, CAST(coalesce(sum(n), 0) AS BIGINT) AS calls, round(sum(n) / count(*), 6) AS mean_calls FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2)""")
def same_file_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("day", clock.day(F.col("ts")))
    return reports.clusters(e, ["user_id", "day"], "event_type").withColumn("mean_calls", _r("mean_calls"))


@query(f"""SELECT event_id, event_type, user_id, round(inflation, 6) AS inflation FROM {_EDIT} ORDER BY inflation DESC NULLS FIRST, size DESC, event_type, event_id LIMIT 25""")
def worst_examples(spark: SparkSession, d: str) -> DataFrame:
    e = _edits(spark, d).withColumn("path", F.concat_ws(":", "event_type", F.format_string("%012d", "event_id")))
    return ranking.worst(e, "inflation", "size", "path", 25).select("event_id", "event_type", "user_id", _r("inflation").alias("inflation"))


@query(f"""SELECT week, event_type, count(*) AS sessions, round(avg(n), 6) AS mean_rows, round(quantile_cont(rate, 0.5), 6) AS median_rate FROM (SELECT strftime(date_trunc('week', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin'), '%Y-%m-%d') AS week, event_type, user_id, count(*) AS n, avg(CASE WHEN {K} % 2 = 0 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY ALL) GROUP BY ALL""")
def partial_read_rates(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("week", clock.bucket(F.col("ts"), "week", "Europe/Berlin"))
    mode = read_mode(F.when(F.col("k") % 2 == 0, F.col("k")), F.lit(None))
    return reports.median_of_rates(e, ["week", "event_type"], "user_id", mode == "partial").withColumns({c: _r(c) for c in ("mean_rows", "median_rate")})


@query("""SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin', '%H:00') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def reads_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(clock.hour(F.col("ts"), "Europe/Berlin").alias("hour"), "event_type").agg(F.count("*").alias("n"))


_PRESSURE = f"""(WITH e AS (SELECT user_id, event_id AS o, event_type = 'error' AS c, {K} AS k, CASE WHEN event_type IN ('view', 'click') THEN 90 + user_id % 3 * 5 END AS w FROM events), f AS (SELECT user_id, min(o) FILTER (c) AS first FROM e GROUP BY 1)
SELECT e.user_id, arg_max(k, o) FILTER (NOT c) AS last_tokens, max(k) AS max_tokens, count(*) FILTER (c) AS compactions, coalesce(max(k) FILTER (c AND o = first), arg_max(k, o) FILTER (NOT c AND o < first)) AS before_first, arg_max(w, o) FILTER (w IS NOT NULL) AS win FROM e JOIN f ON e.user_id = f.user_id GROUP BY 1)"""


def _pressure(spark: SparkSession, d: str) -> DataFrame:
    window = F.when(F.col("event_type").isin("view", "click"), 90 + F.col("user_id") % 3 * 5)
    return reports.context_pressure(_events(spark, d), "user_id", "event_id", F.col("k"), F.col("event_type") == "error", window)


@query(f"SELECT user_id, last_tokens, max_tokens, compactions, before_first, CAST(win AS BIGINT) AS win, round(max_tokens / win, 6) AS share, max_tokens / win >= 0.8 AS over80, max_tokens / win >= 0.9 AS over90, max_tokens / win >= 1.0 AS over100 FROM {_PRESSURE}")
def context_pressure(spark: SparkSession, d: str) -> DataFrame:
    return _pressure(spark, d).withColumnRenamed("window", "win").withColumn("win", F.col("win").cast("long")).withColumn("share", _r("share"))


@query(f"""SELECT user_id % 4 AS grp, count(*) AS sessions, count(win) AS known, round(avg(max_tokens), 6) AS mean_max, median(max_tokens) AS median_max, count(*) FILTER (compactions > 0) AS compacted, round(CASE WHEN count(win) > 0 THEN count(*) FILTER (max_tokens / win >= 0.8) / count(win) END, 6) AS over80_rate, round(CASE WHEN count(win) > 0 THEN count(*) FILTER (max_tokens / win >= 1) / count(win) END, 6) AS over100_rate FROM {_PRESSURE} GROUP BY 1""")
def context_groups(spark: SparkSession, d: str) -> DataFrame:
    s = _pressure(spark, d).withColumn("grp", F.col("user_id") % 4)
    return reports.session_groups(s, "grp").withColumns({c: _r(c) for c in ("mean_max", "over80_rate", "over100_rate")})


@query("""SELECT event_type, min(value) AS min, median(value) AS median, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY event_type""")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.timings(_events(spark, d), "event_type", "value").withColumn("mean", _r("mean"))


# sessions


@query("""SELECT conv_id AS session_id, arg_min(text, turn) FILTER (role = 'user') AS first_user, count(*) AS messages, left(string_agg(text, ' ' ORDER BY turn), 300) AS search_text, arg_max(role, turn) AS last_role FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def session_catalog(spark: SparkSession, d: str) -> DataFrame:
    return reports.catalog(from_conversations(_t(spark, d, "conversations")), "session_id", "line", 300)


@query("""SELECT conv_id AS session_id, turn AS line, role, ceil(length(text) / 4)::BIGINT AS tokens, length(text)::BIGINT AS chars, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations""")
def session_entries(spark: SparkSession, d: str) -> DataFrame:
    e = positions.sequenced(from_conversations(_t(spark, d, "conversations")), "session_id", "line")
    return e.select("session_id", "line", "role", "tokens", utf16(F.col("text")).alias("chars"), "parent_line", "seq")


# matching


@query("""WITH t AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, lag(event_id) OVER w AS prior FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN after IS NULL THEN 'missing_result' WHEN after = 'click' THEN 'replaced' ELSE 'resolved' END WHEN before = 'click' THEN 'matched' ELSE 'unmatched' END AS state, CASE WHEN event_type = 'purchase' AND before = 'click' THEN prior END AS call FROM t""")
def matched_calls(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("key", F.lit("k"))
    return matching.matched_calls(e, "user_id", "event_id", "key", F.col("event_type") == "click", F.col("event_type") == "purchase").select("event_id", "state", "call")


@query(f"""SELECT r.event_id, r.k, max(c.event_id) AS call FROM (SELECT event_id, {K} AS k FROM events WHERE event_type = 'purchase') r LEFT JOIN (SELECT event_id, {K} AS k FROM events WHERE event_type = 'click') c ON c.k = r.k AND c.event_id < r.event_id GROUP BY 1, 2""")
def latest_calls(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("call", F.col("event_id"))
    return matching.latest_call(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "k", "event_id", "call")


@query("""SELECT c_custkey, c_nationkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    c = matching.with_dimension(_t(spark, d, "customer"), nation, ["c_nationkey"])
    region = _t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return matching.with_dimension(c, region, ["n_regionkey"]).select("c_custkey", "c_nationkey", "n_name", "r_name")


@query("""SELECT o_orderkey, round(greatest(o_totalprice - coalesce(child, 0), 0), 4) AS net FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_extendedprice, l_linenumber * 1e9 + l_extendedprice) AS child FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def attributed_usage(spark: SparkSession, d: str) -> DataFrame:
    child = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(0).alias("s"), F.col("l_extendedprice").alias("o_totalprice"), F.expr(_LINE).alias("line"))
    out = matching.attributed(_t(spark, d, "orders").withColumn("s", F.lit(0)), child, "s", "o_orderkey", "line", "o_totalprice")
    return out.select("o_orderkey", _r("net", 4).alias("net"))


@query("""WITH a AS (SELECT l_orderkey, arg_max(l_extendedprice, l_linenumber * 1e9 + l_extendedprice) AS child FROM lineitem GROUP BY 1)
SELECT o_custkey, round(sum(o_totalprice), 4) AS total, round(greatest(sum(o_totalprice) - sum(coalesce(child, 0)), 0), 4) AS own FROM orders LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY 1""")
def own_and_total_usage(spark: SparkSession, d: str) -> DataFrame:
    last = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_extendedprice", F.expr(_LINE)).alias("child"))
    joined = _t(spark, d, "orders").join(last, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    total, child = F.sum("o_totalprice"), F.sum(F.coalesce("child", F.lit(0)))
    return joined.groupBy("o_custkey").agg(_r(total, 4).alias("total"), _r(F.greatest(total - child, F.lit(0)), 4).alias("own"))


@query("""SELECT coalesce(a.id, b.id) AS id, coalesce(a.v, b.v) AS v, coalesce(a.s, b.s) AS s, CASE WHEN b.id IS NULL THEN 'live' WHEN a.id IS NULL THEN 'saved' ELSE 'both' END AS origin FROM (SELECT o_custkey AS id, max(o_totalprice) AS v, CAST(NULL AS VARCHAR) AS s FROM orders GROUP BY 1) a FULL JOIN (SELECT s_suppkey AS id, s_acctbal AS v, s_name AS s FROM supplier) b ON a.id = b.id""")
def reconciled_sessions(spark: SparkSession, d: str) -> DataFrame:
    live_ = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v")).withColumn("s", F.lit(None).cast("string"))
    saved = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"), F.col("s_name").alias("s"))
    return matching.reconciled(live_, saved, "id", ["v", "s"])


@query("""WITH a AS (SELECT o_orderkey, 0 AS rank, 'id:' || o_custkey AS alias FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, 1, 'seg:' || o_custkey % 50 FROM orders), b AS (SELECT c_custkey, 'id:' || c_custkey AS alias FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'seg:' || c_custkey FROM customer WHERE c_custkey < 40)
SELECT o_orderkey, arg_min(c_custkey, rank * 1000000000 + c_custkey) AS c_custkey FROM a JOIN b USING (alias) GROUP BY 1""")
def alias_matches(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    left = o.withColumn("names", matching.identity_aliases(id=F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")), seg=F.col("o_custkey") % 50))
    c = _t(spark, d, "customer")
    right = c.withColumn("names", matching.identity_aliases(id=F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")), seg=F.when(F.col("c_custkey") < 40, F.col("c_custkey"))))
    return matching.by_alias(left, "o_orderkey", "names", right, "c_custkey", "names")


@query("""WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey >= 5 THEN s_suppkey // 5 END AS parent FROM supplier), u AS (SELECT r.id, r.parent FROM r WHERE parent IN (SELECT id FROM r))
SELECT id, parent AS relative, 'parent' AS relation FROM u UNION ALL SELECT parent, id, 'child' FROM u UNION ALL SELECT a.id, b.id, 'sibling' FROM u a JOIN u b ON a.parent = b.parent AND a.id <> b.id""")
def family_roster(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") >= 5, F.floor(F.col("s_suppkey") / 5)).alias("parent"))
    return matching.family(s, "id", "parent")


@query("""SELECT DISTINCT c_custkey, s_suppkey FROM customer, supplier WHERE c_custkey = s_suppkey OR c_nationkey = s_suppkey""")
def either_key_join(spark: SparkSession, d: str) -> DataFrame:
    return matching.either(_t(spark, d, "customer"), _t(spark, d, "supplier"), [("c_custkey", "s_suppkey"), ("c_nationkey", "s_suppkey")], ["c_custkey", "s_suppkey"])


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def live_edges(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("p"))
    s = _t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("p"))
    a = matching.live_edges(_t(spark, d, "lineitem"), o, "l_orderkey", "l_orderkey", "p")
    return matching.live_edges(a, s, "l_suppkey", "l_suppkey", "p").select("l_orderkey", "l_linenumber")


@query("""SELECT user_id, event_id, coalesce(text, 'no result') AS text, text IS NULL AS synthetic FROM (SELECT c.user_id, c.event_id, r.text FROM (SELECT user_id, event_id FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT user_id, event_id - event_id % 4 AS key, 'ok' AS text FROM events WHERE event_type = 'purchase' GROUP BY ALL) r ON c.user_id = r.user_id AND c.event_id = r.key)""")
def synthetic_results(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    calls = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("key"), F.col("event_id").alias("line"))
    results = e.where("event_type = 'purchase'").select("user_id", (F.col("event_id") - F.col("event_id") % 4).alias("key")).distinct().withColumn("line", F.col("key")).withColumn("text", F.lit("ok"))
    matched = results.join(calls, ["user_id", "key"], "left_semi")
    return matching.with_missing_results(calls, matched, "user_id", "key", "no result").select("user_id", F.col("key").alias("event_id"), "text", "synthetic")


# positions


@query(f"""SELECT user_id, arg_max(value, event_id) FILTER ({K} % 3 = 0) AS value FROM events GROUP BY 1""")
def last_valid_state(spark: SparkSession, d: str) -> DataFrame:
    return positions.last_valid(_events(spark, d), "user_id", "event_id", "value", F.col("k") % 3 == 0)


@query(f"""SELECT user_id, nullif(trim(arg_max(CASE WHEN {K} % 4 = 0 THEN '  ' ELSE event_type END, event_id)), '') AS name FROM events GROUP BY 1""")
def session_name(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("name", F.when(F.col("k") % 4 == 0, "  ").otherwise(F.col("event_type")))
    return positions.last_value(e, "user_id", "event_id", "name")


@query("""SELECT conv_id, turn, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_start FROM conversations""")
def turn_starts(spark: SparkSession, d: str) -> DataFrame:
    return positions.turn_starts(_t(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "turn_start")


@query("""WITH m AS (SELECT conv_id, turn, role, role <> 'system' AS msg, role IN ('user', 'assistant') AS can, sum(CASE WHEN role <> 'system' THEN ceil(length(text) / 4) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS start FROM conversations),
x AS (SELECT conv_id, max(turn) FILTER (msg AND s >= 120) AS crossed, min(turn) FILTER (can) AS first, min(turn) AS begin FROM m GROUP BY 1),
c AS (SELECT x.conv_id, coalesce(min(m.turn) FILTER (can AND m.turn >= crossed), any_value(first), any_value(begin)) AS cut, any_value(begin) AS begin FROM x JOIN m ON m.conv_id = x.conv_id GROUP BY 1),
k AS (SELECT c.conv_id, coalesce((SELECT max(turn) FROM m WHERE m.conv_id = c.conv_id AND m.turn < cut AND msg) + 1, begin) AS lowest, cut FROM c),
f AS (SELECT k.conv_id, least(cut, (SELECT min(turn) FROM m WHERE m.conv_id = k.conv_id AND m.turn >= lowest)) AS first_kept FROM k)
SELECT f.conv_id, first_kept, CASE WHEN role <> 'user' THEN start END AS turn_start, role <> 'user' AND start IS NOT NULL AS split FROM f JOIN m ON m.conv_id = f.conv_id AND m.turn = first_kept""")
def cut_point(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").withColumn("tokens", estimate_tokens(F.col("text")))
    message, user = F.col("role") != "system", F.col("role") == "user"
    return positions.cut_points(c, "conv_id", "turn", "tokens", message, F.col("role").isin("user", "assistant"), message, user, user, 120)


@query(f"""WITH e AS (SELECT user_id, event_id AS o, event_type, value, {K} AS k FROM events), c AS (SELECT user_id, coalesce(max(o) FILTER (event_type = 'error'), -1) AS cut FROM e GROUP BY 1), l AS (SELECT e.user_id, max(o) FILTER (event_type = 'purchase' AND o > cut) AS last FROM e JOIN c ON e.user_id = c.user_id GROUP BY 1)
SELECT e.user_id, CAST(max(k) FILTER (o = last) + coalesce(sum(k % 7) FILTER (o > last), 0) AS BIGINT) AS tokens FROM e JOIN l ON e.user_id = l.user_id GROUP BY 1""")
def context_estimate(spark: SparkSession, d: str) -> DataFrame:
    return positions.context_estimate(_events(spark, d), "user_id", "event_id", F.col("k"), F.col("event_type") == "purchase", F.col("event_type") == "error", F.col("k") % 7)


@query("""WITH e AS (SELECT user_id, event_id AS o, event_type = 'error' AS c FROM events), x AS (SELECT user_id, max(o) FILTER (c) AS cut FROM e GROUP BY 1), y AS (SELECT e.user_id, o, c, cut, cut - 300 AS kept FROM e JOIN x ON e.user_id = x.user_id)
SELECT user_id, o AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN o = cut THEN 0 ELSE 1 END, o) AS rank FROM y WHERE (cut IS NULL OR o = cut OR o > cut OR o >= kept) AND (NOT c OR o = cut)""")
def compacted_context(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("kept", F.col("event_id") - 300)
    return positions.context_after_compaction(e, "user_id", "event_id", F.col("event_type") == "error", "kept").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH e AS (SELECT user_id, event_id, {K} AS k, event_type = 'error' AS c, sum({K}) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events), o AS (SELECT user_id, max(event_id) FILTER (s > 900) AS over FROM e GROUP BY 1)
SELECT e.user_id, event_id FROM e JOIN o ON e.user_id = o.user_id WHERE over IS NULL OR event_id > over OR (event_id = over AND c AND s - k < 810)""")
def branch_entries_in_budget(spark: SparkSession, d: str) -> DataFrame:
    return positions.within_budget(_events(spark, d), "user_id", "event_id", "k", F.col("event_type") == "error", 900).select("user_id", "event_id")


@query("""SELECT event_id, before, event_type AS after FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL AND NOT ((before, event_type) IN (('view', 'click'), ('click', 'purchase'), ('signup', 'view')))""")
def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    legal = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("signup", "view")], "before string, after string")
    return positions.illegal_moves(_events(spark, d), "user_id", "event_id", "event_type", legal).select("event_id", "before", "after")


@query("""SELECT conv_id || ':' || turn AS id, conv_id || ':' || lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations""")
def migrated_parents(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return positions.linear_parents(c, "conv_id", "turn", "id").select("id", "parent")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS owner FROM events""")
def inherited_owner(spark: SparkSession, d: str) -> DataFrame:
    return positions.inherited(_events(spark, d), "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "owner").select("event_id", "owner")


@query("""SELECT user_id, run, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id, value, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM events) WHERE run > 0 GROUP BY ALL""")
def run_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return folds.sessions_of_runs(_events(spark, d), "user_id", "event_id", F.col("event_type") == "signup", n=F.count("*"), total=_r(F.sum("value"), 4))


# trees


_TREE = "(SELECT p_partkey AS id, CASE WHEN p_partkey >= 3 THEN p_partkey // 3 END AS parent, p_retailprice AS v, p_size AS size FROM part)"
_CLOSED = f"(WITH RECURSIVE t AS (SELECT id, id AS anc, CAST(0 AS BIGINT) AS dist FROM {_TREE} UNION ALL SELECT t.id, x.parent, dist + 1 FROM t JOIN {_TREE} x ON x.id = t.anc WHERE x.parent IS NOT NULL) SELECT * FROM t)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 3, F.floor(F.col("p_partkey") / 3)).alias("parent"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("size"))


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = _nodes(spark, d)
    return nodes, trees.closure(nodes, "id", "parent")


def _paths(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    return trees.paths_up(_nodes(spark, d), "id", "parent", asked)


@query(f"SELECT id AS descendant, anc AS ancestor, dist AS distance FROM {_CLOSED}")
def tree_closure(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d)[1]


@query(f"SELECT anc AS id, round(sum(v), 4) AS total, count(*) - 1 AS descendants FROM {_CLOSED} c JOIN {_TREE} n ON n.id = c.id WHERE anc IN (SELECT id FROM {_TREE}) GROUP BY 1")
def recursive_rollups(spark: SparkSession, d: str) -> DataFrame:
    return trees.totals(_nodes(spark, d), "id", "parent", "v").withColumn("total", _r("total", 4))


@query(f"SELECT DISTINCT id FROM {_CLOSED} WHERE anc IN (7, 11)")
def session_subtree(spark: SparkSession, d: str) -> DataFrame:
    closed = _tree(spark, d)[1]
    return trees.subtree(closed, spark.createDataFrame([(7,), (11,)], "id long"), "id")


@query(f"SELECT DISTINCT anc AS id FROM {_CLOSED} c JOIN (SELECT p_partkey FROM part WHERE p_name LIKE '%1%') h ON h.p_partkey = c.id")
def matches_with_ancestors(spark: SparkSession, d: str) -> DataFrame:
    hits = _t(spark, d, "part").where("p_name LIKE '%1%'").select(F.col("p_partkey").alias("id"))
    return trees.with_ancestors(_paths(spark, d, hits), hits, "id")


@query(f"SELECT a, b, arg_min(x.anc, x.dist) AS common FROM (SELECT p_partkey AS a, p_partkey // 2 + 1 AS b FROM part) p JOIN {_CLOSED} x ON x.id = p.a JOIN {_CLOSED} y ON y.id = p.b AND y.anc = x.anc GROUP BY 1, 2")
def common_ancestors(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.floor(F.col("p_partkey") / 2) + 1).alias("b"))
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    return trees.common_ancestor(_paths(spark, d, asked), pairs, "a", "b")


@query(f"SELECT id, CASE WHEN parent IN (SELECT id FROM {_TREE} WHERE size > 12) THEN parent END AS parent FROM {_TREE} WHERE size > 12")
def orphans_promoted(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d).where("size > 12")
    return trees.promoted(nodes, "id", "parent").select("id", "parent")


@query(f"SELECT n.id, arg_min(anc, dist) AS parent FROM (SELECT id FROM {_TREE} WHERE size > 12) n LEFT JOIN (SELECT id, anc, dist FROM {_CLOSED} WHERE dist > 0 AND anc IN (SELECT id FROM {_TREE} WHERE size > 12)) c ON c.id = n.id GROUP BY 1")
def nearest_visible(spark: SparkSession, d: str) -> DataFrame:
    shown = F.col("size") > 12
    return trees.inherited(_nodes(spark, d), "id", "parent", F.when(shown, F.col("id")), own=False).join(_nodes(spark, d).where(shown).select("id"), "id").withColumnRenamed("value", "parent")


@query(f"SELECT parent AS id, count(*) AS n_children, min(id) AS first_child FROM {_TREE} WHERE parent IS NOT NULL GROUP BY 1")
def children_of(spark: SparkSession, d: str) -> DataFrame:
    return trees.children(_nodes(spark, d), "id", "parent", F.col("id"))


@query("SELECT conv_id AS session_id, conv_id || ':' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM conversations")
def branch_path(spark: SparkSession, d: str) -> DataFrame:
    return trees.walked(from_conversations(_t(spark, d, "conversations")), "session_id", "line", "id", "parent")


# merging


@query("""SELECT k, v, u FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY u DESC NULLS LAST, s DESC) AS n FROM (SELECT o_custkey AS k, o_totalprice AS v, o_orderdate AS u, 0 AS s FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey) UNION ALL SELECT o_custkey, o_totalprice, o_orderdate, 1 FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey))) WHERE n = 1""")
def freshest_jobs(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("u"))
    pick = lambda f: o.groupBy("k").agg(f(F.struct("v", "u"), "o_orderkey").alias("x")).select("k", "x.v", "x.u")
    return merging.freshest(pick(F.max_by), pick(F.min_by), "k", "u")


@query("""SELECT p_brand, count(*) AS n FROM (SELECT lower(p_name) AS key, p_brand, row_number() OVER (PARTITION BY lower(p_name) ORDER BY CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END, p_brand, p_name) AS r FROM part) WHERE r = 1 GROUP BY 1""")
def first_wins_by_provider(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    frames = [p.where(f"p_partkey % 2 = {i}").select("p_brand", "p_name") for i in (0, 1)]
    return merging.first_wins(frames, F.lower("p_name")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""")
def latest_roster(spark: SparkSession, d: str) -> DataFrame:
    return merging.latest(_events(spark, d), ["user_id"], "event_id", F.col("event_type") == "error").select("user_id", "event_type", "event_id")


@query("""SELECT p_partkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, p_retailprice) AS p_retailprice, p_brand FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""")
def model_overrides(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("p_retailprice"))
    return merging.overlaid(_t(spark, d, "part"), o, "p_partkey", ["p_retailprice"]).select("p_partkey", "p_retailprice", "p_brand")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS k, c_acctbal AS v FROM customer UNION ALL SELECT CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer) THEN 'global:' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END, s_acctbal FROM supplier""")
def harness_union(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_acctbal").alias("v"))
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_acctbal").alias("v"))
    return merging.scoped_union(a, b, "k", "global")


@query("""WITH g AS (SELECT user_id, min(event_id) FILTER (event_type = 'view') AS r, max(event_id) FILTER (event_type = 'click') AS x, max(event_id) FILTER (event_type = 'error') AS a FROM events GROUP BY 1) SELECT user_id, CASE WHEN x > r THEN 'complete' ELSE 'pending' END AS state FROM g WHERE r IS NOT NULL AND NOT coalesce(a > r, false)""")
def idempotent_commands(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "received").when(F.col("event_type") == "click", "result").when(F.col("event_type") == "error", "acknowledged")
    return merging.idempotent(_events(spark, d).withColumn("kind", kind), "user_id", "event_id", "kind")


@query("""WITH s AS (SELECT user_id, max(event_id) AS born FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.user_id, arg_max(CAST(value AS VARCHAR), event_id) FILTER (event_type IN ('signup', 'view')) IS NOT NULL AS named, arg_max(event_id, event_id) FILTER (event_type IN ('signup', 'view')) AS last_at, bool_or(event_type = 'error') AS deleted FROM events e JOIN s ON e.user_id = s.user_id WHERE event_id >= born GROUP BY 1""")
def spawn_ledger(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "spawn").when(F.col("event_type") == "view", "rename").when(F.col("event_type") == "error", "delete").otherwise("meta")
    e = _events(spark, d).withColumn("op", op).withColumn("last_at", F.col("event_id"))
    return merging.keyed_state(e, "user_id", "event_id", "op", "last_at").select("user_id", F.col("last_at").isNotNull().alias("named"), "last_at", "deleted")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = a.l_orderkey AND o_totalprice > l_extendedprice * 2)""")
def outbox_ahead(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    a = _t(spark, d, "lineitem")
    return a.join(o, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_totalprice") > F.col("l_extendedprice") * 2), "left_anti").select("l_orderkey", "l_linenumber")


# search and ranking


@query("""SELECT doc_id, round(CAST(0.1 AS DOUBLE) * (instr(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), 'the and') - 1) , 6) AS score FROM documents WHERE instr(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), 'the and') > 0""")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    score = search_score(F.col("text"), parse_query('"the  AND"'))
    return _t(spark, d, "documents").select("doc_id", _r(score).alias("score")).where("score is not null")


@query("""SELECT doc_id, round(CAST(0.1 AS DOUBLE) * (strpos(text, regexp_extract(text, '(?i)licen[sc]e', 0)) - 1), 6) AS score FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e')""")
def regex_search(spark: SparkSession, d: str) -> DataFrame:
    score = search_score(F.col("text"), parse_query("re:licen[sc]e"))
    return _t(spark, d, "documents").select("doc_id", _r(score).alias("score")).where("score is not null")


@query()
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_filter(_t(spark, d, "part").select("p_partkey", "p_name"), F.col("p_name"), "rd wdg").select("p_partkey", "p_name", _r("score").alias("score"))


@query("""SELECT p_partkey, p_name, rank FROM (SELECT p_partkey, p_name, CAST(CASE WHEN lower(p_brand) = 'brand#1' THEN 0 WHEN lower(p_name) = 'brand#1' THEN 1 WHEN lower(p_brand) LIKE 'brand#1%' THEN 2 WHEN lower(p_name) LIKE 'brand#1%' THEN 3 WHEN lower(p_brand) LIKE '%brand#1%' THEN 4 WHEN lower(p_name) LIKE '%brand#1%' THEN 5 END AS INTEGER) AS rank FROM part) WHERE rank IS NOT NULL ORDER BY rank, p_partkey LIMIT 20""")
def tiered_models(spark: SparkSession, d: str) -> DataFrame:
    rank = ranking.tier(F.col("p_brand"), F.col("p_name"), query="Brand#1")
    return ranking.tiered(_t(spark, d, "part"), rank, [F.col("p_partkey")], 20).select("p_partkey", "p_name", "rank")


@query("""WITH n AS (SELECT c_name, levenshtein(c_name, 'Customer#00000012x') AS edits FROM customer), m AS (SELECT * FROM n WHERE edits <= 3) SELECT min(c_name) AS c_name, CAST(edits AS INTEGER) AS edits FROM m WHERE edits = (SELECT min(edits) FROM m) GROUP BY edits HAVING count(*) = 1""")
def closest_session(spark: SparkSession, d: str) -> DataFrame:
    return ranking.closest(_t(spark, d, "customer"), "c_name", "Customer#00000012x")


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_rows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per_group(_t(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7 AND (SELECT count(*) FROM supplier WHERE s_suppkey = 7) = 1""")
def exact_model(spark: SparkSession, d: str) -> DataFrame:
    return ranking.unique_match(_t(spark, d, "supplier"), F.col("s_suppkey") == 7).select("s_suppkey", "s_name")


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey < 5""")
def resolved_path(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    tiers = [c.where("c_custkey < 0"), c.where("c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey < 5"), c.where("c_nationkey < 9")]
    return ranking.first_tier(tiers).select("c_custkey")


# text


@query(r"""SELECT page_id, CASE WHEN ext <> '' THEN lower(ext) ELSE '[no_ext]' END AS extension, length(url)::BIGINT AS n FROM (SELECT page_id, url, regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '^.+(\.[^.]*)$', 1) AS ext FROM pages)""")
def page_extensions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", text.path_extension(F.col("url")).alias("extension"), F.length("url").cast("long").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(left(t, 79)) || '…' END AS label, lower(left(t, 40)) AS key, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || chr(10) || chr(10) || '[... ' || (length(text) - 200) || ' more characters truncated]' END AS summary FROM (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents)""")
def compact_labels(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", text.label(t).alias("label"), F.lower(text.clamp(t, 40)).alias("key"), text.cut_summary(t, 200).alias("summary"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', floor(n / 1024 * 10 + 0.5) / 10) ELSE printf('%.1fMB', floor(n / 1048576 * 10 + 0.5) / 10) END AS size, n AS bytes, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM (SELECT doc_id, text, octet_length(encode(text))::BIGINT AS n FROM documents)""")
def text_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return _t(spark, d, "documents").select("doc_id", text.size_label(n).alias("size"), n.alias("bytes"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query(r"""SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN 'rate_limit' WHEN k % 3 = 1 THEN 'timeout' ELSE 'other' END ELSE 'network' END AS category FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def error_categories(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_type") != "error", "Socket closed").when(F.col("k") % 3 == 0, "HTTP 429").when(F.col("k") % 3 == 1, "request Timed Out").otherwise("odd")
    return _events(spark, d).select("event_id", text.call_error(said).alias("category"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'git push' WHEN event_type = 'view' THEN 'ls' WHEN event_type = 'purchase' THEN 'npm run' ELSE 'unknown' END AS key FROM events""")
def command_keys(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    said = F.when(e == "click", "A=1 sudo git push && ls").when(e == "view", "ls -la | wc").when(e == "purchase", "npm run build; echo").otherwise("")
    return _events(spark, d).select("event_id", text.command_key(said).alias("key"))


@query()
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.redacted(F.col("text")).alias("text"))


_CUT = """WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, len(l) AS n, octet_length(encode(t)) AS bytes, list_transform(l, lambda y: octet_length(encode(y))) AS b FROM x),
k AS (SELECT *, n <= 5 AND bytes <= 2000 AS whole, coalesce(list_max(list_filter([1, 2, 3, 4, 5], lambda i: i <= n AND list_sum(b[1:i]) + i - 1 <= 2000)), 0) AS h, coalesce(list_max(list_filter([1, 2, 3, 4, 5], lambda i: i <= n AND list_sum(b[n - i + 1:n]) + i - 1 <= 2000)), 0) AS g FROM n),
p AS (SELECT *, CASE WHEN whole THEN t WHEN h = 0 THEN '' ELSE array_to_string(l[1:h], chr(10)) END AS hc, CASE WHEN whole THEN t WHEN g = 0 THEN right(l[n], coalesce(list_max(list_filter(range(0, 2001), lambda i: i <= length(l[n]) AND octet_length(encode(right(l[n], i))) <= 2000)), 0)) ELSE array_to_string(l[n - g + 1:n], chr(10)) END AS tc FROM k)
SELECT doc_id, hc AS head_content, NOT whole AS head_truncated, CASE WHEN NOT whole THEN CASE WHEN h = 5 THEN 'lines' ELSE 'bytes' END END AS head_truncated_by, CASE WHEN whole THEN n ELSE h END AS head_output_lines, octet_length(encode(hc)) AS head_output_bytes, tc AS tail_content, NOT whole AS tail_truncated, CASE WHEN NOT whole THEN CASE WHEN g = 5 THEN 'lines' ELSE 'bytes' END END AS tail_truncated_by, CASE WHEN whole THEN n ELSE greatest(g, 1) END AS tail_output_lines, octet_length(encode(tc)) AS tail_output_bytes FROM p"""


@query(_CUT)
def truncated_documents(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "documents").select("doc_id", truncated(False, 5, 2000)("text").alias("head"), truncated(True, 5, 2000)("text").alias("tail"))
    return t.select("doc_id", *(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("head", "tail") for c in ("content", "truncated", "truncated_by", "output_lines", "output_bytes")))


@query("""WITH x AS (SELECT a.doc_id, a.text AS o, b.text AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, octet_length(encode(o))::BIGINT AS old_bytes, octet_length(encode(n))::BIGINT AS new_bytes, (octet_length(encode(o)) + octet_length(encode(n)))::BIGINT AS total_bytes FROM x""")
def replacement_sizes(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "documents").select("doc_id", F.col("text").alias("o"))
    b = _t(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("n"))
    return a.join(b, "doc_id").select("doc_id", replacement("o", "n").alias("r")).select("doc_id", "r.old_bytes", "r.new_bytes", "r.total_bytes")


# time, streams, folds


@query("""SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS local_day, epoch_us(ts) // 1000 AS ms FROM events""")
def time_buckets(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return _events(spark, d).select("event_id", clock.week(ts).alias("week"), clock.day(ts, "America/New_York").alias("local_day"), clock.millis(ts).alias("ms"))


@query("""SELECT event_id, CASE WHEN date_trunc('hour', ts) + INTERVAL 30 MINUTE > ts AND minute(ts) < 30 THEN date_trunc('hour', ts) + INTERVAL 30 MINUTE ELSE date_trunc('hour', ts) + INTERVAL 90 MINUTE END AS next FROM events""")
def next_runs(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", clock.next_run(F.lit("30 * * * *"), "ts").cast("timestamp_ntz").alias("next"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_usage(spark: SparkSession, d: str) -> DataFrame:
    return live.windowed_usage(_events(spark, d), "ts", "event_type", "value").withColumns({"total": _r("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@query("""SELECT event_id, CASE WHEN k % 7 = 0 THEN 'unavailable' WHEN k > 80 THEN 'unavailable' WHEN k + 1 < 20 THEN 'unavailable' ELSE 'complete' END AS status, CASE WHEN k % 7 = 0 THEN 'stream_changed' WHEN k > 80 THEN 'ahead' WHEN k + 1 < 20 THEN 'expired' END AS reason FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def replay_cursors(spark: SparkSession, d: str) -> DataFrame:
    r = live.replay(F.col("k"), F.lit(20), F.lit(80), F.col("k") % 7 != 0)
    return _events(spark, d).select("event_id", r["status"].alias("status"), r["reason"].alias("reason"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(date_trunc('milliseconds', ts)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(date_trunc('milliseconds', ts)), event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, CAST(3 AS BIGINT) AS had, t AS since, t FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, least(3, s.had - CASE WHEN s.had > 0 THEN 1 ELSE 0 END + greatest(0, e.t - s.since) // 3600000), s.since + greatest(0, e.t - s.since) // 3600000 * 3600000, e.t FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, had > 0 AS ok, CASE WHEN had = 0 THEN greatest(1, since + 3600000 - t) END AS retry_after_ms FROM s""")
def rate_limited_messages(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("ms", F.unix_millis("ts"))
    return folds.rate_limited(e, "user_id", "event_id", "ms", 3, 3_600_000)


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
s AS (SELECT conv_id, turn, n, CAST(0 AS BIGINT) AS bin, l AS used FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.turn, c.n, s.bin + CASE WHEN s.used + c.l > 400 THEN 1 ELSE 0 END, CASE WHEN s.used + c.l > 400 THEN c.l ELSE s.used + c.l END FROM s JOIN c ON c.conv_id = s.conv_id AND c.n = s.n + 1)
SELECT conv_id, turn, bin FROM s""")
def packed_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return packed(_t(spark, d, "conversations"), "conv_id", "turn", F.length("text"), 400).select("conv_id", "turn", "bin")


@query("""SELECT CAST(user_id AS VARCHAR) AS session, max(n) AS seq, 'text:' || string_agg(event_type, '' ORDER BY n) FILTER (n % 6 IN (3, 4, 5)) AS blocks, true AS done FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY user_id, (n - 1) // 6 HAVING count(*) = 6""")
def rebuilt_messages(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    kind = F.when(F.col("seq") % 6 == 1, "message_start").when(F.col("seq") % 6 == 2, "text_start").when(F.col("seq") % 6 == 0, "message_end").otherwise("text_delta")
    deltas = e.withColumn("seq", n.cast("long")).select(F.col("user_id").cast("string").alias("session"), "seq", kind.alias("kind"), F.lit(0).alias("index_"), F.col("event_type").alias("value"))
    return live.rebuilt_batch(deltas)


@query("""SELECT event_id, coalesce(nullif(CASE WHEN k % 2 = 0 THEN 0 ELSE k END, 0), k + 10) AS tokens FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def context_tokens(spark: SparkSession, d: str) -> DataFrame:
    total = F.when(F.col("k") % 2 == 0, F.lit(0)).otherwise(F.col("k"))
    return _events(spark, d).select("event_id", total_tokens(total, F.col("k"), F.lit(10)).cast("long").alias("tokens"))


# predicates and previews


@query(f"""SELECT event_id, CASE WHEN k % 3 = 0 THEN 'running' WHEN k % 5 = 0 THEN 'inactive' WHEN k % 2 = 0 THEN 'running' ELSE 'idle' END AS status, CASE WHEN k % 7 = 0 THEN 'archived' WHEN k > 50 THEN 'live' ELSE 'draft' END AS lifecycle, CASE WHEN k >= 90 THEN 'maxTurns' WHEN value >= 80 THEN 'maxTokens' END AS reason, k > 100 - 40 AS compact FROM (SELECT event_id, value, {K} AS k FROM events)""")
def session_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return _events(spark, d).select(
        "event_id",
        predicates.agent_status(k % 3 == 0, k % 5 != 0, k % 2 == 0).alias("status"),
        predicates.lifecycle(k % 7 == 0, F.greatest(k - 50, F.lit(0))).alias("lifecycle"),
        predicates.limit_reason([("maxTurns", k, F.lit(90)), ("maxTokens", F.col("value"), F.lit(80))]).alias("reason"),
        predicates.should_compact(k, F.lit(100), 40).alias("compact"),
    )


@query("""SELECT event_id, event_type = 'error' AND event_id % 3 < 1 OR event_type <> 'error' AND event_id % 10 > 7 AS overflow FROM events""")
def context_overflows(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    said = F.when(i % 3 == 0, "400: Prompt is too long").when(i % 3 == 1, "Rate limit: too many tokens").otherwise("odd")
    stop = F.when(F.col("event_type") == "error", "error").otherwise("stop")
    return _events(spark, d).select("event_id", predicates.context_overflow(stop, said, i % 10, F.lit(7)).alias("overflow"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'remove-file' WHEN s_suppkey = 1 THEN 'skip' WHEN s_suppkey % 7 = 1 THEN CASE WHEN s_suppkey % 4 > 0 AND count(*) OVER (PARTITION BY s_nationkey) = 1 THEN 'kill' ELSE 'skip' END WHEN s_suppkey % 2 = 1 THEN 'skip' ELSE 'shutdown' END AS action FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey * 1000 + s_suppkey % 3 ELSE -s_suppkey - 1 END AS s_nationkey FROM supplier)""")
def reap_plan(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("s_suppkey")
    daemons = _t(spark, d, "supplier").select(
        "s_suppkey",
        F.when(i % 4 > 0, F.col("s_nationkey") * 1000 + i % 3).alias("pid"),
        F.when(i % 7 == 0, "orphan-file").when(i % 7 == 1, "unreachable").otherwise("ok").alias("status"),
        (i == 1).alias("is_default"),
        (i % 2).alias("sessions"),
    )
    return predicates.reap_plan(daemons, True).select("s_suppkey", "action")


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type IN ('view', 'click') AND event_type NOT IN (SELECT event_type FROM events e WHERE e.user_id = events.user_id AND e.event_type IN ('purchase', 'error')))), ',') AS read_files, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type IN ('purchase', 'error'))), ','), '') AS modified_files FROM events GROUP BY user_id""")
def file_operations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "read").when(F.col("event_type").isin("purchase", "error"), "edit")
    out = sessions.file_lists(_events(spark, d).withColumn("kind", kind), "user_id", "event_type", "kind")
    return out.select("user_id", F.array_join("read_files", ",").alias("read_files"), F.array_join("modified_files", ",").alias("modified_files"))


@query("""SELECT event_type AS status, count(*) AS files, CAST(sum(event_id) AS BIGINT) AS bytes FROM events GROUP BY 1""")
def upload_totals(spark: SparkSession, d: str) -> DataFrame:
    return sessions.upload_totals(_events(spark, d).select(F.col("event_type").alias("status"), F.col("event_id").alias("bytes")))


#: commands and what their previews say
_COMMANDS = (
    ("cd a && git commit -m x; ls", "git commit -m x"),
    ("ls", "ls"),
    ("echo a; echo b", "echo b"),
    ("set -euo pipefail\nexport A=1\n# note\nnpm --prefix ./web run build --watch", "npm build --watch (web)"),
    ("python3 -m pytest -q tests; echo done", "pytest -q tests"),
    ("uv run --frozen pytest 'a b'", "pytest a b"),
    ("node_modules/.bin/eslint src", "eslint src"),
    ("echo x | cat\ntee -a ./log.txt", "append log.txt"),
    ("pnpm -C pkg test; sed -i s/a/b/ f", "pnpm test (pkg)"),
    ("npx tsx ./node_modules/vitest/dist/cli.js --run t", "vitest --run t"),
    ("API_TOKEN=abc123 run it", "API_TOKEN=<redacted> run it"),
)
_QUOTED = ", ".join("'" + shown.replace("'", "''") + "'" for _, shown in _COMMANDS)


@query(f"""SELECT event_id, [{_QUOTED}][1 + CAST(k % {len(_COMMANDS)} AS INTEGER)] AS part FROM (SELECT event_id, {K} AS k FROM events)""")
def command_previews(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(c) for c, _ in _COMMANDS)), (1 + F.col("k") % len(_COMMANDS)).cast("int"))
    return sessions.command_preview(_events(spark, d).select("event_id", said.alias("c")), "event_id", "c")


@query("""SELECT user_id, row_number() OVER (ORDER BY CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 3 = 1 THEN 1 ELSE 2 END, CASE WHEN n = 0 AND user_id <> 5 THEN 1 ELSE 0 END, CASE WHEN user_id % 3 = 2 THEN CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END ELSE 0 END DESC, CASE WHEN user_id % 3 > 0 THEN CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END ELSE 0 END DESC, CASE WHEN user_id % 3 > 0 THEN epoch_ms(last) ELSE 0 END DESC, epoch_ms(first) DESC, user_id) AS place FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS n, max(date_trunc('day', ts)) AS last, min(date_trunc('day', ts)) AS first FROM events GROUP BY 1)""")
def roster_order(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    g = _events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n"), F.max(F.date_trunc("day", "ts")).alias("last"), F.min(F.date_trunc("day", "ts")).alias("first"))
    section = F.when(u % 3 == 0, "running").when(u % 3 == 1, "idle").otherwise("inactive")
    keys = predicates.roster_order(section, F.col("n"), u == 5, u % 4 == 0, (u % 5 == 0).cast("int"), F.col("last"), F.col("first"), F.format_string("%012d", "user_id"), F.col("user_id").cast("string"))
    # a list on screen: one row per session of one user
    return g.select("user_id", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place"))


@query("""SELECT conv_id AS file, string_agg(CASE WHEN role = 'user' THEN '[User]: ' ELSE '[Assistant]: ' END || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY 1""")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    from sessionweave.sources.session_log import blocks

    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role", blocks(F.col("text")).alias("blocks"))
    return sessions.transcripts(c)


# branches, schedules and queues


@query(f"SELECT c.id, arg_min(p_brand, dist) AS v FROM {_CLOSED} c JOIN part ON p_partkey = c.anc WHERE p_partkey % 3 = 1 GROUP BY 1")
def along_branch(spark: SparkSession, d: str) -> DataFrame:
    held = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).alias("b"))
    nodes = _nodes(spark, d).join(held, "id")
    return trees.inherited(nodes, "id", "parent", F.col("b")).where("value is not null").withColumnRenamed("value", "v")


@query(f"""WITH m AS (SELECT p_partkey AS a, p_partkey // 2 + 1 AS b FROM part), k AS (SELECT a, b, min(x.dist) AS shared FROM m JOIN {_CLOSED} x ON x.id = m.a JOIN {_CLOSED} y ON y.id = m.b AND y.anc = x.anc GROUP BY 1, 2)
SELECT m.a, m.b, x.anc AS id FROM m LEFT JOIN k ON k.a = m.a AND k.b = m.b JOIN {_CLOSED} x ON x.id = m.a WHERE shared IS NULL OR x.dist < shared""")
def left_behind(spark: SparkSession, d: str) -> DataFrame:
    moves = _t(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.floor(F.col("p_partkey") / 2) + 1).alias("b"))
    asked = moves.select(F.col("a").alias("id")).unionByName(moves.select(F.col("b").alias("id")))
    return agents.left_behind(_paths(spark, d, asked), moves, "a", "b")


@query(f"WITH t AS {_TREE}, k AS (SELECT parent, count(*) AS n FROM t WHERE parent IS NOT NULL GROUP BY 1) SELECT t.id, o.n IS NOT NULL AND (t.parent IS NULL OR coalesce(s.n, 0) > 1) AS foldable FROM t LEFT JOIN k o ON o.parent = t.id LEFT JOIN k s ON s.parent = t.parent")
def foldable_entries(spark: SparkSession, d: str) -> DataFrame:
    return agents.foldable(_nodes(spark, d), "id", "parent").select("id", "foldable")


@query(f"WITH t AS {_TREE}, k AS (SELECT parent, count(*) AS n FROM t WHERE parent IS NOT NULL GROUP BY 1), f AS (SELECT t.id FROM t LEFT JOIN k ON k.parent = t.parent WHERE t.parent IS NULL OR n > 1) SELECT c.id, arg_min(anc, dist) AS start FROM {_CLOSED} c JOIN f ON f.id = c.anc GROUP BY 1")
def branch_segments(spark: SparkSession, d: str) -> DataFrame:
    return agents.segments(_nodes(spark, d), "id", "parent")


@query(f"SELECT anc AS session, count(DISTINCT l_suppkey) AS jobs, min(l_quantity) AS next FROM {_CLOSED} c JOIN lineitem ON l_partkey = c.id GROUP BY 1")
def session_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    jobs = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return agents.heartbeats(jobs, _tree(spark, d)[1], "l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id) AS place FROM events""")
def two_lane_queue(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("lane", F.when(F.col("event_type") == "error", "urgent").otherwise("normal"))
    return agents.two_lanes(e, "user_id", "lane", "event_id").select("event_id", "place")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'interrupted' WHEN o_orderstatus = 'O' THEN 'claimed' ELSE 'done' END AS status FROM orders""")
def interrupted_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("job"), F.when(F.col("o_orderstatus") == "O", "claimed").otherwise("done").alias("status"))
    running = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("job"))
    return agents.interrupted(claims, running, "job").select("o_orderkey", "status")


@query("""SELECT p_type AS code, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1""")
def children_by_code(spark: SparkSession, d: str) -> DataFrame:
    return agents.by_code(_t(spark, d, "part").select(F.col("p_type").alias("code"), F.col("p_partkey").alias("o")), "code", "o")


@query(r"""SELECT conv_id, string_agg(role || ': ' || left(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 60), chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY 1""")
def status_context(spark: SparkSession, d: str) -> DataFrame:
    return agents.status_context(_t(spark, d, "conversations"), "conv_id", "turn", 3, 60)


@query("""WITH e AS (SELECT user_id, event_id AS o, event_type = 'error' AS c FROM events), l AS (SELECT user_id, max(o) FILTER (c) AS last, min(o) AS low, max(o) AS high FROM e GROUP BY 1)
SELECT e.user_id, o AS event_id, CASE WHEN o >= high - 200 THEN 'keep' WHEN e.user_id % 2 = 0 AND o >= high - 600 THEN 'prefix' ELSE 'summarise' END AS segment FROM e JOIN l ON l.user_id = e.user_id WHERE o >= coalesce(last - 900, low) AND NOT c""")
def compaction_segments(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("kept", F.col("event_id") - 900)
    cuts = e.groupBy("user_id").agg((F.max("event_id") - 200).alias("first_kept"), F.when(F.col("user_id") % 2 == 0, F.max("event_id") - 600).alias("turn_start"))
    return agents.compaction_segments(e, cuts, "user_id", "event_id", F.col("event_type") == "error", "kept").select("user_id", "event_id", "segment")


@query("""SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS o, CASE o_orderstatus WHEN 'O' THEN 'delete' WHEN 'F' THEN 'create' ELSE 'update' END AS op, o_totalprice AS before FROM orders""")
def rolled_back_edits(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderstatus")
    edits = _t(spark, d, "orders").select(F.col("o_custkey").alias("p"), F.col("o_orderkey").alias("o"), F.when(o == "O", "create").when(o == "F", "delete").otherwise("update").alias("op"), o.alias("entity"), F.lit(0.0).alias("before"), F.col("o_totalprice").alias("after"))
    return agents.rollback(edits, "p", "o").select("p", F.col("o").cast("long").alias("o"), "op", "before")


@query("""SELECT c_mktsegment AS w FROM customer GROUP BY 1 HAVING bool_and(c_acctbal > -999)""")
def evictable_workers(spark: SparkSession, d: str) -> DataFrame:
    return predicates.evictable(_t(spark, d, "customer").select(F.col("c_mktsegment").alias("w"), "c_acctbal"), "w", F.col("c_acctbal") > -999)


@query("""SELECT p_partkey, substr(sha256(p_name), 1, 16) AS path_key, p_brand || ' ' || p_type AS search FROM part""")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return p.select("p_partkey", agents.path_key(F.col("p_name")).alias("path_key"), agents.search_text(F.col("p_brand"), F.lit(" "), F.col("p_type"), F.lit(None)).alias("search"))


@query("""SELECT o_orderkey FROM orders WHERE (o_orderkey % 5 = 0) OR o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 OR o_orderkey % 5 > 1 AND o_orderkey % 3 = 0""")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that were never sent, have another size, or are newer."""
    k = F.col("o_orderkey")
    files = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("path"), F.lit(1).alias("size"), F.lit(5).alias("mtime"))
    sent = _t(spark, d, "orders").where(k % 5 > 0).select(F.col("o_orderkey").cast("string").alias("path"), F.when((k % 5 == 1) & (k % 2 == 0), 2).otherwise(1).alias("size"), F.when((k % 5 > 1) & (k % 3 == 0), 4).otherwise(5).alias("mtime"))
    return live.outbox(files, sent).select("o_orderkey")


@query("""WITH RECURSIVE e AS (SELECT user_id % 8 AS store, event_id, epoch_ms(date_trunc('milliseconds', ts)) AS t, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT store, event_id, n, t, t AS due, true AS claimed, t + 3600000 AS next, t + 5400000 AS free FROM e WHERE n = 1 UNION ALL SELECT e.store, e.event_id, e.n, e.t, s.next, e.t >= s.next AND e.t >= s.free, CASE WHEN e.t >= s.next THEN e.t + 3600000 ELSE s.next END, CASE WHEN e.t >= s.next AND e.t >= s.free THEN e.t + 5400000 ELSE s.free END FROM s JOIN e ON e.store = s.store AND e.n = s.n + 1)
SELECT 'job' || store AS job, event_id AS tick, t AS at, due FROM s WHERE claimed""")
def claimed_jobs(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("store", (F.col("user_id") % 8).cast("string"))
    jobs = e.groupBy("store").agg(F.min(F.unix_millis("ts")).alias("next_ms")).select("store", F.concat(F.lit("job"), "store").alias("job"), "next_ms", F.lit(3_600_000).cast("long").alias("every_ms"), F.lit(5_400_000).cast("long").alias("busy_ms"))
    return folds.claimed(jobs, e.select("store", F.col("event_id").alias("tick"), F.unix_millis("ts").alias("at")))


@query("""WITH r AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type <> 'error'),
x AS (SELECT event_id, (SELECT min(r.event_id) FROM r WHERE r.user_id = e.user_id AND r.event_id > e.event_id) AS after FROM events e WHERE event_type = 'error' AND user_id % 2 = 0)
SELECT 'r' || before AS source, 'r' || event_id AS target, 'continuation' AS type FROM r WHERE before IS NOT NULL UNION ALL SELECT 'child-r' || event_id, 'r' || after, 'subagent_return' FROM x WHERE after IS NOT NULL""")
def semantic_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as requests; views of even users hang a child's return on them."""
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("session"), (F.col("event_id") * 2).alias("line"), F.concat(F.lit("r"), "event_id").alias("request"), "event_type", "user_id")
    none = F.lit(None).cast("string")
    row = lambda kind, line, session, request, child: (F.lit("f").alias("file"), line.alias("line"), F.lit(kind).alias("type"), session.alias("session"), request.alias("request"), none.alias("compaction"), none.alias("status"), child.alias("child"), none.alias("spawned_by"))
    own = e.where("event_type != 'error'")
    started = own.select(*row("request_started", F.col("line"), F.col("session"), F.col("request"), none))
    finished = own.select(*row("request_finished", F.col("line") + 1, none, F.col("request"), none))
    back = e.where("event_type = 'error' AND user_id % 2 = 0").select(*row("child_returned", F.col("line"), F.col("session"), F.concat(F.lit("child-"), "request"), F.col("request")))
    return folds.semantic_edges(started.unionByName(finished).unionByName(back))
