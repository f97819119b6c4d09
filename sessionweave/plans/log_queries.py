"""The log path and text tools bound to the parquet tables.

A folder of session logs is written from conversations once per process and folder of tables: a header, the
turns (system turns as tool results, assistants' second turns with a tool call), then a label, custom, name
and state entry, a blank line and in some files a broken one. The SQL beside each query gives the rows from
the table itself.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionweave.functions import clock, content, text
from sessionweave.functions import replaced as R
from sessionweave.operators import agents, filters, merging, predicates, sessions, trees
from sessionweave.plans.queries import K, _events, _t, _tree, _TREE, query
from sessionweave.sources import session_log, sinks

# the folder of logs


def _json(name: str) -> Column:
    """A column as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.col(name).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def _lines(conversations: DataFrame) -> DataFrame:
    """(s, n, value): the lines of each session's file."""
    w = Window.partitionBy("conv_id")
    c = conversations.withColumn("rn", F.row_number().over(w.orderBy("turn")).cast("long")).withColumn("prior", F.lag("turn").over(w.orderBy("turn")))
    said = F.concat(F.lit('{"type":"text","text":'), _json("text"), F.lit("}"))
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    path = F.concat(F.lit('{"path":"/f/'), (F.col("turn") % 5).cast("string"), F.lit('.txt"'))
    read = F.concat(path, F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(',"offset":'), turn)).otherwise(""), F.lit("}"))
    bash = F.concat(F.lit('{"command":"git push; ls '), turn, F.lit('"}'))
    edit = F.when(F.col("conv_id") % 3 == 0, '{"oldText":"a","newText":"b"}').when(F.col("conv_id") % 3 == 1, '{"edits":[{"a":1}]}').otherwise('{"old_string":"a","oldText":"b"}')
    tool = F.col("rn") % 3
    call = F.concat(F.lit('{"type":"toolCall","id":"k'), conv, F.lit(":"), turn, F.lit('","name":"'), F.when(tool == 0, "read").when(tool == 1, "bash").otherwise("edit"), F.lit('","arguments":'), F.when(tool == 0, read).when(tool == 1, bash).otherwise(edit), F.lit("}"))
    calls = (F.col("role") == "assistant") & (F.col("rn") % 2 == 0)
    body = F.when((F.col("role") == "user") & (F.col("rn") % 3 == 0), _json("text")).otherwise(F.concat(F.lit("["), said, F.when(calls, F.concat(F.lit(","), call)).otherwise(""), F.lit("]")))
    ms = (1_704_164_645_000 + F.col("conv_id") * 100_000 + F.col("turn") * 1000).cast("string")
    usage = F.concat(F.lit(',"provider":"p'), (F.col("conv_id") % 3).cast("string"), F.lit('","model":"m","usage":{"input":'), F.length("text").cast("string"), F.lit(',"output":'), turn, F.lit(',"cacheRead":'), conv, F.lit(',"cacheWrite":0,"totalTokens":0,"cost":{"total":0.5}}'))
    result = F.concat(F.lit(',"toolCallId":"k'), conv, F.lit(":"), turn, F.lit('","toolName":"read","isError":'), (F.length("text") % 2 == 0).cast("string"))
    more = F.when(F.col("role") == "assistant", usage).when(F.col("role") == "system", result).otherwise("")
    role = F.when(F.col("role") == "system", "toolResult").otherwise(F.col("role"))
    up = F.when(F.col("prior").isNull(), "").otherwise(F.concat(F.lit('"parentId":"'), conv, F.lit(":"), F.col("prior").cast("string"), F.lit('",')))
    turns = c.select("conv_id", F.col("rn").alias("n"), F.concat(F.lit('{"type":"message","id":"'), conv, F.lit(":"), turn, F.lit('",'), up, F.lit('"message":{"role":"'), role, F.lit('","content":'), body, F.lit(',"timestamp":'), ms, more, F.lit("}}")).alias("value"))
    one = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    i = F.col("conv_id")
    number = i.cast("string")
    above = F.when(i % 5 == 1, F.concat(F.lit(',"parentSession":"s'), (i - 1).cast("string"), F.lit('"'))).otherwise("")
    head = F.concat(F.lit('{"type":"session","id":"s'), number, F.lit('","version":3,"timestamp":"2024-01-02T03:04:05.000Z","cwd":"/w/'), (i % 4).cast("string"), F.lit('"'), above, F.lit("}"))
    label = F.concat(F.lit('{"type":"label","targetId":"'), number, F.lit(':0","label":"'), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("L"), (i % 3).cast("string"))), F.lit('"}'))
    custom = F.concat(F.lit('{"type":"custom","customType":"refinement","data":{"n":'), number, F.lit("}}"))
    name = F.concat(F.lit('{"type":"session_info","name":"'), F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit(" N"), number)), F.lit('"}'))
    state = F.concat(F.lit('{"type":"session_state","state":"'), F.element_at(F.array(*map(F.lit, ("live", "sleep", "hidden", "odd"))), (i % 4 + 1).cast("int")), F.lit('"}'))
    rest = [(F.lit(0), head), *((F.col("n") + k, v) for k, v in enumerate((label, custom, name, state, F.lit("")), 1)), (F.col("n") + 6, F.when(i % 6 == 0, "{broken"))]
    others = one.select("conv_id", F.explode(F.array(*(F.struct(n.cast("long").alias("n"), v.alias("value")) for n, v in rest))).alias("x")).select("conv_id", "x.n", "x.value").where("value is not null")
    return turns.unionByName(others).withColumnRenamed("conv_id", "s")


@lru_cache(maxsize=8)
def _folder(spark: SparkSession, d: str) -> str:
    path = f"{sinks.scratch(spark)}/logs-{uuid.uuid4().hex}"
    one = _lines(_t(spark, d, "conversations")).groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n").alias("value"))
    one.write.partitionBy("s").text(path)
    return path


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return session_log.lines(spark, _folder(spark, d), "*.txt")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return session_log.entries(_raw(spark, d))


def _conv() -> Column:
    return F.regexp_extract("file", r"/s=(\d+)/", 1).cast("long").alias("conv_id")


_C = """c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prior, count(*) OVER (PARTITION BY conv_id) AS n, role = 'assistant' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) % 2 = 0 AS calls FROM conversations),
t AS (SELECT *, CASE rn % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'bash' ELSE 'edit' END AS tool, CASE rn % 3 WHEN 0 THEN '{"path":"/f/' || turn % 5 || '.txt"' || CASE WHEN conv_id % 2 = 0 THEN ',"offset":' || turn ELSE '' END || '}' WHEN 1 THEN '{"command":"git push; ls ' || turn || '"}' ELSE CASE conv_id % 3 WHEN 0 THEN '{"oldText":"a","newText":"b"}' WHEN 1 THEN '{"edits":[{"a":1}]}' ELSE '{"old_string":"a","oldText":"b"}' END END AS args FROM c),
o AS (SELECT DISTINCT conv_id, n FROM c)"""


@query("""SELECT conv_id, count(*) + 6 + CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS lines, count(*) + 5 + CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS last, CAST(1 AS BIGINT) AS blank, true AS terminated FROM conversations GROUP BY conv_id""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d).withColumn("conv_id", _conv())
    return raw.groupBy("conv_id").agg(F.count("*").alias("lines"), F.max("line").alias("last"), F.count_if(F.col("value") == "").alias("blank"), F.bool_and("terminated").alias("terminated"))


@query("""SELECT DISTINCT 's' || conv_id AS session_id, CAST(3 AS INTEGER) AS version, '2024-01-02T03:04:05.000Z' AS timestamp, '/w/' || conv_id % 4 AS cwd, CASE WHEN conv_id % 5 = 1 THEN 's' || conv_id - 1 END AS parent FROM conversations""")
def log_headers(spark: SparkSession, d: str) -> DataFrame:
    return session_log.headers(_log(spark, d)).where(filters.is_session(F.lit("session"), F.col("session_id"))).select("session_id", "version", "timestamp", "cwd", F.col("parentSession").alias("parent"))


@query(f"""WITH {_C} SELECT conv_id, rn AS line, 'message' AS type, conv_id || ':' || turn AS id, conv_id || ':' || prior AS parent, CAST(CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS bad_lines FROM c
UNION ALL SELECT conv_id, x.k, x.type, CASE WHEN x.k = 0 THEN 's' || conv_id END, NULL, CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END FROM o, LATERAL (VALUES (0, 'session'), (n + 1, 'label'), (n + 2, 'custom'), (n + 3, 'session_info'), (n + 4, 'session_state')) x(k, type)""")
def log_entries(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select(_conv(), "line", "type", "id", F.col("parentId").alias("parent"), "bad_lines")


@query(f"""WITH {_C} SELECT conv_id, rn AS line, text AS joined, text || CASE WHEN calls THEN chr(10) || '{{"type":"toolCall","id":"k' || conv_id || ':' || turn || '","name":"' || tool || '","arguments":' || CAST(to_json(args) AS VARCHAR) || '}}' ELSE '' END AS whole, text || CASE WHEN calls THEN chr(10) || '[tool_call:' || tool || ']' ELSE '' END AS preview, CASE WHEN calls THEN tool ELSE '' END AS tools, trim(text) <> '' AS said FROM t""")
def log_texts(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("blocks")
    return _log(spark, d).where("type = 'message'").select(_conv(), "line", content.joined_text(b, " ").alias("joined"), content.full_text(b).alias("whole"), content.preview_text(b).alias("preview"), F.array_join(content.tool_names(b), ",").alias("tools"), content.has_text(b).alias("said"))


@query(f"""WITH {_C} SELECT conv_id, rn AS line, 'k' || conv_id || ':' || turn AS call, tool AS name, 'p' || conv_id % 3 || '/m' AS provider_model, CASE WHEN tool = 'bash' THEN 'git push; ls ' || turn END AS command, CASE WHEN tool = 'read' THEN CASE WHEN conv_id % 2 = 0 THEN 'partial' ELSE 'full' END END AS mode, CASE WHEN tool = 'edit' THEN CASE conv_id % 3 WHEN 0 THEN 'oldText/newText' WHEN 1 THEN 'edits' ELSE 'mixed' END END AS style FROM t WHERE calls""")
def log_tool_uses(spark: SparkSession, d: str) -> DataFrame:
    a, name = F.col("arguments"), F.col("name")
    mode = content.read_mode(F.get_json_object(a, "$.offset"), F.get_json_object(a, "$.limit"))
    return sessions.tool_uses(_log(spark, d)).select(_conv(), "line", "call", "name", "provider_model", content.bash_command(a).alias("command"), F.when(name == "read", mode).alias("mode"), F.when(name == "edit", content.argument_style(a)).alias("style"))


@query(f"""WITH {_C} SELECT conv_id, rn AS line, 'k' || conv_id || ':' || turn AS call, 'read' AS name, length(text) % 2 = 0 AS is_error, text FROM t WHERE role = 'system'""")
def log_tool_results(spark: SparkSession, d: str) -> DataFrame:
    return sessions.tool_results(_log(spark, d)).select(_conv(), "line", "call", "name", "is_error", "text")


@query(f"""WITH {_C} SELECT conv_id, rn AS line, CASE role WHEN 'system' THEN 'toolResult' ELSE role END AS role, text FROM t""")
def log_model_messages(spark: SparkSession, d: str) -> DataFrame:
    return sessions.model_messages(_log(spark, d)).select(_conv(), "line", "role", content.joined_text(F.col("blocks")).alias("text"))


@query(f"""WITH {_C} SELECT conv_id, rn AS line, '[' || upper(role) || ']' || chr(10) || text AS section FROM t WHERE role <> 'system' AND trim(text) <> ''""")
def log_sections(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sections(_log(spark, d)).select(_conv(), "line", "section")


@query(f"""WITH {_C} SELECT conv_id, rn AS line, CAST(rn - 1 AS INTEGER) AS index, CASE role WHEN 'system' THEN 'toolResult' ELSE role END AS role, left(text || CASE WHEN calls THEN chr(10) || '[tool_call:' || tool || ']' ELSE '' END, 120) AS text, CASE WHEN calls THEN tool ELSE '' END AS tools FROM t""")
def log_previews(spark: SparkSession, d: str) -> DataFrame:
    return sessions.previews(_log(spark, d), 120).select(_conv(), "line", "index", "role", "text", F.array_join("tool_calls", ",").alias("tools"))


@query(f"""WITH {_C} SELECT conv_id, n + 2 AS line, '{{"n":' || conv_id || '}}' AS data FROM o""")
def log_custom_entries(spark: SparkSession, d: str) -> DataFrame:
    return sessions.custom_entries(_log(spark, d), "refinement").select(_conv(), "line", "data")


@query("""SELECT DISTINCT conv_id, conv_id || ':0' AS target, 'L' || conv_id % 3 AS label FROM conversations WHERE conv_id % 3 > 0""")
def log_labels(spark: SparkSession, d: str) -> DataFrame:
    return sessions.labels(_log(spark, d)).select(_conv(), "target", "label")


_LISTED = """(SELECT 's' || conv_id AS session_id, '/w/' || conv_id % 4 AS cwd, count(*) FILTER (role <> 'system') AS messages, coalesce(max(1704164645000 + conv_id * 100000 + turn * 1000) FILTER (role <> 'system'), 1704164645000) AS modified, CASE WHEN conv_id % 7 > 0 THEN 'N' || conv_id END AS name, CASE conv_id % 4 WHEN 0 THEN 'live' WHEN 3 THEN NULL ELSE 'archived' END AS state FROM conversations GROUP BY conv_id)"""


def _listing(spark: SparkSession, d: str, cwd: str | None = None) -> DataFrame:
    out = sessions.listing(spark, [_folder(spark, d)], cwd, "*.txt")
    return out.withColumn("modified", F.col("modified").cast("timestamp"))


@query(f"SELECT * FROM {_LISTED} WHERE cwd = '/w/1'")
def log_listing(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d, "/w/1").select("session_id", "cwd", "messages", clock.millis(F.col("modified")).alias("modified"), "name", "state")


@query(f"(SELECT 'all' AS scope, session_id FROM {_LISTED} ORDER BY modified DESC LIMIT 1) UNION ALL (SELECT 'folder', session_id FROM {_LISTED} WHERE cwd = '/w/2' ORDER BY modified DESC LIMIT 1)")
def log_most_recent(spark: SparkSession, d: str) -> DataFrame:
    all_ = _listing(spark, d)
    pick = lambda scope, cwd: filters.most_recent(all_, cwd).select(F.lit(scope).alias("scope"), "session_id")
    return pick("all", None).unionByName(pick("folder", "/w/2"))


@query(f"""WITH {_C} SELECT conv_id, rn AS line, length(text) + conv_id AS input, turn AS output, CAST(0.5 AS DOUBLE) AS cost, length(text) + turn AS uncached, length(text) + turn + conv_id AS spent, length(text) + turn AS goal FROM t WHERE role = 'assistant'""")
def log_usage(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("message.usage")
    s = sessions.usage_summary(u)
    tokens = {"uncached": filters.uncached_tokens(u["input"], u["output"], u["cacheWrite"]), "spent": filters.spent_tokens(u["input"], u["output"], u["cacheRead"], u["cacheWrite"]), "goal": filters.goal_tokens(u["input"], u["output"])}
    return _log(spark, d).where("message.role = 'assistant'").select(_conv(), "line", *(s[c].alias(c) for c in ("input", "output", "cost")), *(v.alias(k) for k, v in tokens.items()))


@query("""SELECT conv_id, max(1704164645000 + conv_id * 100000 + turn * 1000) AS latest FROM conversations GROUP BY 1""")
def log_latest_activity(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy(_conv()).agg(filters.latest_activity(F.col("message.timestamp")).alias("latest"))


@query("""SELECT conv_id, count(*) + 5 AS records FROM conversations WHERE conv_id % 6 > 0 GROUP BY conv_id""")
def log_ledgers(spark: SparkSession, d: str) -> DataFrame:
    """Logs read as ledgers, in which any line that is not an object is an error."""
    sound = _raw(spark, d).withColumn("conv_id", _conv()).where("conv_id % 6 > 0")
    return session_log.strict(sound, F.startswith("value", F.lit("{"))).groupBy("conv_id").agg(F.count("*").alias("records"))


@query("""SELECT conv_id, turn AS line, text FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')""")
def log_persisted(spark: SparkSession, d: str) -> DataFrame:
    """Entries that go to disk, written as a table, appended to it by a stream, and read back."""
    kept = sinks.persisted(session_log.from_conversations(_t(spark, d, "conversations"))).select(F.col("session_id").alias("conv_id"), "line", "text")
    path = f"{sinks.scratch(spark)}/persisted-{uuid.uuid4().hex}"
    sinks.overwrite(kept, f"{path}/first")
    stream = sinks.append_stream(spark.readStream.schema(kept.schema).parquet(f"{path}/first"), f"{path}/second", f"{path}/checkpoint")
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.schema(kept.schema).parquet(f"{path}/second")


@query("""SELECT p_name AS value, count(*) AS n FROM part WHERE octet_length(encode(p_name)) <= 11 GROUP BY 1""")
def log_live_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a followed folder, long ones dropped."""
    path = f"{sinks.scratch(spark)}/live-{uuid.uuid4().hex}"
    _t(spark, d, "part").select("p_name").write.text(f"{path}/in")
    stream = sinks.append_stream(sessions.live_lines(spark, f"{path}/in", 11), f"{path}/out", f"{path}/checkpoint")
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.schema("value string").parquet(f"{path}/out").groupBy("value").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, 'user' AS role, left(t, 200) AS preview FROM (SELECT doc_id, translate(coalesce(text, ''), '"\\' || chr(10), '   ') AS t FROM documents) WHERE length(t) + 84 > 600""")
def oversized_lines(spark: SparkSession, d: str) -> DataFrame:
    said = F.translate(F.coalesce("text", F.lit("")), '"\\\n', "   ")
    # 84 characters around the text
    value = F.concat(F.lit('{"type":"message","message":{"role":"user","content":[{"type":"text","text":"'), said, F.lit('"}]}}  '))
    rows = _t(spark, d, "documents").select(F.lit("f").alias("file"), F.col("doc_id").alias("line"), value.alias("value"))
    return sessions.oversized(rows, 600).select(F.col("line").alias("doc_id"), "role", "preview")


# reports, lists and schedules


@query("""SELECT event_id, epoch_ms(date_trunc('milliseconds', ts)) AS ms, ts >= TIMESTAMP '2024-01-05' AS since FROM events""")
def file_times(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("/logs/"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'"), F.lit("_id.jsonl"))
    rows = _events(spark, d).select("event_id", name.alias("file"))
    late = session_log.since(rows, F.lit("2024-01-05").cast("timestamp")).select("event_id", F.lit(True).alias("since"))
    at = session_log.file_timestamp(F.regexp_extract("file", r"([^/]+)$", 1))
    return rows.join(late, "event_id", "left").select("event_id", clock.millis(at).alias("ms"), F.coalesce("since", F.lit(False)).alias("since"))


@query(f"""SELECT event_id, event_type <> 'error' AND k <= 50 AS due, k >= 30 AS idle FROM (SELECT event_id, event_type, {K} AS k FROM events)""")
def due_jobs(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.timestamp_millis(c)
    status = F.when(F.col("event_type") == "error", "paused").otherwise("active")
    return _events(spark, d).select("event_id", predicates.due(status, at(F.col("k")), at(F.lit(50))).alias("due"), predicates.idle_for(at(F.lit(0)), at(F.col("k")), 30).alias("idle"))


@query("""SELECT p_partkey, contains(lower(p_brand), 'brand#1') AND p_type = 'ECONOMY' AND p_size % 3 = 1 AS call, contains(lower(p_brand), 'brand') AND (lower(p_brand) LIKE 'brand#2%' OR lower(p_brand) LIKE 'brand#3%') AND (contains(p_name, 'ring') OR contains(p_name, 'widget')) AS session, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_partkey END AS since FROM part""")
def report_filters(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    success = F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False)
    call = filters.calls(F.col("p_brand"), F.col("p_type"), success, "BRAND#1", "ECONOMY", True)
    session = filters.reported(F.col("p_brand"), F.array("p_type", "p_name"), "Brand", ("Brand#2", "Brand#3"), ("RING", "widget"))
    since = filters.cutoff(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("long")), F.col("p_partkey"))
    return p.select("p_partkey", call.alias("call"), session.alias("session"), since.alias("since"))


@query(f"""SELECT event_id, k % 3 = 0 AS spawned, k % 2 = 0 AND event_type <> 'error' AS shown, k = 0 AS empty, CASE WHEN k % 5 = 0 THEN 'working' WHEN event_type = 'view' OR k = 0 OR k > 50 THEN 'idle' ELSE 'working' END AS activity, k % 2 = 0 AND k % 3 > 0 AND k % 5 > 0 AS selectable, k > 10 AND k % 2 > 0 AND event_type <> 'error' AND k % 3 = 0 AS passivable FROM (SELECT event_id, event_type, {K} AS k FROM events)""")
def session_predicates(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("k"), F.col("event_type")
    return _events(spark, d).select(
        "event_id",
        filters.has_spawn_code(F.when(k % 3 == 0, " x ").when(k % 3 == 1, "  ")).alias("spawned"),
        filters.visible(F.when(k % 2 == 0, "live").otherwise("draft"), e == "error").alias("shown"),
        filters.is_empty(k).alias("empty"),
        filters.activity(k % 5 == 0, F.when(e == "view", "subagent"), k, k > 50).alias("activity"),
        filters.selectable(k % 2, k % 3 == 0, k % 5 == 0).alias("selectable"),
        filters.passivable(k > 10, k % 2 == 0, e == "error", k % 3 == 0).alias("passivable"),
    )


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey = 5 THEN 0 ELSE 1 END, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END, s_name) AS place FROM supplier""")
def daemon_list(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, ("orphan-file", "current", "unreachable", "stale"))), (i % 4 + 1).cast("int"))
    # the daemons of one machine
    return _t(spark, d, "supplier").select("s_suppkey", F.row_number().over(Window.orderBy(*filters.daemon_order(i == 5, status, F.col("s_name")))).cast("long").alias("place"))


@query("""SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 10 = 7 AND s_suppkey % 3 > 0 THEN 0 WHEN s_suppkey % 10 = 4 THEN 1 END AS INTEGER) AS tier FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 10 = 7 AND s_suppkey % 3 > 0 ORDER BY s_suppkey LIMIT 1""")
def selected_row(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("s_suppkey")
    rows = _t(spark, d, "supplier").withColumn("selectable", i % 2 == 1).withColumn("kind", F.when(i % 3 == 0, "agent").otherwise("session"))
    return filters.selected(rows, "s_suppkey", i % 10 == 7, i % 10 == 4, i % 10 == 9).select("s_suppkey", "tier")


@query("""SELECT c_custkey, 'label' AS kind, trim(c_name) || ' ' || c_mktsegment AS value FROM customer""")
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.select("c_custkey", F.lit("label").alias("kind"), agents.search_text(F.concat(F.lit(" "), "c_name", F.lit("  ")), F.lit(None), F.lit("  "), F.col("c_mktsegment")).alias("value"))


@query("""SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT 100000000 + c_nationkey FROM customer WHERE c_nationkey > 3""")
def registration_keys(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("job"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey") + 100_000_000).cast("long").alias("owner"))
    keys = agents.registrations(c, "job", "owner")
    return keys["job"].select(F.col("job").alias("id")).unionByName(keys["owner"].select(F.col("owner").alias("id")))


@query("""SELECT conv_id || ':' || turn AS id FROM conversations WHERE role <> 'system' AND contains(lower(role || ' ' || text), 'the') AND NOT (role = 'assistant' AND trim(text) = '')""")
def shown_entries(spark: SparkSession, d: str) -> DataFrame:
    e = session_log.from_conversations(_t(spark, d, "conversations")).withColumn("stop_reason", F.lit("stop")).withColumn("label", F.lit(None).cast("string")).withColumn("is_tool", F.col("role") == "system")
    return predicates.shown(e, "no-tools", "The").select("id")


@query("""SELECT conv_id AS file, conv_id || ':' || turn AS id, conv_id || ':' || lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations WHERE role <> 'system'""")
def branch_copies(spark: SparkSession, d: str) -> DataFrame:
    e = session_log.from_conversations(_t(spark, d, "conversations"))
    path = trees.walked(e, "session_id", "line", "id", "parent").withColumnRenamed("session_id", "file")
    entries = e.select(F.col("session_id").alias("file"), "id", F.col("role").alias("type"), F.col("parent").alias("parentId"))
    return sessions.branch_copy(entries, path, "system").select("file", "id", F.col("parentId").alias("parent"))


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) ORDER BY n_regionkey * 1000 + n_nationkey DESC LIMIT 1""")
def deepest_scope(spark: SparkSession, d: str) -> DataFrame:
    frames = _t(spark, d, "nation").withColumn("depth", F.col("n_regionkey") * 1000 + F.col("n_nationkey"))
    there = _t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return agents.deepest_frame(frames, there, "n_nationkey", "depth").select("n_nationkey", "n_name")


@query(f"""WITH RECURSIVE n AS {_TREE}, t AS (SELECT id, CAST(id AS VARCHAR) AS path, CAST(0 AS INTEGER) AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, path || '/' || n.id, depth + 1 FROM n JOIN t ON n.parent = t.id) SELECT id, path, depth FROM t""")
def preorder_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes, closed = _tree(spark, d)
    out = trees.preorder(nodes.withColumn("o", F.col("id")), closed, "id", "o")
    return out.select("id", F.array_join(F.transform("path", lambda s: s["id"].cast("string")), "/").alias("path"), "depth")


@query("""SELECT DISTINCT p_brand AS provider, id, CAST(CASE WHEN lower(id) LIKE '%ring%' THEN 0 WHEN lower(p_brand || '/' || id) LIKE 'brand#1%widget%' THEN 1 ELSE 2 END AS INTEGER) AS place, p_partkey % 3 <> 0 AS alias FROM (SELECT *, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '-20240102' ELSE '' END AS id FROM part) WHERE lower(id) LIKE '%ring%' OR lower(p_brand || '/' || id) LIKE 'brand#1%widget%' OR lower(p_brand || '/' || id) LIKE 'brand#2/%'""")
def scoped_models(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 3 == 0, "-20240102").otherwise(""))
    catalog = _t(spark, d, "part").select(F.col("p_brand").alias("provider"), id_.alias("id")).distinct()
    return agents.scoped_models(catalog, ["RING", "brand#1*widget*", "Brand#2/*"]).select("provider", "id", "place", text.is_alias(F.col("id")).alias("alias"))


@query("""SELECT max(replace(p_name, ' ', '-')) FILTER (p_partkey % 3 <> 0) AS id FROM part WHERE p_name LIKE '%ring%'""")
def matched_model(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 3 == 0, "-20240102").otherwise(""))
    return agents.matched_model(_t(spark, d, "part").select(id_.alias("id")), "RING").select("id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS x, o_orderstatus AS y, CASE WHEN o_orderkey % 2 = 0 THEN 'n' END AS z, o_orderpriority AS other FROM orders""")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    one = lambda k, v: F.create_map(F.lit(k), v)
    base = F.create_map(F.lit("ui"), F.create_map(F.lit("x"), F.col("o_orderstatus"), F.lit("y"), F.col("o_orderstatus")))
    over = F.when(even, F.create_map(F.lit("ui"), F.create_map(F.lit("x"), F.col("o_orderpriority"), F.lit("z"), F.lit("n")), F.lit("other"), one("v", F.col("o_orderpriority")))).otherwise(one("other", one("v", F.col("o_orderpriority"))))
    m = merging.deep_merged(base, over)
    at = lambda a, b: F.try_element_at(F.try_element_at(m, F.lit(a)), F.lit(b))
    return _t(spark, d, "orders").select("o_orderkey", at("ui", "x").alias("x"), at("ui", "y").alias("y"), at("ui", "z").alias("z"), at("other", "v").alias("other"))


# texts


@query(r"""SELECT event_id, CASE k % 6 WHEN 0 THEN 'claude' WHEN 1 THEN 'gpt' WHEN 2 THEN 'o3' ELSE 'custom' END AS model, CASE k % 6 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'xai' WHEN 2 THEN 'unknown' WHEN 3 THEN 'openai' ELSE 'custom' END AS provider, CASE WHEN k = 10 THEN 'overloaded' WHEN k = 42 THEN 'auth' WHEN k % 9 = 0 THEN 'refusal' WHEN k % 9 = 1 THEN 'safety' WHEN k % 9 = 2 THEN 'overloaded' WHEN k % 9 = 3 THEN 'rate_limit' WHEN k % 9 = 4 THEN 'auth' WHEN k % 9 = 5 THEN 'invalid_request' WHEN k % 9 = 6 THEN 'malformed_response' WHEN k % 9 = 7 AND k > 50 THEN 'server_error' WHEN k % 9 = 8 AND k < 50 THEN 'invalid_request' WHEN k % 9 = 8 THEN 'server_error' ELSE 'unknown' END AS failure FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def families_and_failures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    of = lambda values, n: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (k % n + 1).cast("int"))
    model = of(("Claude-3", "my-GPT-4o1", "o3-mini", "grok", "", None), 6)
    provider = of(("Anthropic", "xAI", "", "azure-openai", "local", "mine"), 6)
    kind = of(("Refusal", "SAFETY", None, "throttling_error", "permission_error", None, "malformed_x", None, None), 9)
    status = F.when(k % 9 == 2, 529).when(k % 9 == 5, F.when(k % 2 == 0, 400).otherwise(404)).when((k % 9 == 7) & (k > 50), 500).when(k % 9 == 8, F.when(k < 50, 404).otherwise(503))
    fixed = F.when(k == 10, F.lit(None)).when(k == 42, F.lit(None)).otherwise(status)
    return _events(spark, d).select("event_id", text.model_family(model).alias("model"), text.provider_family(provider).alias("provider"), text.stream_failure(F.when(k == 10, "overloaded").when(k == 42, "authentication").otherwise(kind), fixed).alias("failure"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE left(t, 50) || chr(10) || '... ' || (length(t) - 100) || ' characters omitted ...' || chr(10) || right(t, 50) END AS body, CASE WHEN length(t) <= 60 THEN t ELSE left(t, 60) || chr(10) || chr(10) || '[... ' || (length(t) - 60) || ' more characters truncated]' END AS cut FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def shortened_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _t(spark, d, "documents").select("doc_id", content.head_and_tail(t, 100).alias("body"), text.cut_summary(t, 60).alias("cut"))


@query("""SELECT doc_id, f || chr(10) || t || chr(10) || f AS fenced FROM (SELECT doc_id, t, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0))) AS f FROM (SELECT doc_id, replace(replace(coalesce(text, ''), 'e', '`'), 'n', '`') AS t FROM documents))""")
def fenced_outputs(spark: SparkSession, d: str) -> DataFrame:
    t = F.translate(F.coalesce("text", F.lit("")), "en", "``")
    return _t(spark, d, "documents").select("doc_id", content.fenced_output(t).alias("fenced"))


@query("""SELECT doc_id, length(t) + 2 * (length(t) - length(replace(t, chr(10), ''))) + 1 AS crlf, CASE WHEN contains(t, chr(10)) THEN chr(13) || chr(10) ELSE chr(10) END AS ending, t AS lf, length(t) AS plain FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def line_endings(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    crlf = F.concat(F.lit("﻿"), F.replace(t, F.lit("\n"), F.lit("\r\n")))
    bare = text.without_bom(crlf)
    back = text.from_lf(text.to_lf(bare), text.line_ending(bare))
    coloured = F.replace(back, F.lit("\r\n"), F.lit("\x1b[31m\r\n"))
    return _t(spark, d, "documents").select(
        "doc_id",
        (F.length(crlf) + F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("crlf"),
        text.line_ending(bare).alias("ending"),
        text.to_lf(text.without_ansi(coloured)).alias("lf"),
        F.length(text.to_lf(bare)).cast("long").alias("plain"),
    )


@query("""SELECT page_id, '--' || regexp_replace(regexp_replace('/' || url, '^[/\\\\]', ''), '[/\\\\:]', '-', 'g') || '--' AS folder FROM pages""")
def directory_keys(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", text.directory_key(F.concat(F.lit("/"), "url")).alias("folder"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'name: ' || p_name END AS header, CASE WHEN p_partkey % 2 = 0 THEN p_type || chr(10) || 'end' ELSE p_type END AS body, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS skill, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS told FROM part""")
def headed_texts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    page = F.when(i % 2 == 0, F.concat(F.lit("---\nname: "), "p_name", F.lit("\n---\n"), "p_type", F.lit("\nend"))).otherwise(F.col("p_type"))
    block = F.when(i % 3 == 0, F.concat(F.lit('x <skill name="'), "p_name", F.lit('" v="1">\n'), "p_type", F.lit("\n</skill> y"))).otherwise("<skill>")
    matter, skill = text.front_matter(page), agents.skill(block)
    return _t(spark, d, "part").select("p_partkey", matter["header"].alias("header"), matter["body"].alias("body"), skill["name"].alias("skill"), skill["body"].alias("told"))


@query("""SELECT s_suppkey, '127.0.0.1:' || s_suppkey AS address, s_suppkey + 100 AS pid, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS agent, s_suppkey * 3 AS seconds FROM supplier""")
def process_lines(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("s_suppkey")
    n = i.cast("string")
    row = agents.sockets(F.concat(F.lit("LISTEN 0  128 127.0.0.1:"), n, F.lit(' 0.0.0.0:*  users:(("node",pid='), (i + 100).cast("string"), F.lit(",fd=3))")))
    ps = F.concat(F.lit("  "), n, F.when(i % 2 == 0, " node my-agent run").otherwise(" node other"))
    return _t(spark, d, "supplier").select("s_suppkey", row["address"].alias("address"), row["pid"].alias("pid"), text.process_ids(ps, "my-agent").alias("agent"), text.elapsed(F.concat(F.lit(" "), n, F.lit("   "), (i * 3).cast("string")))["seconds"].alias("seconds"))


@query("""SELECT DISTINCT o_custkey AS pid, '*:' || o_orderkey % 50 AS name FROM orders""")
def listening_ports(spark: SparkSession, d: str) -> DataFrame:
    """lsof rows: a process line, then one line for each of its ports; a file per process here."""
    o = _t(spark, d, "orders")
    who = o.select(F.col("o_custkey").alias("file"), F.lit(-1).cast("long").alias("n"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("value")).distinct()
    ports = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("n"), F.concat(F.lit("n*:"), (F.col("o_orderkey") % 50).cast("string")).alias("value"))
    return sessions.listeners(who.unionByName(ports), "n")


@query("""SELECT conv_id, turn, CASE WHEN before IS NULL THEN 0 ELSE list_max(list_filter(range(0, least(length(before), length(text)) + 1), lambda k: left(before, k) = left(text, k))) // 4 END AS cache_read, CAST(ceil(length(text) / 4) AS BIGINT) - CASE WHEN before IS NULL THEN 0 ELSE list_max(list_filter(range(0, least(length(before), length(text)) + 1), lambda k: left(before, k) = left(text, k))) // 4 END AS cache_write FROM (SELECT conv_id, turn, role || ': ' || text AS text, lag(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""")
def prompt_cache(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").withColumn("prompt", F.concat_ws(": ", "role", "text"))
    return agents.cached_usage(c, "conv_id", "turn", "prompt").select("conv_id", "turn", "cache_read", "cache_write")


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 3 WHEN p_partkey % 3 = 1 THEN 2 ELSE 1 END AS BIGINT) AS blocks, CASE WHEN p_partkey % 3 = 0 THEN p_name || '|[image]|' || p_type WHEN p_partkey % 3 = 1 THEN p_name || '|[image]' ELSE '[image]' END AS said FROM part""")
def without_images(spark: SparkSession, d: str) -> DataFrame:
    kind = session_log.BLOCK
    block = lambda type_, said, data: F.struct(*(({"type": F.lit(type_), "text": said, "data": data}.get(f.name, F.lit(None))).cast("string").alias(f.name) for f in kind.fields))
    none = F.lit(None)
    image = block("image", none, F.lit("QUJD"))
    i = F.col("p_partkey") % 3
    blocks = F.when(i == 0, F.array(block("text", F.col("p_name"), none), image, image, block("text", F.col("p_type"), none))).when(i == 1, F.array(block("text", F.col("p_name"), none), image)).otherwise(F.array(image, image, image))
    out = content.without_images(blocks, "[image]")
    return _t(spark, d, "part").select("p_partkey", F.size(out).cast("long").alias("blocks"), content.joined_text(out, "|").alias("said"))


@query("""SELECT p_partkey, p_name || chr(10) || p_brand AS folded, CAST((length(p_name) - length(replace(p_name, 'in', ''))) // 2 AS BIGINT) AS times, CASE WHEN (length(p_name) - length(replace(p_name, 'i', ''))) = 1 THEN replace(p_name, 'i', 'II') END AS edited, CASE WHEN NOT contains(p_name, 'i') THEN 'could not find the exact text' WHEN length(p_name) - length(replace(p_name, 'i', '')) > 1 THEN 'found multiple occurrences' END AS error, '@@ -1,2 +1,2 @@' || chr(10) || ' ' || p_type || chr(10) || '-' || p_name || chr(10) || '+' || p_name || '!' AS diff FROM part""")
def text_edits(spark: SparkSession, d: str) -> DataFrame:
    name, kind, line = F.col("p_name"), F.col("p_type"), F.lit("\n")
    done = R.edit(name, F.lit("i"), F.lit("II"))
    return _t(spark, d, "part").select(
        "p_partkey",
        R.fold(F.concat(name, F.lit("  \n"), "p_brand", F.lit(" "))).alias("folded"),
        R.occurrences(name, F.lit("in")).alias("times"),
        done["text"].alias("edited"),
        done["error"].alias("error"),
        R.diff(F.concat(kind, line, name), F.concat(kind, line, name, F.lit("!"))).alias("diff"),
    )


@query("""SELECT p_partkey, '[' || p_name || '][' || p_type || ']' AS args, p_type || '-' || p_name || '-' || p_name || ' ' || p_type || '-' AS filled FROM part""")
def command_arguments(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("'"), "p_name", F.lit("'  \""), "p_type", F.lit('"'))
    words = R.words(line)
    return _t(spark, d, "part").select("p_partkey", F.array_join(F.transform(words, lambda w: F.concat(F.lit("["), w, F.lit("]"))), "").alias("args"), R.filled(F.lit("$2-$1-$ARGUMENTS-$7"), words).alias("filled"))


@query("""SELECT p_partkey, '{"a": "x\\\\q", "n": ' || p_size || '}' AS repaired, true AS open, '{"a": "' || p_name || '"}' AS streamed, '{"n": ' || p_size || '}' AS found FROM part""")
def json_texts(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return _t(spark, d, "part").select(
        "p_partkey",
        R.json_repaired(F.concat(F.lit('{"a": "x\\q", "n": '), size, F.lit("}"))).alias("repaired"),
        R.json_open(F.concat(F.lit('{"a": "'), "p_name")).alias("open"),
        R.json_streamed(F.concat(F.lit('{"a": "'), "p_name")).alias("streamed"),
        R.json_found(F.concat(F.lit('said:\n```json\n{"n": '), size, F.lit("}\n```\nend"))).alias("found"),
    )


@query("""SELECT p_partkey, '{"n": ' || p_size || ', "s": "' || p_size || '", "b": ' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "l": [1, 2], "x": "' || p_name || '"}' AS value FROM part""")
def conformed_json(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "s": {"type": "string"}, "b": {"type": "boolean"}, "l": {"type": "array", "items": {"type": "number"}}, "x": {"type": ["string", "null"]}}}
    raw = F.concat(F.lit('{"n": "'), size, F.lit('", "s": '), size, F.lit(', "b": "'), F.when(F.col("p_partkey") % 2 == 0, "true").otherwise("false"), F.lit('", "l": ["1", 2], "x": "'), "p_name", F.lit('"}'))
    return _t(spark, d, "part").select("p_partkey", R.json_conformed(schema)(raw).alias("value"))


@query("""SELECT p_partkey, upper(p_name) AS loud FROM part""")
def registered_function(spark: SparkSession, d: str) -> DataFrame:
    agents.register(spark, "sessionweave_loud", lambda x: x.str.upper(), "string")
    return _t(spark, d, "part").selectExpr("p_partkey", "sessionweave_loud(p_name) AS loud")
