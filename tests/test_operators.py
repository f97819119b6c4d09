"""Operators on small logs, row order and partitions shuffled."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionweave.operators import folds, matching, merging, positions, ranking, trees
from sessionweave.sources import session_log, sinks
from sessionweave.streaming import live


def got(df) -> list[tuple]:  # noqa: ANN001
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_log_ingest(spark, tmp_path):  # noqa: ANN001
    lines = [
        {"type": "session", "id": "s1", "version": 3, "cwd": "/x"},
        {"type": "message", "id": "a", "parentId": None, "message": {"role": "user", "content": "hi there"}},
        {"type": "message", "id": "b", "parentId": "a", "message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}], "usage": {"input": 1, "totalTokens": 3}}},
    ]
    (tmp_path / "sub").mkdir()
    body = "\n".join(json.dumps(x, ensure_ascii=False) for x in lines)
    (tmp_path / "sub" / "2024-01-02T03-04-05-678Z_s1.jsonl").write_text(body + "\n{broken\n\n", encoding="utf-8")
    (tmp_path / "other.jsonl").write_text('{"type":"message","id":"x"}\n')
    raw = session_log.lines(spark, str(tmp_path))
    log = session_log.entries(raw)
    rows = log.orderBy("line").collect()
    assert [(r.line, r.session_id, r.type, r.bad_lines) for r in rows] == [(0, "s1", "session", 1), (1, "s1", "message", 1), (2, "s1", "message", 1)]
    assert rows[1].blocks[0].text == "hi there" and rows[2].message.usage.totalTokens == 3
    assert [r.cwd for r in session_log.headers(log).collect()] == ["/x"]
    assert session_log.since(log, F.to_timestamp(F.lit("2024-01-03"))).count() == 0
    assert session_log.since(log, F.to_timestamp(F.lit("2024-01-01"))).count() == 3


def test_ledger_policies(spark, tmp_path):  # noqa: ANN001
    known = F.try_parse_json("value").isNotNull()
    torn = tmp_path / "torn"
    torn.mkdir()
    (torn / "a.jsonl").write_text('{"a":1}\n{"a":')
    assert session_log.strict(session_log.lines(spark, str(torn)), known).count() == 1
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.jsonl").write_text('{"a":\n{"a":1}\n')
    with pytest.raises(Exception, match="malformed"):
        session_log.strict(session_log.lines(spark, str(bad)), known).collect()
    with pytest.raises(Exception, match="too many"):
        session_log.strict(session_log.lines(spark, str(torn)), known, max_records=1).collect()


def test_sinks(spark, tmp_path):  # noqa: ANN001
    df = spark.createDataFrame([("s", 0, "session_info", None), ("s", 1, "message", "user"), ("t", 0, "message", "user"), ("t", 1, "message", "assistant")], "session_id string, line long, type string, role string")
    assert sorted((r.session_id, r.line) for r in sinks.persisted(df).collect()) == [("s", 0), ("t", 0), ("t", 1)]
    p = spark.createDataFrame([("g", i, "x" * n) for i, n in enumerate([4, 4, 20, 1, 9])], "g string, o long, t string")
    assert [r.bin for r in sinks.packed(p, "g", "o", F.length("t"), 10).orderBy("o").collect()] == [0, 0, 1, 2, 2]
    sinks.overwrite(p, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5


def test_calls(spark):  # noqa: ANN001
    log = spark.createDataFrame([("f", 0, "x", "c"), ("f", 1, "x", "c"), ("f", 2, "x", "r"), ("f", 3, "y", "r"), ("f", 4, "y", "c"), ("f", 5, "x", "r")], "f string, o long, id string, kind string")
    out = matching.matched_calls(log.repartition(3), "f", "o", "id", F.col("kind") == "c", F.col("kind") == "r")
    assert {r.o: (r.state, r.call) for r in out.collect()} == {0: ("replaced", None), 1: ("resolved", None), 2: ("matched", 1), 3: ("unmatched", None), 4: ("missing_result", None), 5: ("unmatched", None)}


def test_attribution(spark):  # noqa: ANN001
    m = spark.createDataFrame([("f", "a", 10), ("f", "b", 5)], "f string, id string, v long")
    a = spark.createDataFrame([("f", "a", 1, 3), ("f", "a", 2, 4), ("f", "b", 3, 9)], "f string, id string, o long, v long")
    assert {r.id: r.net for r in matching.attributed(m, a, "f", "id", "o", "v").collect()} == {"a": 6, "b": 0}


def test_cut_point(spark):  # noqa: ANN001
    rows = [("s", 0, "session", None, 0)] + [("s", i, "message", "user" if i % 2 else "assistant", 10) for i in range(1, 9)]
    rows.insert(7, ("s", 9, "message", "toolResult", 30))
    rows.append(("s", 10, "model_change", None, 0))
    rows.append(("s", 11, "message", "user", 10))
    df = spark.createDataFrame(rows, "s string, o long, type string, role string, tokens long")
    msg, role = F.col("type") == "message", F.col("role")

    def cut(budget: int):  # noqa: ANN202
        out = positions.cut_points(df.repartition(2), "s", "o", "tokens", msg, msg & role.isin("user", "assistant"), msg | (F.col("type") == "compaction"), msg & (role == "user"), msg & (role == "user"), budget)
        return tuple(out.first())[1:]

    assert cut(10) == (10, 7, True)
    assert cut(35) == (10, 7, True)
    assert cut(50) == (8, 7, True)
    assert cut(60) == (7, None, False)
    assert cut(10_000) == (0, None, False)


def test_compacted_context(spark):  # noqa: ANN001
    df = spark.createDataFrame([("s", 0, False, None), ("s", 1, False, None), ("s", 2, True, 1), ("s", 3, False, None), ("t", 0, False, None)], "s string, o long, c boolean, kept long")
    out = positions.context_after_compaction(df, "s", "o", F.col("c"), "kept")
    assert [(r.s, r.o) for r in out.orderBy("s", "rank").collect()] == [("s", 2), ("s", 1), ("s", 3), ("t", 0)]


def test_states(spark):  # noqa: ANN001
    df = spark.createDataFrame([("s", 0, "a", True), ("s", 1, "bad", False), ("t", 0, "x", True), ("t", 1, " ", True)], "s string, o long, v string, ok boolean")
    assert got(positions.last_valid(df, "s", "o", "v", F.col("ok"))) == [("s", "a"), ("t", " ")]
    assert got(positions.last_value(df, "s", "o", "v")) == [("s", "bad"), ("t", None)]


def test_trees(spark):  # noqa: ANN001
    n = spark.createDataFrame([(1, None, 1.0), (2, 1, 2.0), (3, 2, 4.0), (4, 1, 8.0), (9, 77, 16.0)], "id long, parent long, v double")
    closed = trees.closure(n, "id", "parent")
    assert {r.id: (r.total, r.descendants) for r in trees.rollup(n.select("id", "v"), closed, "id", "v").collect()}[1] == (15.0, 3)
    assert got(trees.common_ancestor(closed, spark.createDataFrame([(3, 4)], "a long, b long"), "a", "b")) == [(3, 4, 1)]
    assert {r.id: r.parent for r in trees.promoted(n, "id", "parent").collect()}[9] is None
    assert [r.id for r in trees.preorder(n.where("id < 9"), closed, "id", "id").orderBy("path").collect()] == [1, 2, 3, 4]
    loop = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long")
    assert trees.closure(loop, "id", "parent").count() == 4
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "id long, parent long")
    assert trees.closure(deep, "id", "parent").count() == 300 * 301 // 2


def test_walk(spark):  # noqa: ANN001
    log = spark.createDataFrame([("s", 0, "a", None), ("s", 1, "b", "a"), ("s", 2, "fork", "a"), ("s", 3, "c", "b")], "s string, o long, id string, p string")
    assert [(r.id) for r in trees.walked(log, "s", "o", "id", "p").orderBy("step").collect()] == ["a", "b", "c"]


def test_merging(spark):  # noqa: ANN001
    a = spark.createDataFrame([("x", 1, 5), ("y", 1, None)], "k string, v long, u long")
    b = spark.createDataFrame([("x", 2, 5), ("z", 3, 1)], "k string, v long, u long")
    assert got(merging.freshest(a, b, "k", "u").select("k", "v")) == [("x", 2), ("y", 1), ("z", 3)]
    j = spark.createDataFrame([("a", 0, "received"), ("a", 1, "result"), ("b", 0, "received"), ("c", 0, "result"), ("d", 0, "received"), ("d", 1, "result"), ("d", 2, "acknowledged")], "k string, o long, t string")
    assert got(merging.idempotent(j, "k", "o", "t")) == [("a", "complete"), ("b", "pending")]
    led = spark.createDataFrame([("a", 0, "rename", "early"), ("a", 1, "spawn", "n1"), ("a", 2, "rename", "n2"), ("b", 0, "spawn", "m"), ("b", 1, "delete", None), ("c", 0, "delete", None)], "k string, o long, op string, n string")
    assert got(merging.keyed_state(led, "k", "o", "op", "n")) == [("a", "n2", False), ("b", "m", True)]


def test_ranking(spark):  # noqa: ANN001
    ids = spark.createDataFrame([("abcdef",), ("abcdeg",), ("zzz",)], "id string")
    assert got(ranking.closest(ids, "id", "abcdef")) == [("abcdef", 0)]
    assert got(ranking.closest(ids, "id", "abcdeh")) == []
    w = spark.createDataFrame([(None, 1, "a"), (2.0, 5, "B"), (2.0, 5, "a"), (3.0, 1, "c")], "r double, s long, p string")
    assert [(r.r, r.p) for r in ranking.worst(w, "r", "s", "p", 9).collect()] == [(None, "a"), (3.0, "c"), (2.0, "a"), (2.0, "B")]


EVENTS = "file string, line long, type string, session string, request string, compaction string, status string, child string, spawned_by string"


def ledger(*events: dict) -> list[tuple]:
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return [tuple({"file": "f", "line": i, **e}.get(n) for n in names) for i, e in enumerate(events)]


def test_edges(spark):  # noqa: ANN001
    turn = lambda s, r: [{"type": "request_started", "session": s, "request": r}, {"type": "request_finished", "request": r}]
    parent = ledger({"type": "session_registered", "session": "p"}, *turn("p", "r1"), *turn("p", "r2"), {"type": "child_returned", "session": "p", "child": "c", "request": "k2"}, {"type": "child_returned", "session": "p", "child": "c", "request": "k2"}, *turn("p", "r3"))
    child = [("g", *r[1:]) for r in ledger({"type": "session_registered", "session": "c", "spawned_by": "r2"}, *turn("c", "k1"), *turn("c", "k2"))]
    want = {("r1", "r2", "continuation"), ("r2", "k1", "subagent_call"), ("k1", "k2", "continuation"), ("k2", "r3", "subagent_return"), ("r2", "r3", "continuation")}
    for rows in (parent + child, child + parent, (parent + child)[::-1]):
        assert {tuple(r) for r in folds.semantic_edges(spark.createDataFrame(rows, EVENTS)).collect()} == want


def test_edges_compaction_and_failure(spark):  # noqa: ANN001
    rows = ledger(
        {"type": "request_started", "session": "s", "request": "a"},
        {"type": "request_finished", "request": "a"},
        {"type": "child_returned", "session": "s", "child": "c", "request": "k"},
        {"type": "compaction_begun", "session": "s", "compaction": "z"},
        {"type": "request_started", "session": "s", "request": "sum", "compaction": "z"},
        {"type": "request_finished", "request": "sum"},
        {"type": "compaction_finished", "compaction": "z", "status": "completed"},
        {"type": "request_started", "session": "s", "request": "b"},
        {"type": "request_failed", "request": "b"},
        {"type": "request_started", "session": "s", "request": "b2"},
        {"type": "request_finished", "request": "b2"},
    )
    got_ = {tuple(r) for r in folds.semantic_edges(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got_ == {("a", "sum", "continuation"), ("k", "sum", "subagent_return"), ("sum", "b2", "compaction")}


def test_rate_limit(spark):  # noqa: ANN001
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate([0, 0, 0, 10, 1000, 1001])], "k string, o long, t long")
    out = folds.rate_limited(df.repartition(3), "k", "o", "t").orderBy("o").collect()
    assert [(r.ok, r.retry_after_ms) for r in out] == [(True, None), (True, None), (True, None), (False, 990), (True, None), (False, 999)]


def test_claims_and_proposals(spark):  # noqa: ANN001
    jobs = spark.createDataFrame([("s", "j", 100, 50, 60)], "store string, job string, next_ms long, every_ms long, busy_ms long")
    ticks = spark.createDataFrame([("s", i, t) for i, t in enumerate([90, 100, 150, 260])], "store string, tick long, at long")
    # at 150 the job is due but busy until 160: that run is skipped, and the next is due at 200
    assert got(folds.claimed(jobs, ticks)) == [("j", 1, 100, 100), ("j", 3, 260, 200)]
    once = spark.createDataFrame([("s", "j", 95, 0, 60)], jobs.schema)
    assert got(folds.claimed(once, ticks)) == [("j", 1, 100, 95)]
    p = spark.createDataFrame([("e", 0, "create", "a", None), ("e", 1, "update", "b", 1), ("e", 2, "update", "c", 1), ("e", 3, "create", "d", None)], "entity string, ord long, op string, value string, base long")
    assert got(folds.applied_proposals(p)) == [("e", 2, "b", 2)]


DELTAS = [("s", 1, "message_start", None, None), ("s", 2, "text_start", 0, None), ("s", 3, "text_delta", 0, "he"), ("s", 4, "text_delta", 0, "y"), ("s", 5, "thinking_start", 1, None), ("s", 6, "thinking_end", 1, "why"), ("s", 7, "message_end", None, None), ("t", 1, "text_delta", 0, "lost"), ("t", 2, "message_start", None, None), ("t", 3, "session_closed", None, None)]
SCHEMA = "session string, seq long, kind string, index_ long, value string"


def test_rebuild_batch_and_stream(spark, tmp_path):  # noqa: ANN001
    df = spark.createDataFrame(DELTAS, SCHEMA)
    want = [("s", 7, "text:hey\nthinking:why", True)]
    assert got(live.rebuilt_batch(df.repartition(3))) == want
    for i, rows in enumerate((DELTAS[:3], DELTAS[3:])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"d={i}"))
    stream = spark.readStream.schema(SCHEMA + ", d int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.rebuilt(stream.drop("d")).writeStream.format("memory").queryName("rebuilt").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    try:
        q.processAllAvailable()
        assert got(spark.table("rebuilt")) == want
    finally:
        q.stop()


def streamed(spark, tmp_path, rows, schema, make, mode):  # noqa: ANN001, ANN201
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"d={i}"))
    source = spark.readStream.schema(schema + ", d int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("d")
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_runs_batch_and_stream(spark, tmp_path):  # noqa: ANN001
    rows = [("s", 0, "text", 1), ("s", 1, "run_start", 10), ("s", 2, "turn_start", 11), ("s", 3, "tool_start", 12), ("s", 4, "text", 15), ("s", 5, "text", 16), ("s", 6, "run_end", 30), ("s", 7, "run_start", 40), ("s", 8, "tool_error", 41), ("s", 9, "run_start", 50), ("s", 10, "run_error", 55)]
    schema = "session string, seq long, kind string, ms long"
    want = [("s", 1, 1, 1, 0, 5, 20, "done"), ("s", 2, 0, 0, 1, None, 10, "lost"), ("s", 3, 0, 0, 0, None, 5, "error")]
    assert got(live.runs_batch(spark.createDataFrame(rows, schema).repartition(3))) == want
    assert sorted(tuple(r) for r in streamed(spark, tmp_path, rows, schema, live.runs, "append")) == want


def test_tails(spark, tmp_path):  # noqa: ANN001
    rows = [("s", i, f"line {i} é\n") for i in range(10)]
    out = streamed(spark, tmp_path, rows, "session string, seq long, chunk string", lambda d: live.tails(d, 12), "update")
    last = max(out, key=lambda r: r.total_bytes)
    assert (last.total_lines, last.total_bytes) == (10, 100) and last.tail.endswith("line 9 é\n") and len(last.tail.encode()) <= 12


def test_replay_and_outbox(spark):  # noqa: ANN001
    r = spark.createDataFrame([(5, True), (99, True), (0, True), (5, False)], "a long, same boolean")
    out = r.select(live.replay(F.col("a"), F.lit(3), F.lit(9), F.col("same")).alias("x")).select("x.*").collect()
    assert [(x.status, x.reason) for x in out] == [("complete", None), ("unavailable", "ahead"), ("unavailable", "expired"), ("unavailable", "stream_changed")]
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], "path string, size long, mtime long")
    sent = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size long, mtime long")
    assert [r.path for r in live.outbox(files, sent).orderBy("path").collect()] == ["b", "c"]


def test_conversations(spark):  # noqa: ANN001
    c = spark.createDataFrame([(1, 0, "user", "abcde"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    e = session_log.from_conversations(c).orderBy("line").collect()
    assert [(x.id, x.parent, x.tokens) for x in e] == [("1:0", None, 2), ("1:1", "1:0", 0)]


def test_trees_without_closures(spark):  # noqa: ANN001
    n = spark.createDataFrame([(1, None, 10.0), (2, 1, 3.0), (3, 1, None), (4, 3, 2.0), (5, 99, 7.0), (6, 6, 1.0), (7, 8, 1.0), (8, 7, 1.0)], "id long, parent long, v double")
    flat = trees.totals(n.fillna(0.0, ["v"]), "id", "parent", "v").collect()
    assert {r.id: (r.total, r.descendants) for r in flat if r.id < 7} == {1: (15.0, 3), 2: (3.0, 0), 3: (2.0, 1), 4: (2.0, 0), 5: (7.0, 0), 6: (1.0, 0)}
    assert {r.id: r.value for r in trees.inherited(n, "id", "parent", F.col("v")).collect()}[3] == 10.0
    assert {r.id: r.value for r in trees.inherited(n, "id", "parent", F.col("v"), own=False).collect() if r.id < 7} == {1: None, 2: 10.0, 3: 10.0, 4: 10.0, 5: None, 6: None}
    asked = spark.createDataFrame([(4,), (5,), (77,)], "id long")
    assert got(trees.paths_up(n, "id", "parent", asked)) == [(4, 1, 2), (4, 3, 1), (4, 4, 0), (5, 5, 0), (5, 99, 1)]


def test_a_long_chain(spark):  # noqa: ANN001
    n = 100_000
    chain = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent", "1 AS v")
    top = trees.totals(chain, "id", "parent", "v").where(f"id IN (0, {n // 2}, {n - 1})").collect()
    assert {r.id: (r.total, r.descendants) for r in top} == {0: (n, n - 1), n // 2: (n // 2, n // 2 - 1), n - 1: (1, 0)}
    named = trees.inherited(chain, "id", "parent", F.when(F.col("id") % 40_000 == 7, F.col("id")))
    assert {r.id: r.value for r in named.where("id IN (3, 7, 39999, 99999)").collect()} == {3: None, 7: 7, 39999: 7, 99999: 80007}
    path = trees.paths_up(chain, "id", "parent", spark.createDataFrame([(n - 1,)], "id long"))
    assert path.count() == n and path.where("distance = 99999 AND ancestor = 0").count() == 1
