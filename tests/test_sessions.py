"""Session logs end to end, from files to lists, transcripts and reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionweave.functions import content
from sessionweave.operators import matching, predicates, sessions, trees
from sessionweave.sources import session_log


def message(id_, parent, role, text, **more):  # noqa: ANN001, ANN003, ANN201
    return {"type": "message", "id": id_, "parentId": parent, "timestamp": "2024-01-01T00:00:00.000Z", "message": {"role": role, "content": text, **more}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):  # noqa: ANN001, ANN201
    root = tmp_path_factory.mktemp("logs")
    call = [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "toolCall", "id": "c1", "name": "bash", "arguments": {"command": "git push"}}]
    logs = {
        "a": [
            {"type": "session", "id": "a", "version": 3, "cwd": "/x", "timestamp": "2024-01-01T00:00:00.000Z"},
            message("1", None, "user", "do it", timestamp=1704153600000),
            message("2", "1", "assistant", call, provider="p", model="m", usage={"input": 5, "output": 2, "cacheRead": 1, "cacheWrite": 0, "totalTokens": 8, "cost": {"total": 0.5}}),
            message("3", "2", "toolResult", [{"type": "text", "text": "z" * 50}], toolCallId="c1", toolName="bash", isError=True),
            {"type": "label", "id": "4", "parentId": "3", "targetId": "1", "label": "start"},
            {"type": "label", "id": "5", "parentId": "4", "targetId": "2", "label": "x"},
            {"type": "label", "id": "6", "parentId": "5", "targetId": "2"},
            message("7", "6", "custom", "note", customType="compaction_outcome"),
            message("8", "7", "bashExecution", None, command="ls", output="a``b"),
            {"type": "session_info", "id": "9", "parentId": "8", "name": "first"},
            {"type": "session_state", "id": "10", "parentId": "9", "state": "sleep"},
            {"type": "session_state", "id": "11", "parentId": "10", "state": "odd"},
            {"type": "custom", "id": "12", "parentId": "11", "customType": "refinement", "data": '{"v":1}'},
        ],
        "b": [{"type": "session", "id": "b", "version": 3, "cwd": "/y", "timestamp": "2024-01-05T00:00:00.000Z"}],
        "c": [{"type": "message", "id": "no header"}],
    }
    for name, rows in logs.items():
        (root / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    return root


@pytest.fixture(scope="module")
def log(spark, folder):  # noqa: ANN001, ANN201
    return session_log.entries(session_log.lines(spark, str(folder))).cache()


def test_listing(spark, folder):  # noqa: ANN001
    rows = sessions.listing(spark, [str(folder), str(folder)]).collect()
    assert [(r.session_id, r.messages, r.name, r.state) for r in rows] == [("b", 0, None, None), ("a", 2, "first", "archived")]
    assert [r.session_id for r in sessions.listing(spark, [str(folder)], "/x").collect()] == ["a"]


def test_tools(log):  # noqa: ANN001
    use, result = sessions.tool_uses(log).first(), sessions.tool_results(log).first()
    assert (use.call, use.name, use.provider_model) == ("c1", "bash", "p/m") and json.loads(use.arguments) == {"command": "git push"}
    assert (result.call, result.is_error, len(result.text)) == ("c1", True, 50)
    assert sessions.tool_uses(log, "edit").count() == 0


def test_model_messages_and_transcript(log):  # noqa: ANN001
    m = sessions.model_messages(log)
    assert [r.role for r in m.orderBy("line").collect()] == ["user", "assistant", "toolResult", "user"]
    text = sessions.transcripts(m, 10).first().transcript
    assert text.startswith("[User]: do it\n\n[Assistant thinking]: hm\n\n[Assistant]: ok\n\n[Assistant tool calls]: bash(")
    assert "[Tool result]: zzzzzzzzzz\n\n[... 40 more characters truncated]" in text and "Ran `ls`" in text


def test_views(log):  # noqa: ANN001
    assert [r.section for r in sessions.sections(log).orderBy("line").collect()] == ["[USER]\ndo it", "[ASSISTANT]\nok"]
    p = sessions.previews(log).orderBy("line").collect()
    assert p[1].text == "hm\nok\n[tool_call:bash]" and p[1].tool_calls == ["bash"] and p[1]["index"] == 1
    assert [(r.target, r.label) for r in sessions.labels(log).collect()] == [("1", "start")]
    assert sessions.custom_entries(log, "refinement").first().data == '{"v":1}'
    u = log.where("message.usage is not null").select(sessions.usage_summary(F.col("message.usage")).alias("u")).first().u
    assert (u.input, u.output, u.cost) == (6, 2, 0.5)


def test_tokens(log):  # noqa: ANN001
    m = F.col("message")
    rows = log.where("type = 'message'").select(content.message_tokens(m["role"], F.col("blocks"), m["command"], m["output"], m["summary"]).alias("t")).collect()
    arguments = '{"command":"git push"}'
    assert [r.t for r in rows] == [2, -(-(2 + 2 + 4 + len(arguments)) // 4), 13, 1, 2]


def test_branch(log):  # noqa: ANN001
    path = trees.walked(log.where("id is not null and type != 'session'"), "file", "line", "id", "parentId")
    copy = sessions.branch_copy(log, path, "label").orderBy("line").collect()
    assert [(r.id, r.parentId) for r in copy][:4] == [("1", None), ("2", "1"), ("3", "2"), ("7", "3")]


def test_oversized(spark):  # noqa: ANN001
    body = '{"type":"message","message":{"role":"user","content":[{"type":"text","text":"say \\"hi\\" ' + "x" * 300 + '"}]}}'
    df = spark.createDataFrame([("f", 0, body, True), ("f", 1, "{}", True)], "file string, line long, value string, terminated boolean")
    r = sessions.oversized(df, 100).collect()
    assert len(r) == 1 and r[0].role == "user" and r[0].preview.startswith('say "hi" x')


def test_shown(spark):  # noqa: ANN001
    rows = [("1", "message", "user", "hello World", None, None, False), ("2", "message", "assistant", "", "stop", None, False), ("3", "message", "assistant", "", "error", None, False), ("4", "label", None, "", None, "x", False), ("5", "message", "toolResult", "out", None, None, True)]
    df = spark.createDataFrame(rows, "id string, type string, role string, text string, stop_reason string, label string, is_tool boolean")
    ids = lambda *a, **k: [r.id for r in predicates.shown(df, *a, **k).orderBy("id").collect()]
    assert ids("default") == ["1", "3", "5"] and ids("no-tools") == ["1", "3"] and ids("user-only") == ["1"]
    assert ids("labeled-only") == ["4"] and ids("all") == ["1", "3", "4", "5"] and ids("all", leaf="2") == ["1", "2", "3", "4", "5"]
    assert ids("all", "world HELLO") == ["1"]


def test_small_predicates(spark):  # noqa: ANN001
    w = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "w string, ok boolean")
    assert [r.w for r in predicates.evictable(w, "w", F.col("ok")).collect()] == ["b"]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(predicates.session_state(F.lit("hidden"))) == "archived" and one(predicates.session_state(F.lit("?"))) is None
    assert one(sessions.recap(F.lit('"Fixing the build."'))) == "Fixing the build" and one(sessions.recap(F.lit("<x>"))) is None
    assert one(predicates.idle_for(F.timestamp_millis(F.lit(0)), F.timestamp_millis(F.lit(1000)), 1000))
    assert one(predicates.due(F.lit("active"), F.timestamp_millis(F.lit(5)), F.timestamp_millis(F.lit(5))))


def test_listeners(spark):  # noqa: ANN001
    rows = [("f", 0, "p12"), ("f", 1, "n*:80"), ("f", 2, "n*:81"), ("f", 3, "p13"), ("f", 4, "n*:82"), ("f", 5, "n*:82")]
    out = sessions.listeners(spark.createDataFrame(rows, "file string, line long, value string"), "line")
    assert sorted((r.pid, r.name) for r in out.collect()) == [(12, "*:80"), (12, "*:81"), (13, "*:82")]


def test_aliases_and_family(spark):  # noqa: ANN001
    a = spark.createDataFrame([(1, "x", "f1"), (2, None, "f2")], "id long, name string, file string").withColumn("names", matching.identity_aliases(agent=F.col("name"), file=F.col("file")))
    b = spark.createDataFrame([(10, "y", "f1"), (11, "x", "f9"), (12, "q", "f2")], "sid long, name string, file string").withColumn("names", matching.identity_aliases(agent=F.col("name"), file=F.col("file")))
    assert sorted(tuple(r) for r in matching.by_alias(a, "id", "names", b, "sid", "names").collect()) == [(1, 11), (2, 12)]


def test_lines_of_split_files(spark, tmp_path):  # noqa: ANN001
    """Lines are numbered over the splits of a file, and only the last can be torn."""
    want = {}
    for name, n, torn in (("a.jsonl", 5000, True), ("b.jsonl", 1, False), ("c.jsonl", 3000, False)):
        rows = [f"{name} {i} " + "é" * (i % 50) for i in range(n)]
        (tmp_path / name).write_bytes("\r\n".join(rows).encode() + (b"" if torn else b"\n"))
        want |= {(name, i): (r, not (torn and i == n - 1)) for i, r in enumerate(rows)}
    (tmp_path / "d.jsonl").write_bytes(b"")
    (tmp_path / "e.jsonl").write_bytes(b"x\xff\n\n")
    want |= {("e.jsonl", 0): ("x\ufffd", True), ("e.jsonl", 1): ("", True)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = session_log.lines(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() >= 1
        assert {(r.file.rsplit("/", 1)[1], r.line): (r.value, r.terminated) for r in raw.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cuts_in_utf16(spark):  # noqa: ANN001
    from sessionweave.functions import text

    said = "ab😀cd"
    row = spark.range(1).select(*(text.units(F.lit(said), k).alias(f"u{k}") for k in range(7)), text.cut_summary(F.lit(said), 3).alias("cut"), text.label(F.lit(said), 5).alias("label"))
    r = row.first()
    assert [r[f"u{k}"] for k in range(7)] == ["", "a", "ab", "ab", "ab😀", "ab😀c", "ab😀cd"]
    assert r.cut == "ab\n\n[... 3 more characters truncated]" and r.label == "ab😀…"
