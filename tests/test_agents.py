"""Branches, models, schedules and queues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sessionweave.operators import agents, trees


def one(spark, column):  # noqa: ANN001, ANN201
    return spark.range(1).select(column.alias("x")).first().x


def tree(spark):  # noqa: ANN001, ANN201
    n = spark.createDataFrame([(1, None, "v1"), (2, 1, None), (3, 2, None), (4, 2, "v4"), (5, 4, None)], "id long, parent long, v string")
    return n, trees.closure(n, "id", "parent")


def test_branches(spark):  # noqa: ANN001
    n, closed = tree(spark)
    assert {r.id: r.v for r in agents.along_branch(closed, n, "id", "v").collect()} == {1: "v1", 2: "v1", 3: "v1", 4: "v4", 5: "v4"}
    moves = spark.createDataFrame([(5, 3)], "a long, b long")
    assert sorted(r.id for r in agents.left_behind(closed, moves, "a", "b").collect()) == [4, 5]
    assert {r.id: r.foldable for r in agents.foldable(n, "id", "parent").collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert {r.id: r.start for r in agents.segment_starts(n, closed, "id", "parent").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    jobs = spark.createDataFrame([(5, "j1", 9), (4, "j2", 3), (4, "j1", 7)], "s long, job string, next long")
    assert {r.session: (r.jobs, r.next) for r in agents.heartbeats(jobs, closed, "s", "job", "next").collect()}[1] == (2, 3)
    assert agents.registrations(jobs, "job")["job"].count() == 2
    frames = spark.createDataFrame([(1, 0), (4, 2), (77, 3)], "id long, depth long")
    assert agents.deepest_frame(frames, n, "id", "depth").first().id == 4


def test_models(spark):  # noqa: ANN001
    c = spark.createDataFrame([("p", "big-20250101"), ("p", "big"), ("q", "big-20260101"), ("q", "small")], "provider string, id string")
    assert [r.id for r in agents.models(c).collect()][:2] == ["big", "big-20250101"]
    assert {r.id for r in agents.models(c, "sml").collect()} == {"small"}
    assert agents.matched_model(c, "BIG").first().id == "big"
    assert [(r.provider, r.id, r.place) for r in agents.scoped_models(c, ["q/*", "big"]).collect()] == [("q", "big-20260101", 0), ("q", "small", 0), ("p", "big", 1), ("p", "big-20250101", 1)]
    assert agents.model_pattern("a:b:high", {"a:b"}) == ("a:b", "high")
    assert agents.model_pattern("a", set()) == ("a", None)


def test_compaction_segments(spark):  # noqa: ANN001
    rows = spark.createDataFrame([("s", 0, False, None), ("s", 1, False, None), ("s", 2, True, 1), ("s", 3, False, None), ("s", 4, False, None), ("s", 5, False, None)], "s string, o long, c boolean, kept long")
    cuts = spark.createDataFrame([("s", 5, 4, True)], "s string, first_kept long, turn_start long, split boolean")
    out = agents.compaction_segments(rows, cuts, "s", "o", F.col("c"), "kept")
    assert {r.o: r.segment for r in out.collect()} == {1: "summarise", 3: "summarise", 4: "prefix", 5: "keep"}


def test_status(spark):  # noqa: ANN001
    r = one(spark, agents.status_reply(F.lit("‹recap›Fixing it.‹/recap› <status>DONE</status>"), F.lit(False)))
    assert (r.summary, r.status) == ("Fixing it", "done")
    assert one(spark, agents.status_reply(F.lit("<recap>x y</recap>"), F.lit(False))).status == "needs_input"
    assert one(spark, agents.status_reply(F.lit("nothing"), F.lit(True))) is None
    m = spark.createDataFrame([("s", i, "user", f"m  {i}") for i in range(5)], "s string, o long, role string, text string")
    assert agents.status_context(m, "s", "o", 2).first().context == "user: m 3\nuser: m 4"


def test_queues(spark):  # noqa: ANN001
    a = spark.createDataFrame([("s", "normal", 0), ("s", "urgent", 1), ("s", "normal", 2)], "s string, lane string, o long")
    assert [r.o for r in agents.two_lanes(a, "s", "lane", "o").orderBy("place").collect()] == [1, 0, 2]
    c = spark.createDataFrame([("a", "claimed"), ("b", "claimed"), ("c", "done")], "job string, status string")
    assert {r.job: r.status for r in agents.interrupted(c, c.where("job = 'a'").select("job"), "job").collect()} == {"a": "claimed", "b": "interrupted", "c": "done"}
    e = spark.createDataFrame([("p", 0, "create", "e", None, "x"), ("p", 1, "update", "e", "x", "y")], "p string, o long, op string, entity string, before string, after string")
    assert [(r.op, r.after) for r in agents.rollback(e, "p", "o").orderBy("o").collect()] == [("update", "x"), ("delete", None)]
    k = spark.createDataFrame([("x", 3), ("y", 1), ("x", 2), (" ", 0)], "code string, o long")
    assert [(r.code, r.n) for r in agents.by_code(k, "code", "o").collect()] == [("y", 1), ("x", 2)]


def test_cache(spark):  # noqa: ANN001
    p = spark.createDataFrame([("s", 0, "a" * 40), ("s", 1, "a" * 40 + "b" * 8)], "s string, o long, p string")
    assert [(r.cache_read, r.cache_write) for r in agents.cached_usage(p, "s", "o", "p").orderBy("o").collect()] == [(0, 10), (10, 2)]


def test_strings(spark):  # noqa: ANN001
    assert one(spark, agents.depth_of_path(F.lit("/x/sub-0123abcd/sub-89abcdef/s.jsonl"))) == 2
    assert one(spark, agents.depth_of_path(F.lit("/x/s.jsonl"))) == 0
    assert one(spark, agents.parent_folder(F.lit("/a/b/c.jsonl"))) == "/a"
    s = one(spark, agents.skill(F.lit('<skill name="n" x="y">\nbody\n</skill>')))
    assert (s.name, s.body) == ("n", "body")
    t = one(spark, agents.sockets(F.lit('LISTEN 0 128 127.0.0.1:80 0.0.0.0:* users:(("x",pid=42,fd=3))')))
    assert (t.address, t.pid) == ("127.0.0.1:80", 42)
    assert len(one(spark, agents.path_key(F.lit("/a")))) == 16 and len(one(spark, agents.body_hash(F.lit(1).alias("a")))) == 64
    assert one(spark, agents.search_text(F.lit("a"), F.lit(" "), F.lit(None), F.lit(3))) == "a 3"


def test_register(spark):  # noqa: ANN001
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    agents.register(spark, "twice", twice, "long")
    assert spark.sql("SELECT twice(21L) AS x").first().x == 42
