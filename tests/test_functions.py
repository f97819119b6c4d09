"""Functions against hand-made cases."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sessionweave.functions import clock, content, numbers, replaced, text
from sessionweave.functions.fuzzy import fuzzy_score, parse_query, search_score
from sessionweave.sources.session_log import blocks


def one(spark, column):  # noqa: ANN001, ANN201
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("command", "key"),
    [("git push && ls", "git push"), ("sudo npm -v", "npm"), ("A=1 B=2 make all", "make all"), ("", "unknown"), ("cat x | wc", "cat x")],
)
def test_command_key(spark, command, key):  # noqa: ANN001
    assert one(spark, text.command_key(F.lit(command))) == key


@pytest.mark.parametrize(("path", "ext"), [("/a/b.TS", ".ts"), ("/a/.env", ".env"), ("Makefile", "[no_ext]"), ("", "[unknown]"), (None, "[unknown]"), ("a/b.tar.gz", ".gz")])
def test_extension(spark, path, ext):  # noqa: ANN001
    assert one(spark, text.path_extension(F.lit(path).cast("string"))) == ext


def test_utf16_and_tokens(spark):  # noqa: ANN001
    assert one(spark, content.utf16(F.lit("a🙈"))) == 3
    assert [one(spark, content.estimate_tokens(F.lit(s).cast("string"))) for s in ("", "abcd", "abcde", None)] == [0, 1, 2, 0]


def test_histogram_edges(spark):  # noqa: ANN001
    assert [one(spark, numbers.token_bin(F.lit(n))) for n in (0, 50, 51, 32000, 32001)] == [0, 0, 1, 9, 10]
    assert numbers.token_labels()[-1] == "32000+"


def test_quantile(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1,), (2,), (4,), (10,)], "v long")
    got = df.agg(*(F.round(numbers.quantile(F.col("v"), q), 6) for q in (0.5, 0.9, 0.95))).first()
    assert tuple(got) == (3.0, 8.2, 9.1)


def test_blocks(spark):  # noqa: ANN001
    raw = '[{"type":"text","text":"a"},{"type":"toolCall","id":"1","name":"bash","arguments":{"command":"ls"}},{"type":"text","text":"b"}]'
    b = blocks(F.lit(raw))
    assert one(spark, content.joined_text(b)) == "a\nb"
    assert one(spark, content.joined_text(b, " ")) == "a b"
    assert one(spark, content.tool_names(b)) == ["bash"]
    assert one(spark, content.bash_command(content.tool_calls(b)[0]["arguments"])) == "ls"
    assert one(spark, content.preview_text(b)) == "a\n[tool_call:bash]\nb"
    assert one(spark, content.joined_text(blocks(F.lit("plain")))) == "plain"
    assert one(spark, F.size(blocks(F.lit(None).cast("string")))) == 0


def test_images_merge(spark):  # noqa: ANN001
    raw = '[{"type":"image","data":"x"},{"type":"image","data":"y"},{"type":"text","text":"t"},{"type":"image","data":"z"}]'
    assert one(spark, content.joined_text(content.without_images(blocks(F.lit(raw)), "(image)"))) == "(image)\nt\n(image)"


def test_fence_and_tags(spark):  # noqa: ANN001
    assert one(spark, content.fenced_output(F.lit("a ```` b"))).startswith("`````\n")
    assert one(spark, content.last_tag(F.lit("<status>a</status> <status> b </status>"), "status")) == "b"
    assert one(spark, content.head_and_tail(F.lit("abcdefghij"), 4)) == "ab\n... 6 characters omitted ...\nij"


@pytest.mark.parametrize(
    ("style", "arguments"),
    [("edits", '{"edits":[]}'), ("mixed", '{"oldText":"a","new_string":"b"}'), ("oldText/newText", '{"oldText":"a"}'), ("old_string/new_string", '{"new_string":"a"}'), ("unknown", "{}")],
)
def test_argument_style(spark, style, arguments):  # noqa: ANN001
    assert one(spark, content.argument_style(F.lit(arguments))) == style


def test_classes(spark):  # noqa: ANN001
    cases = {"File not found: x": "file_not_found", "Found 3 occurrences of": "multiple_occurrences", "edits must not overlap": "overlapping_edits", "?": "other"}
    assert {k: one(spark, text.edit_error(F.lit(k), F.lit(True), F.lit(True))) for k in cases} == cases
    assert one(spark, text.edit_error(F.lit("x"), F.lit(True), F.lit(False))) == "missing_result"
    assert one(spark, text.edit_error(F.lit("x"), F.lit(False), F.lit(True))) is None
    assert one(spark, text.model_family(F.lit("Claude-X"))) == "claude"
    assert one(spark, text.provider_family(F.lit(""))) == "unknown"


def test_redaction(spark):  # noqa: ANN001
    assert one(spark, text.redacted(F.lit('api_key="abc" x'))) == "api_key=<redacted> x"
    assert one(spark, text.redacted(F.lit("Authorization: Bearer abc"))) == "Authorization: Bearer <redacted>"
    assert one(spark, text.redacted(F.lit("A" * 90))) == "<blob>"


def test_lines(spark):  # noqa: ANN001
    assert one(spark, text.line_ending(F.lit("a\r\nb"))) == "\r\n"
    assert one(spark, text.to_lf(F.lit("a\r\nb\rc"))) == "a\nb\nc"
    assert one(spark, text.from_lf(F.lit("a\nb"), F.lit("\r\n"))) == "a\r\nb"
    assert one(spark, text.front_matter(F.lit("---\na: 1\n---\nbody")))["header"] == "a: 1"
    assert one(spark, text.front_matter(F.lit("body")))["header"] is None
    assert one(spark, text.without_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red"


def test_replacement(spark):  # noqa: ANN001
    r = spark.createDataFrame([("abcXdef", "abcYYdef"), ("same", "same"), ("é", "")], "a string, b string").select(replaced.replacement("a", "b").alias("r")).select("r.*").collect()
    assert (r[0].prefix_bytes, r[0].suffix_bytes, r[0].core_bytes, r[0].inflation) == (3, 3, 3, 5.0)
    assert r[1].inflation is None or r[1].inflation != r[1].inflation
    assert (r[2].old_bytes, r[2].core_bytes) == (2, 2)


def test_cut():
    assert replaced.cut("a\nb\nc", 2, 100, False)[:6] == ("a\nb", True, "lines", 3, 5, 2)
    assert replaced.cut("a\nb\nc", 2, 100, True)[0] == "b\nc"
    assert replaced.cut("aaaa\nb", 9, 3, False) == ("", True, "bytes", 2, 6, 0, 0, False, True)
    content_, _, by, *_, partial, _ = replaced.cut("x\néé", 9, 3, True)
    assert (content_, by, partial) == ("é", "bytes", True)
    assert replaced.cut("a", 9, 9, True)[1] is False


def test_edits():
    assert replaced.edited("a b c", [("c", "z"), ("a", "xx")]) == "xx b z"
    for edits, said in (([("q", "")], "could not find"), ([(" ", "")], "multiple"), ([("a b", ""), ("b c", "")], "overlap")):
        with pytest.raises(ValueError, match=said):
            replaced.edited("a b c", edits)
    assert replaced.folded("“x” – y  \nz") == '"x" - y\nz'
    assert "+b" in replaced.line_diff("a", "b")


def test_arguments():
    assert replaced.arguments("a 'b c' \"d\"") == ["a", "b c", "d"]
    assert replaced.substituted("$1 ${@:2:1} $@ $9", ["x", "y"]) == "x y x y "


def test_json():
    assert replaced.streamed_json('{"a": 1, "b": [1, 2') == {"a": 1, "b": [1, 2]}
    assert replaced.streamed_json('{"a": "x') == {"a": "x"}
    assert replaced.streamed_json("") == {}
    assert replaced.repaired_json('{"a": "x\ny\\q"}') == '{"a": "x\\ny\\\\q"}'
    assert replaced.json_object('text ```json\n{"a": 1}\n```') == {"a": 1}
    assert replaced.json_object("{broken") is None
    assert replaced.open_json('{"a": [')[0] and not replaced.open_json('{"a": []}')[0]
    assert [replaced.coerced(v, k) for v, k in ((None, "number"), ("4", "integer"), ("x", "number"), (None, "string"), ("true", "boolean"), ("TRUE", "boolean"), (None, "boolean"), (True, "string"), ("1e999", "number"))] == [0, 4, "x", "", True, "TRUE", False, "true", "1e999"]
    assert replaced.short_hash("abc") != replaced.short_hash("abd")


def test_conformed():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "number"}}, "u": {"anyOf": [{"type": "boolean"}, {"type": "integer"}]}}, "additionalProperties": {"type": "string"}}
    assert replaced.conformed({"n": "3", "l": ["1", 2.5, "x"], "u": "7", "more": 4}, schema) == {"n": 3, "l": [1, 2.5, "x"], "u": 7, "more": "4"}
    assert replaced.conformed("5", {"type": ["string", "integer"]}) == "5"
    assert replaced.conformed(None, {"type": "string"}) == ""


def test_cron():
    assert clock.next_cron("0 0 13 * 5", datetime(2024, 1, 1)) == datetime(2024, 9, 13)
    assert clock.next_cron("*/15 * * * *", datetime(2024, 1, 1, 0, 7)) == datetime(2024, 1, 1, 0, 15)
    assert clock.next_cron("0 0 * * 7", datetime(2024, 1, 1)) == datetime(2024, 1, 7)
    assert clock.next_cron("@monthly", datetime(2024, 1, 31)) == datetime(2024, 2, 1)
    assert clock.parse_schedule("in 10m", datetime(2024, 1, 1))["next"] == datetime(2024, 1, 1, 0, 10)
    assert clock.parse_schedule("every 5 m", datetime(2024, 1, 1))["every_ms"] == 300_000
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            clock.cron_fields(bad)


def test_fuzzy():
    assert fuzzy_score("", "x") == 0
    assert fuzzy_score("abc", "ab") is None
    assert fuzzy_score("a", "a") == pytest.approx(-5 - 10 - 100)
    assert fuzzy_score("ac", "abc") == pytest.approx(-5 - 10 + 2 + 0.2)
    assert fuzzy_score("gpt5", "5gpt") is not None
    assert fuzzy_score("abc", "abc") < fuzzy_score("abc", "a_b_c")


def test_search(spark):  # noqa: ANN001
    assert parse_query('a "b c"').tokens == (("fuzzy", "a"), ("phrase", "b c"))
    assert parse_query('a "b').tokens == (("fuzzy", "a"), ("fuzzy", '"b'))
    assert parse_query("re:[").error
    assert one(spark, search_score(F.lit("Hello  World"), parse_query('"hello world"'))) == 0.0
    assert one(spark, search_score(F.lit("Hello"), parse_query('"nope"'))) is None
    assert one(spark, search_score(F.lit("abc Def"), parse_query("re:def"))) == pytest.approx(0.4)
