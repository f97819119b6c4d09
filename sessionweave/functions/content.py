"""Columns over messages and their content blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16(text: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up; null has none."""
    return F.ceil(F.coalesce(utf16(text), F.lit(0)) / 4).cast("long")


def joined_text(blocks: Column, separator: str = "\n", drop_empty: bool = False) -> Column:
    """Texts of text blocks, joined: a space in catalogs, a line break in reports."""
    keep = (lambda b: (b["type"] == "text") & b["text"].isNotNull() & (b["text"] != "")) if drop_empty else (lambda b: (b["type"] == "text") & b["text"].isNotNull())
    return F.array_join(F.transform(F.filter(blocks, keep), lambda b: b["text"]), separator)


def full_text(blocks: Column) -> Column:
    """Text, image data, and anything else as JSON, one per line."""
    return F.array_join(F.transform(blocks, lambda b: F.when((b["type"] == "text") & b["text"].isNotNull(), b["text"]).when((b["type"] == "image") & b["data"].isNotNull(), b["data"]).otherwise(F.to_json(b))), "\n")


def preview_text(blocks: Column) -> Column:
    """Text and thinking, images and tool calls as marks, empties dropped."""
    shown = F.transform(
        blocks,
        lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"]).when(b["type"] == "image", F.lit("[image]")).when(b["type"] == "toolCall", F.concat(F.lit("[tool_call:"), b["name"], F.lit("]"))),
    )
    return F.array_join(F.filter(shown, lambda s: s.isNotNull() & (s != "")), "\n")


def tool_calls(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"] == "toolCall")


def tool_names(blocks: Column) -> Column:
    return F.transform(tool_calls(blocks), lambda b: b["name"])


def has_text(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: (b["type"] == "text") & (F.trim(b["text"]) != ""))


def bash_command(arguments: Column) -> Column:
    return F.get_json_object(arguments, "$.command")


def read_mode(offset: Column, limit: Column) -> Column:
    return F.when(offset.isNotNull() | limit.isNotNull(), "partial").otherwise("full")


def argument_style(arguments: Column) -> Column:
    """Shape of an edit call's arguments."""
    has = lambda *names: F.greatest(*(F.get_json_object(arguments, f"$.{n}").isNotNull() for n in names))
    texts, strings = has("oldText", "newText"), has("old_string", "new_string")
    edits = F.coalesce(F.get_json_object(arguments, "$.edits").startswith("["), F.lit(False))
    return F.when(edits, "edits").when(texts & strings, "mixed").when(texts, "oldText/newText").when(strings, "old_string/new_string").otherwise("unknown")


def context_tokens(total: Column, *parts: Column) -> Column:
    """The total if positive, else the sum of the parts if positive, else null."""
    summed = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return F.when(total > 0, total).when(summed > 0, summed)


def total_tokens(total: Column, *parts: Column) -> Column:
    """The total, or the sum of the parts where it is zero or missing."""
    return F.coalesce(F.nullif(total, F.lit(0)), sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))


def message_tokens(role: Column, blocks: Column, command: Column, output: Column, summary: Column) -> Column:
    """Tokens of a message by its role; an image weighs 4800 characters in tool results and custom messages."""
    size = lambda c: F.coalesce(utf16(c), F.lit(0).cast("long"))
    total = lambda f: F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + f(b))
    text = lambda b: F.when(b["type"] == "text", size(b["text"]))
    user = total(lambda b: text(b).otherwise(0))
    assistant = total(lambda b: text(b).when(b["type"] == "thinking", size(b["thinking"])).when(b["type"] == "toolCall", size(b["name"]) + size(b["arguments"])).otherwise(0))
    result = total(lambda b: text(b).when(b["type"] == "image", 4800).otherwise(0))
    chars = (
        F.when(role == "user", user)
        .when(role == "assistant", assistant)
        .when(role.isin("toolResult", "custom"), result)
        .when(role == "bashExecution", size(command) + size(output))
        .when(role.isin("branchSummary", "compactionSummary"), size(summary))
        .otherwise(0)
    )
    return F.ceil(chars / 4).cast("long")


def fenced_output(output: Column) -> Column:
    """Output in a fence longer than its longest run of backticks, three at least."""
    runs = F.transform(F.regexp_extract_all(output, F.lit("(`+)"), 1), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, F.lit("\n"), output, F.lit("\n"), fence)


def head_and_tail(body: Column, most: int) -> Column:
    """The text, or its two ends around a note of how much is left out."""
    half = most // 2
    left_out = F.length(body) - 2 * half
    return F.when(F.length(body) <= most, body).otherwise(F.concat(F.substring(body, 1, half), F.lit("\n... "), left_out.cast("string"), F.lit(" characters omitted ...\n"), F.right(body, F.lit(half))))


def last_tag(text: Column, tag: str) -> Column:
    """Content of the last <tag>...</tag>, null where there is none."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1)
    return F.trim(F.try_element_at(found, F.lit(-1)))


def without_images(blocks: Column, note: str) -> Column:
    """Images replaced by a text note; notes that follow one another become one."""
    swapped = F.transform(blocks, lambda b: F.when(b["type"] == "image", b.withField("type", F.lit("text")).withField("text", F.lit(note)).withField("data", F.lit(None).cast("string"))).otherwise(b))
    return F.filter(swapped, lambda b, i: ~((b["text"] == note) & (i > 0) & F.coalesce(F.try_element_at(swapped, i)["text"] == note, F.lit(False))))
