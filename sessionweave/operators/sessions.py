"""Messages, summaries and lists of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionweave.functions import content as C
from sessionweave.functions import text as T
from sessionweave.sources import session_log

#: custom messages that keep books and are not sent to a model
BOOKKEEPING = ("session_slash_command", "session_slash_command_result", "compaction_outcome", "refinement_outcome")


def model_messages(entries: DataFrame, before: str = "Summary of earlier work:\n", after: str = "") -> DataFrame:
    """(file, line, role, blocks) as a model gets them: shell runs, custom messages and summaries become the user's.

    Custom messages that keep books are left out.
    """
    m = F.col("message")
    role = m["role"]
    text = lambda s: session_log.blocks(s)
    shell = F.concat(F.lit("Ran `"), F.coalesce(m["command"], F.lit("")), F.lit("`\n"), C.fenced_output(F.coalesce(m["output"], F.lit(""))))
    summary = F.concat(F.lit(before), F.coalesce(m["summary"], F.col("summary"), F.lit("")), F.lit(after))
    kept = F.when(role == "bashExecution", text(shell)).when(role.isin("branchSummary", "compactionSummary") | F.col("type").isin("branch_summary", "compaction"), text(summary)).otherwise(F.col("blocks"))
    rows = entries.where(F.col("type").isin("message", "branch_summary", "compaction", "custom_message") & ~F.coalesce((role == "custom") & m["customType"].isin(*BOOKKEEPING), F.lit(False)))
    return rows.select("file", "line", F.when(role.isin("assistant", "toolResult"), role).otherwise("user").alias("role"), kept.alias("blocks"))


def transcript_parts(role: Column, blocks: Column, most: int = 2000) -> Column:
    """One message as labelled paragraphs; tool results are cut to `most` characters."""
    texts, joined = C.joined_text(blocks, ""), C.joined_text(blocks, "\n")
    thinking = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "thinking"), lambda b: b["thinking"]), "\n")
    calls = F.array_join(F.transform(C.tool_calls(blocks), lambda b: F.concat(b["name"], F.lit("("), F.coalesce(b["arguments"], F.lit("{}")), F.lit(")"))), "; ")
    said = lambda label, t: F.when(t != "", F.concat(F.lit(f"[{label}]: "), t))
    parts = (
        F.when(role == "user", F.array(said("User", texts)))
        .when(role == "assistant", F.array(said("Assistant thinking", thinking), said("Assistant", joined), said("Assistant tool calls", calls)))
        .when(role == "toolResult", F.array(said("Tool result", T.cut_summary(texts, most))))
    )
    return F.array_compact(parts)


def transcripts(messages: DataFrame, most: int = 2000) -> DataFrame:
    """(file, transcript) of messages (file, line, role, blocks) in order."""
    parts = messages.select("file", "line", F.posexplode(transcript_parts(F.col("role"), F.col("blocks"), most)).alias("k", "part"))
    return parts.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "k", "part"))), lambda s: s["part"]), "\n\n").alias("transcript"))


def sections(entries: DataFrame) -> DataFrame:
    """(file, line, section) `[ROLE]` and text of user and assistant messages that say something."""
    role = F.col("message.role")
    text = C.joined_text(F.col("blocks"), "\n", True)
    return entries.where(role.isin("user", "assistant") & (F.trim(text) != "")).select("file", "line", F.concat(F.lit("["), F.upper(role), F.lit("]\n"), text).alias("section"))


def previews(entries: DataFrame, most: int = 200) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return entries.where("type = 'message'").select("file", "line", at.alias("index"), F.col("message.role").alias("role"), F.substring(C.preview_text(F.col("blocks")), 1, most).alias("text"), C.tool_names(F.col("blocks")).alias("tool_calls"))


def tool_uses(entries: DataFrame, name: str | None = None) -> DataFrame:
    """(file, line, call, name, arguments, provider_model): one row per tool call of an assistant."""
    calls = entries.where("type = 'message' and message.role = 'assistant'").select(
        "file", "line", F.concat_ws("/", "message.provider", "message.model").alias("provider_model"), F.explode(C.tool_calls(F.col("blocks"))).alias("b")
    )
    out = calls.select("file", "line", F.col("b.id").alias("call"), F.col("b.name").alias("name"), F.col("b.arguments").alias("arguments"), "provider_model")
    return out.where(F.col("name") == name) if name else out


def tool_results(entries: DataFrame) -> DataFrame:
    return entries.where("type = 'message' and message.role = 'toolResult'").select("file", "line", F.col("message.toolCallId").alias("call"), F.col("message.toolName").alias("name"), F.coalesce("message.isError", F.lit(False)).alias("is_error"), C.full_text(F.col("blocks")).alias("text"))


def file_lists(operations: DataFrame, scope: str, path: str, kind: str) -> DataFrame:
    """(scope, read_files, modified_files): read but not modified, and edited or written; sorted."""
    g = operations.groupBy(scope).agg(F.collect_set(F.when(F.col(kind) == "read", F.col(path))).alias("r"), F.collect_set(F.when(F.col(kind).isin("edit", "write"), F.col(path))).alias("m"))
    return g.select(scope, F.array_sort(F.array_except("r", "m")).alias("read_files"), F.array_sort("m").alias("modified_files"))


def custom_entries(entries: DataFrame, kind: str) -> DataFrame:
    """(file, line, data) of custom entries of one kind."""
    return entries.where((F.col("type") == "custom") & (F.col("customType") == kind)).select("file", "line", "data")


def usage_summary(usage: Column) -> Column:
    """Input with cache, output and cost; null where all are zero."""
    n = lambda c: F.coalesce(c, F.lit(0))
    sent = n(usage["input"]) + n(usage["cacheRead"]) + n(usage["cacheWrite"])
    cost = F.coalesce(usage["cost"]["total"], F.lit(0.0))
    return F.when((sent > 0) | (n(usage["output"]) > 0) | (cost > 0), F.struct(sent.alias("input"), n(usage["output"]).alias("output"), cost.alias("cost")))


def listing(spark: SparkSession, roots: list[str], cwd: str | None = None, glob: str = "*.jsonl") -> DataFrame:
    """(file, session_id, cwd, messages, modified, name, state) of the valid logs under some folders, newest first."""
    raw = None
    for root in roots:
        part = session_log.lines(spark, root, glob)
        raw = part if raw is None else raw.unionByName(part)
    log = session_log.entries(raw.distinct())
    spoken = (F.col("type") == "message") & F.col("message.role").isin("user", "assistant")
    at = F.coalesce(F.timestamp_millis("message.timestamp"), F.try_to_timestamp("timestamp"))
    state = F.when(F.col("state").isin("sleep", "hidden", "archived"), "archived").when(F.col("state") == "live", "live")
    out = log.groupBy("file", "session_id").agg(
        F.min_by("cwd", "line").alias("cwd"),
        F.count_if(spoken).alias("messages"),
        F.coalesce(F.max(F.when(spoken, at)), F.min(F.when(F.col("line") == 0, F.try_to_timestamp("timestamp")))).alias("modified"),
        F.nullif(F.trim(F.max_by(F.coalesce("name", F.lit("")), F.when(F.col("type") == "session_info", F.col("line")))), F.lit("")).alias("name"),
        F.max_by(state, F.when(state.isNotNull(), F.col("line"))).alias("state"),
    )
    out = out.where(F.col("cwd") == cwd) if cwd is not None else out
    return out.orderBy(F.col("modified").desc_nulls_last(), "file")


def oversized(lines: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(file, line, role, preview) of message lines over `most` characters, read without parsing them."""
    big = lines.where((F.length("value") > most) & F.contains("value", F.lit('"type":"message"')))
    role = F.regexp_extract("value", r'"role"\s*:\s*"(\w+)"', 1)
    preview = F.regexp_replace(F.regexp_extract("value", r'"text"\s*:\s*"((?:[^"\\]|\\.){0,200})', 1), r"\\(.)", "$1")
    return big.select("file", "line", role.alias("role"), preview.alias("preview"))


def labels(entries: DataFrame) -> DataFrame:
    """(file, target, label): the last label of each target; an empty one takes it away."""
    last = entries.where("type = 'label'").groupBy("file", F.col("targetId").alias("target")).agg(F.max_by(F.coalesce("label", F.lit("")), "line").alias("label"))
    return last.where("label != ''")


def branch_copy(entries: DataFrame, path: DataFrame, dropped: str) -> DataFrame:
    """Rows of a path (file, id, step) without rows of type `dropped`; a child of such a row hangs from the row before it."""
    kept = entries.join(path, ["file", "id"]).where(F.col("type") != dropped)
    return kept.withColumn("parentId", F.lag("id").over(Window.partitionBy("file").orderBy("step")))


def upload_totals(uploads: DataFrame) -> DataFrame:
    return uploads.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


#: fixed values: programs and patterns that tell most
TELLING = ("rm", "mv", "cp", "git", "npm", "pnpm", "pytest", "vitest")
CHANGING = r"\b(?:rm|mv|cp|git\s+(?:add|commit)|npm\s+install|sed\s+-i|perl\s+-pi|tee|cat\s*>|apply_patch)\b"


def shortened_command(part: Column) -> Column:
    """A command by what it does: test and script runners and file writers are named, other commands stay as they are."""
    words = F.transform(F.regexp_extract_all(part, F.lit(r"""("[^"]*"|'[^']*'|\S+)"""), 1), lambda w: F.regexp_replace(w, r"""^"([^"]*)"$|^'([^']*)'$""", "$1$2"))
    at = lambda i: F.coalesce(F.try_element_at(words, F.lit(i) if isinstance(i, int) else i), F.lit(""))
    place = lambda w: F.array_position(words, w).cast("int")
    rest = lambda i: F.array_join(F.slice(words, i, F.greatest(F.size(words) - i + 1, F.lit(0))), " ")
    tail = lambda path: F.regexp_replace(path, r"^\./", "")
    said = lambda *c: F.trim(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c)))
    run, prefix, folder = place("run"), place("--prefix"), F.greatest(place("-C"), place("--dir"))
    npm = said("npm ", at(run + 1), " ", rest(run + 2))
    pnpm = F.array_join(F.filter(words, lambda _, i: (i + 1 != folder) & (i != folder)), " ")
    vitest = F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(w.rlike(r"(?:^|/)vitest/dist/cli\.js$"), i + 1))), F.lit(0))
    joined = F.array_join(words, " ")
    tests = F.when((at(1) == "uv") & (at(2) == "run"), place("pytest")).when(at(1).isin("python", "python3") & (at(2) == "-m") & (at(3) == "pytest"), 3).otherwise(0)
    return (
        F.when((at(1) == "npx") & (at(2) == "tsx") & (vitest > 2), said("vitest ", rest(vitest + 1)))
        .when((at(1) == "npm") & (run > 0) & (F.size(words) > run), F.when((prefix > 0) & (F.size(words) > prefix), said(npm, " (", tail(at(prefix + 1)), ")")).otherwise(npm))
        .when((at(1) == "pnpm") & (folder > 0) & (F.size(words) > folder), said(pnpm, " (", tail(at(folder + 1)), ")"))
        .when(tests > 0, said("pytest ", rest(tests + 1)))
        .when(F.contains(joined, F.lit("node_modules/.bin/")), F.regexp_replace(joined, r"\S*node_modules/\.bin/", ""))
        .when((at(1) == "cat") & (at(2) == ">") & (at(3) != ""), said("write ", tail(at(3))))
        .when(at(1) == "tee", said(F.when(place("-a") > 0, "append ").otherwise("write "), tail(at(F.size(words)))))
        .when(at(1) == "apply_patch", "apply patch")
        .otherwise(part)
    )


def command_preview(commands: DataFrame, id_: str, command: str) -> DataFrame:
    """(id, part): the most telling part of a shell command in short, the first of equals; here-documents are not looked into."""
    parts = commands.select(id_, F.posexplode(T.command_parts(F.col(command))).alias("k", "line")).withColumn("part", shortened_command(F.col("line")))
    first = F.regexp_replace(F.regexp_extract("line", r"""^\s*("[^"]*"|'[^']*'|\S+)""", 1), "[\"']", "")
    score = 30 + F.when(F.col("part") != F.col("line"), 40).otherwise(0) + F.when(first.isin(*TELLING), 20).otherwise(0) + F.when(F.col("line").rlike(CHANGING), 40).otherwise(0) + F.col("k")
    return parts.groupBy(id_).agg(T.label(T.redacted(F.max_by("part", F.struct(score, -F.col("k")))), 64).alias("part"))


def recap(raw: Column, most_words: int = 12) -> Column:
    """A one-line recap without quotes and full stop; null if it is empty, a tag or too long."""
    value = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), "^[\"“']+|[\"”']+$", ""), r"[.\s]+$", ""))
    return F.when((value != "") & ~value.startswith("<") & (F.size(F.split(value, r"\s+")) <= most_words), value)


def listeners(lines: DataFrame, order: str) -> DataFrame:
    """(pid, name) of lsof rows: a p line names the process of the n lines after it."""
    w = Window.orderBy(order) if "file" not in lines.columns else Window.partitionBy("file").orderBy(order)
    pid = F.last(F.when(F.col("value").startswith("p"), F.substring("value", 2, 20).try_cast("long")), ignorenulls=True).over(w)
    return lines.withColumn("pid", pid).where(F.col("value").startswith("n")).select("pid", F.expr("substring(value, 2)").alias("name")).distinct()


def live_lines(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """A stream of a folder's lines; longer ones are dropped."""
    return spark.readStream.option("lineSep", "\n").text(path).where(F.octet_length("value") <= most)
