"""Line-based logs as DataFrames. Line order is data, so every row carries (file, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionweave.functions import content as C
from sessionweave.schema import BLOCK, ENTRY

#: bounds under which a ledger is read at all
LEDGER_BYTES, LEDGER_RECORDS = 32 << 20, 100_000


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, line, value, terminated) of every file below path; lines end at LF only.

    Files are read in splits, so no file is one row or one task's memory. Rows of a split come in order,
    and a file's lines are numbered by a sort of its splits, in the exchange that per-file checks need anyway.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    meta = F.col("_metadata")
    rows = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("_block"), meta["file_size"].alias("_size"), F.monotonically_increasing_id().alias("_at"), "value")
    file = Window.partitionBy("file")
    ordered = file.orderBy("_block", "_at")
    numbered = rows.withColumn("line", F.row_number().over(ordered).cast("long") - 1).withColumns({"_n": F.count("*").over(file), "_bytes": F.sum(F.octet_length("value") + 1).over(file)})
    whole = (F.col("line") < F.col("_n") - 1) | (F.col("_bytes") <= F.col("_size"))
    return numbered.select("file", "line", F.regexp_replace(F.make_valid_utf8("value"), "\r+$", "").alias("value"), whole.alias("terminated"))


def entries(raw: DataFrame) -> DataFrame:
    """Parsed entries of files whose first readable line is a session header with an id.

    Blank and malformed lines are skipped; `bad_lines` counts them per file on every row. The
    header's id is `session_id`. Content is an array of blocks, a bare string one text block.
    """
    parsed = raw.where(F.trim("value") != "").withColumn("e", F.from_json("value", ENTRY, {"mode": "PERMISSIVE"}))
    per_file = Window.partitionBy("file")
    parsed = parsed.withColumn("ok", F.col("e.type").isNotNull()).withColumn("bad_lines", F.count_if(~F.col("ok")).over(per_file))
    good = parsed.where("ok").drop("ok").withColumn("head", F.min_by(F.struct("e.type", "e.id"), "line").over(per_file))
    good = good.where((F.col("head.type") == "session") & F.col("head.id").isNotNull())
    return good.select("file", "line", F.col("head.id").alias("session_id"), "bad_lines", "e.*").withColumn("blocks", blocks(F.col("message.content")))


def blocks(raw: Column) -> Column:
    """Message content as blocks: JSON arrays as they are, anything else one text block; null has none."""
    text = F.struct(*(F.lit("text" if f.name == "type" else None).cast("string").alias(f.name) if f.name != "text" else raw.alias("text") for f in BLOCK.fields))
    array = F.from_json(raw, f"array<{BLOCK.simpleString()}>")
    return F.when(raw.isNull(), F.array().cast(f"array<{BLOCK.simpleString()}>")).when(F.ltrim(raw).startswith("[") & array.isNotNull(), array).otherwise(F.array(text))


def strict(raw: DataFrame, known: Column, max_bytes: int = LEDGER_BYTES, max_records: int = LEDGER_RECORDS) -> DataFrame:
    """Lines of a ledger: a torn last line is dropped, any other malformed line is an error.

    `known` says whether a line is well formed. Files beyond the bounds are refused.
    """
    per_file = Window.partitionBy("file")
    sized = raw.withColumn("n", F.count("*").over(per_file)).withColumn("size", F.sum(F.octet_length("value") + 1).over(per_file))
    bad = F.when(F.col("n") > max_records, F.raise_error(F.concat(F.lit("too many records: "), "file"))).when(F.col("size") > max_bytes, F.raise_error(F.concat(F.lit("too large: "), "file")))
    torn = ~known & ~F.col("terminated") & (F.col("line") == F.col("n") - 1)
    bad = bad.when(~known & ~torn & (F.trim("value") != ""), F.raise_error(F.concat(F.lit("malformed line "), F.col("line").cast("string"), F.lit(" of "), "file")))
    return sized.withColumn("bad", bad.otherwise(F.lit(False))).where(~F.col("bad") & known).drop("bad", "n", "size")


def headers(log: DataFrame) -> DataFrame:
    """One row per session: its header."""
    return log.where("line = 0 and type = 'session'").select("file", "session_id", "version", "timestamp", "cwd", "parentSession", "rlmDepth")


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A conversations table as entries: the parent of a turn is the turn before it."""
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return conversations.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("line"),
        F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.when(before.isNotNull(), F.concat_ws(":", "conv_id", before)).alias("parent"),
        before.alias("parent_line"),
        F.lit("message").alias("type"),
        "role",
        "text",
        C.estimate_tokens(F.col("text")).alias("tokens"),
    )


def file_timestamp(name: Column) -> Column:
    """Time in a file name such as 2024-01-02T03-04-05-678Z_id.jsonl; null where there is none."""
    m = r"(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})-(\d{3})Z"
    part = lambda i: F.regexp_extract(name, m, i)
    text = F.concat(part(1), F.lit(" "), part(2), F.lit(":"), part(3), F.lit(":"), part(4), F.lit("."), part(5))
    return F.when(part(1) != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS")))


def since(log: DataFrame, cutoff: Column) -> DataFrame:
    """Rows of files not older than the cut-off by name; names without a time are kept, and rows are not filtered again."""
    at = file_timestamp(F.regexp_extract("file", r"([^/]+)$", 1))
    return log.where(at.isNull() | (at >= cutoff))
