"""Types of session logs: a header, then entries that form a tree by parent id."""

from __future__ import annotations

from pyspark.sql import types as T

_cost = T.StructType([T.StructField(c, T.DoubleType()) for c in ("input", "output", "cacheRead", "cacheWrite", "total")])

USAGE = T.StructType([*(T.StructField(c, T.LongType()) for c in ("input", "output", "cacheRead", "cacheWrite", "totalTokens")), T.StructField("cost", _cost)])

#: one content block; arguments keep their JSON text
BLOCK = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "text", "thinking", "data", "mimeType", "id", "name", "arguments")])

MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("provider", "model", "api", "stopReason", "errorMessage", "toolCallId", "toolName", "command", "output", "summary", "customType")),
        T.StructField("isError", T.BooleanType()),
        T.StructField("usage", USAGE),
    ]
)

ENTRY = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("type", "id", "parentId", "timestamp", "cwd", "parentSession", "firstKeptEntryId", "summary", "targetId", "label", "name", "state", "customType", "data", "provider", "modelId", "thinkingLevel")),
        T.StructField("version", T.IntegerType()),
        T.StructField("rlmDepth", T.IntegerType()),
        T.StructField("tokensBefore", T.DoubleType()),
        T.StructField("message", MESSAGE),
        T.StructField("usage", USAGE),
    ]
)
