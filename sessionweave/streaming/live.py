"""Live streams: message rebuilding, run telemetry, windowed usage, replay cursors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "session string, seq long, blocks string, done boolean"
#: fixed values: event kinds by what they do to a block
_START = {"text_start": "text", "thinking_start": "thinking", "toolcall_start": "toolCall"}
_DELTA = ("text_delta", "thinking_delta", "toolcall_delta")
_END = ("text_end", "thinking_end", "toolcall_end")


def rebuild(blocks: list[tuple[str, str]], rows: pd.DataFrame) -> Iterator[tuple[int, list[tuple[str, str]], bool]]:
    """(seq, blocks, done) after each delta (seq, kind, index, value) that applies; others are dropped."""
    for e in rows.sort_values("seq").itertuples(index=False):
        i = int(e.index_) if e.index_ is not None and e.index_ == e.index_ else -1
        if e.kind in ("message_start", "session_replaced", "session_resynced", "session_closed"):
            blocks.clear()
            if e.kind != "message_start":
                continue
        elif e.kind in _START and 0 <= i <= len(blocks):
            blocks[i : i + 1] = [(_START[e.kind], "")]
        elif e.kind in _DELTA and 0 <= i < len(blocks):
            blocks[i] = (blocks[i][0], blocks[i][1] + (e.value or ""))
        elif e.kind in _END and 0 <= i < len(blocks):
            blocks[i] = (blocks[i][0], e.value if e.value is not None else blocks[i][1])
        elif e.kind != "message_end":
            continue
        yield int(e.seq), list(blocks), e.kind == "message_end"
        if e.kind == "message_end":
            blocks.clear()


def _shown(blocks: list[tuple[str, str]]) -> str:
    return "\n".join(f"{k}:{v}" for k, v in blocks)


def rebuilt(deltas: DataFrame) -> DataFrame:
    """Stream of (session, seq, kind, index_, value) -> finished messages, state kept per session.

    State is what a message holds so far; it goes when the message ends or the session is replaced.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blocks = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for rows in frames:
            out += [(key[0], seq, _shown(b), done) for seq, b, done in rebuild(blocks, rows) if done]
        if blocks:
            state.update(([k for k, _ in blocks], [v for _, v in blocks]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session", "seq", "blocks", "done"])

    return deltas.groupBy("session").applyInPandasWithState(step, MESSAGE, "kinds array<string>, texts array<string>", "append", GroupStateTimeout.NoTimeout)


def rebuilt_batch(deltas: DataFrame) -> DataFrame:
    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(rows["session"].iloc[0], seq, _shown(b), done) for seq, b, done in rebuild([], rows) if done]
        return pd.DataFrame(out, columns=["session", "seq", "blocks", "done"])

    return deltas.groupBy("session").applyInPandas(whole, MESSAGE)


RUN = "session string, run long, turns long, tools long, errors long, first_text_ms long, ms long, outcome string"


def run_rows(held: list[int], rows: pd.DataFrame) -> Iterator[tuple]:
    """(run, turns, tools, errors, first_text_ms, ms, outcome) at the end of each run of (seq, kind, ms).

    held is [run, start, turns, tools, errors, first text or -1], start -1 between runs. A start
    before the end closes the run as lost; what comes between runs is dropped.
    """
    for e in rows.sort_values("seq").itertuples(index=False):
        running = held[1] >= 0
        if e.kind in ("run_start", "run_end", "run_error") and running:
            outcome = {"run_start": "lost", "run_end": "done", "run_error": "error"}[e.kind]
            yield held[0], held[2], held[3], held[4], held[5] if held[5] >= 0 else None, int(e.ms) - held[1], outcome
            held[1] = -1
        if e.kind == "run_start":
            held[:] = [held[0] + 1, int(e.ms), 0, 0, 0, -1]
        elif running:
            held[2] += e.kind == "turn_start"
            held[3] += e.kind == "tool_start"
            held[4] += e.kind == "tool_error"
            if e.kind == "text" and held[5] < 0:
                held[5] = int(e.ms) - held[1]


def _runs(session: str, out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame([(session, *r) for r in out], columns=[c.split()[0] for c in RUN.split(", ")])
    return frame.assign(first_text_ms=frame["first_text_ms"].astype("Int64"))


def runs(events: DataFrame) -> DataFrame:
    """Stream of (session, seq, kind, ms) -> finished runs; six numbers of state per session."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else [0, -1, 0, 0, 0, -1]
        out = [r for rows in frames for r in run_rows(held, rows)]
        state.update((held,))
        yield _runs(key[0], out)

    return events.groupBy("session").applyInPandasWithState(step, RUN, "held array<long>", "append", GroupStateTimeout.NoTimeout)


def runs_batch(events: DataFrame) -> DataFrame:
    return events.groupBy("session").applyInPandas(lambda rows: _runs(rows["session"].iloc[0], list(run_rows([0, -1, 0, 0, 0, -1], rows))), RUN)


TAIL = "session string, tail string, total_lines long, total_bytes long"


def tails(chunks: DataFrame, most_bytes: int = 50 * 1024) -> DataFrame:
    """Stream of (session, seq, chunk) -> the last bytes of each output so far, with totals; update mode.

    State holds no more than the tail, cut at a character.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, lines, size = state.get if state.exists else ("", 0, 0)
        for rows in frames:
            text = "".join(rows.sort_values("seq")["chunk"])
            raw = (tail + text).encode()[-most_bytes:] if most_bytes else b""
            tail, lines, size = raw.decode("utf-8", errors="ignore"), lines + text.count("\n"), size + len(text.encode())
        state.update((tail, lines, size))
        yield pd.DataFrame([(key[0], tail, lines, size)], columns=["session", "tail", "total_lines", "total_bytes"])

    return chunks.groupBy("session").applyInPandasWithState(step, TAIL, "tail string, total_lines long, total_bytes long", "update", GroupStateTimeout.NoTimeout)


def compact(kind: Column, value: Column) -> Column:
    """Struct of a delta without the growing snapshot: value only where the kind carries one."""
    return F.struct(kind.alias("kind"), F.when(kind.isin(*_DELTA, *_END), value).alias("value"))


def windowed_usage(events: DataFrame, ts: str, key: str, value: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Usage by window and key, final once the watermark has passed."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def exactly_once(commands: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each command once, duplicates within the watermark dropped."""
    return commands.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if commands.isStreaming else commands.dropDuplicates([key])


def replay(asked: Column, oldest: Column, newest: Column, same_stream: Column) -> Column:
    """Struct of status and reason for a cursor: complete, or unavailable and why."""
    reason = F.when(~same_stream, "stream_changed").when(asked > newest, "ahead").when(asked + 1 < oldest, "expired")
    return F.struct(F.when(reason.isNull(), "complete").otherwise("unavailable").alias("status"), reason.alias("reason"))


def outbox(files: DataFrame, cursor: DataFrame) -> DataFrame:
    """Files (path, size, mtime) ahead of what the cursor says was sent."""
    sent = cursor.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    joined = files.join(sent, "path", "left")
    return joined.where(F.col("_size").isNull() | (F.col("size") != F.col("_size")) | (F.col("mtime") > F.col("_mtime"))).drop("_size", "_mtime")
