"""Per-key stream state: debounce, echoes, tails, undo stacks, repeated content.

The state of a key is one hash or a bounded list. A micro-batch hands a key's rows
over in no order, so each function sorts them by time first; the size of a batch is
set at the source.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusgraph import constants as K


def debounce(events: DataFrame, gap: str | Column = f"{K.DEBOUNCE_MS} milliseconds", lateness: str = "1 minute") -> DataFrame:
    """One firing per quiet period: the last row of each session, batch or stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    sessions = timed.groupBy("key", F.session_window("ts", gap).alias("w"))
    return sessions.agg(F.count("*").alias("n"), F.max_by("event_id", "ts").alias("event_id")).select(
        "key", "event_id", "n")


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(batches)
    return (pd.concat(parts) if parts else pd.DataFrame()).sort_values(["ts", "event_id"])


def _run(stream: DataFrame, key: str, function, output: str, state: str) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(function, output, state, "append", GroupStateTimeout.NoTimeout)


def suppress_echoes(stream: DataFrame) -> DataFrame:
    """Drop the first change that equals the key's own last write.

    Rows: ``(key, event_id, ts, own, content_hash)``; own writes are not passed on.
    """
    def step(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        passed = []
        for row in _ordered(batches).itertuples():
            if row.own:
                last = row.content_hash
            elif last is not None and row.content_hash == last:
                last = None
            else:
                passed.append(row.event_id)
        state.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(passed), "event_id": passed}).astype({"event_id": "int64"})

    return _run(stream, "key", step, "key bigint, event_id bigint", "last string")


def drop_repeats(stream: DataFrame) -> DataFrame:
    """Pass a row only when its content differs from the key's previous content."""
    def step(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        passed = []
        for row in _ordered(batches).itertuples():
            if row.content_hash != last:
                passed.append(row.event_id)
            last = row.content_hash
        state.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(passed), "event_id": passed}).astype({"event_id": "int64"})

    return _run(stream, "key", step, "key bigint, event_id bigint", "last string")


def drop_repeats_batch(events: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    before = F.lag("content_hash").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    return events.withColumn("_before", before).filter(~F.col("content_hash").eqNullSafe(F.col("_before"))).drop("_before")


def bounded_tail(stream: DataFrame, limit: int) -> DataFrame:
    """``(key, seen, event_id, age)``: the last rows per key after each batch, newest age 1.

    A reader keeps, per key, the rows with the largest ``seen``.
    """
    def step(key, batches, state: GroupState):
        held, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        ids = _ordered(batches)["event_id"].tolist()
        held, seen = (held + ids)[-limit:], seen + len(ids)
        state.update((held, seen))
        yield pd.DataFrame({"key": key[0], "seen": seen, "event_id": held[::-1], "age": range(1, len(held) + 1)})

    return _run(stream, "key", step, "key bigint, seen bigint, event_id bigint, age int", "held array<bigint>, seen bigint")


def latest_tail(tails: DataFrame) -> DataFrame:
    """The newest tail of each key out of the table written by :func:`bounded_tail`."""
    now = tails.groupBy("key").agg(F.max("seen").alias("seen"))
    return tails.join(now, ["key", "seen"], "left_semi")


def undo_redo(stream: DataFrame, limit: int) -> DataFrame:
    """``(project, event_id, ok, undo_count, redo_count)`` with both stacks as state.

    A record clears the redo stack and lets the oldest step fall off at the limit; the
    limit is not checked again when a redo puts a step back.
    """
    def step(key, batches, state: GroupState):
        undo, redo = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        out = []
        for row in _ordered(batches).itertuples():
            done = True
            if row.action == "record":
                undo, redo = (undo + [row.event_id])[-limit:], []
            elif row.action == "undo" and undo:
                redo.append(undo.pop())
            elif row.action == "redo" and redo:
                undo.append(redo.pop())
            else:
                done = False
            out.append((key[0], row.event_id, done, len(undo), len(redo)))
        state.update((undo, redo))
        yield pd.DataFrame(out, columns=["project", "event_id", "ok", "undo_count", "redo_count"])

    return _run(stream, "project", step, "project bigint, event_id bigint, ok boolean, undo_count int, redo_count int",
                "undo array<bigint>, redo array<bigint>")
