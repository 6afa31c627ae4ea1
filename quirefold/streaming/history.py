"""Undo and redo of edit sessions as a stream with state: what ``operators.session.replay`` gives in a batch.

Actions may arrive late and out of order, up to the watermark. They wait in a list until the watermark has passed them
and are then replayed in order of event time; the tape of steps is a list of at most ``history`` + 1 entries. A session
without actions for ``forget`` of event time is forgotten and begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirefold.operators.session import HISTORY

OUT = "session bigint, seq bigint, present string, undo_depth int, redo_depth int"
COLUMNS = ["session", "seq", "present", "undo_depth", "redo_depth"]


class Replay(StatefulProcessor):
    """One session: a tape of steps, a cursor on it, and the actions that the watermark hasn't passed."""

    def __init__(self, history: int, forget_ms: int):
        self.history, self.forget_ms = history, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tape = handle.getListState("tape", "step string")
        self.place = handle.getValueState("place", "cursor int, last_ms bigint")
        self.waiting = handle.getListState("waiting", "ms bigint, seq bigint, action string, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ms), int(seq), a, v) for part in rows for ms, seq, a, v in part[["ms", "seq", "action", "value"]].astype(object).where(lambda d: d.notna(), None).itertuples(index=False)]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] <= passed]
        cursor, last = self.place.get() if self.place.exists() else (0, None)
        if not waiting:
            if last is not None and passed >= last + self.forget_ms:
                for state in (self.tape, self.place, self.waiting):
                    state.clear()
            return
        tape = [r[0] for r in self.tape.get()] if self.tape.exists() else [None]
        out = []
        for ms, seq, action, value in ready:
            if action == "edit":
                tape = [*tape[: cursor + 1], value][-self.history - 1 :]
                cursor = len(tape) - 1
            elif action == "undo" and cursor:
                cursor -= 1
            elif action == "redo" and cursor < len(tape) - 1:
                cursor += 1
            last = ms
            out.append((key[0], seq, tape[cursor], cursor, len(tape) - 1 - cursor))
        self.tape.put([(step,) for step in tape])
        self.place.update((cursor, last))
        left = waiting[len(ready) :]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
            self.handle.registerTimer(last + self.forget_ms)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


def replayed(actions: DataFrame, session: str, seq: str, at: str, action: str, value: str, late: str = "10 minutes", history: int = HISTORY, forget: str = "1 day") -> DataFrame:
    """session, seq, present, undo_depth, redo_depth of a stream of actions, in order of ``at`` (a timestamp), then ``seq``.

    Rows that come more than ``late`` behind the newest are dropped, as with any watermark. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    source = actions.withWatermark(at, late).select(
        F.col(session).cast("long").alias("session"), F.col(at), F.unix_millis(F.col(at)).alias("ms"), F.col(seq).cast("long").alias("seq"), F.col(action).alias("action"), F.col(value).cast("string").alias("value")
    )
    return source.groupBy("session").transformWithStateInPandas(Replay(history, forget_ms), OUT, "Append", "EventTime")
