"""Edit sessions as streams: the coalescer of ``operators.session`` with its state kept between micro-batches.

Timeouts are by the clock, so an idle stream would run empty batches without end; switch them off with
``spark.sql.streaming.noDataMicroBatches.enabled=false`` where that matters: sessions are then forgotten with the next
batch that has rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirefold.operators.session import BURST_MICROS

OUT = "session bigint, seq bigint, line string, t bigint, burst bigint"
STATE = "line string, t bigint, burst bigint"


def coalesced(edits: DataFrame, session: str, line: str, at: str, seq: str, gap: int = BURST_MICROS, forget: str = "1 hour") -> DataFrame:
    """session, seq, line, t, burst of a stream of edits; ``at`` is in microseconds and rises within a session.

    An edit joins the burst of the one before it if that was to the same line at most ``gap`` earlier. The state of a
    session is three values; a session without edits for ``forget`` is forgotten and starts at burst 1 again.
    """
    idle = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, t, burst = state.get if state.exists else (None, 0, 0)
        rows = []
        for row in pd.concat(list(batches)).sort_values(["t", "seq"]).itertuples(index=False):
            burst += not (burst and row.line == last and row.t - t <= gap)
            last, t = row.line, row.t
            rows.append((key[0], row.seq, last, t, burst))
        state.update((last, t, burst))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame(rows, columns=["session", "seq", "line", "t", "burst"])

    source = edits.select(F.col(session).cast("long").alias("session"), F.col(seq).cast("long").alias("seq"), F.col(line).alias("line"), F.col(at).cast("long").alias("t"))
    return source.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
