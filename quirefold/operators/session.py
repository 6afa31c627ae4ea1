"""Edit sessions: bursts of edits to one line become one step; undo and redo over the steps.

Undo and redo are replayed in pieces, so no task needs a whole session. A session's state is a tape of steps with a
cursor: an edit cuts the tape behind the cursor and appends, undo and redo move the cursor. What a piece of a session
does to the cursor is a small table, whatever its length:

* Before its first edit, undos and redos turn the redo depth r into min(max(r + d, low), high), where the bounds
  depend on the number p of steps before the tape's end: one pair for each p up to the history.
* From its first edit on, everything follows from the p of that edit: the last p and r and how far the cursor has moved.

Pieces are the stretches of sessions in ranges of (session, order). Their tables are applied one after another per
session, which gives the state before each piece; then all pieces are replayed at once. The step under the cursor is the
last one that was put at its place on the tape: within the piece the replay knows it, for the others a window over one
row for each piece and place finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirefold.operators.islands import islands
from quirefold.operators.stored import stored

#: Longest pause within a burst, and how many steps can be undone.
BURST_MICROS, HISTORY = 500_000, 200
EDIT, UNDO, REDO = 1, 2, 3


def coalesced(edits: DataFrame, session: str, line: str, at: str, order: list[str], gap: int = BURST_MICROS) -> DataFrame:
    """``edits`` with a burst number: consecutive edits of a session to the same line, each within ``gap`` of the last."""
    return islands(edits, [session], [at, *order], lambda prev: (F.col(line) == prev(line)) & (F.col(at) - prev(at) <= gap), "burst")


class Effect:
    """What a piece of a session does to (steps before the tape's end, redo depth, cursor); grown run by run."""

    def __init__(self, history: int = HISTORY):
        self.history, self.moved, self.edited = history, 0, False
        self.low, self.high = np.zeros(history + 1, "i4"), np.arange(history + 1, dtype="i4")
        self.steps, self.redo, self.cursor = np.arange(history + 1, dtype="i4"), np.zeros(history + 1, "i4"), np.zeros(history + 1, "i8")

    def add(self, kind: int, times: int) -> None:
        """``times`` actions of one kind in a row; other kinds do nothing."""
        if kind == EDIT:
            more = times - (not self.edited)  # the first edit is the one that the tables start from
            if more:
                self.steps = np.minimum(self.steps - self.redo + more, self.history)
                self.redo = np.zeros_like(self.redo)
                self.cursor = self.cursor + more
            self.edited = True
        elif kind in (UNDO, REDO):
            far = times if kind == UNDO else -times
            if self.edited:
                redo = np.clip(self.redo + far, 0, self.steps)
                self.cursor = self.cursor - (redo - self.redo)
                self.redo = redo
            else:
                most = np.arange(self.history + 1, dtype="i4")
                self.moved += far
                self.low, self.high = np.clip(self.low + far, 0, most), np.clip(self.high + far, 0, most)

    def packed(self) -> tuple[int, bool, bytes]:
        tables = [self.low, self.high, self.steps, self.redo]
        return self.moved, self.edited, b"".join(t.astype("<i4").tobytes() for t in tables) + self.cursor.astype("<i8").tobytes()


def after(state: tuple[int, int, int], moved: int, edited: bool, tables: bytes, history: int = HISTORY) -> tuple[int, int, int]:
    """``state`` (steps, redo depth, cursor) after a packed effect."""
    low, high, steps, redo = np.frombuffer(tables, "<i4", 4 * (history + 1)).reshape(4, -1)
    cursor = np.frombuffer(tables, "<i8", offset=16 * (history + 1))
    p, r, c = state
    now = int(min(max(r + moved, low[p]), high[p]))
    c -= now - r
    if not edited:
        return p, now, c
    p = min(p - now + 1, history)
    return int(steps[p]), int(redo[p]), c + 1 + int(cursor[p])


def _pieces(batches: Iterator[pa.RecordBatch], start, one, end) -> Iterator[list]:
    """Rows come sorted by part and session; ``one(piece, row)`` for each row of a piece, ``end(piece)`` behind it."""
    last, piece = None, None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if piece is None or (row[0], row[1]) != last:
                if piece is not None:
                    yield end(piece)
                last, piece = (row[0], row[1]), start(row)
            one(piece, row)
    if piece is not None:
        yield end(piece)


def _same(left: list[Column], right: list[Column]) -> Column:
    both = F.lit(True)
    for a, b in zip(left, right):
        both = both & a.eqNullSafe(b)
    return both


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "session", "seq")


def piece_effects(rows: DataFrame, history: int = HISTORY) -> DataFrame:
    """part, session, moved, edited, tables: one row a piece. rows: part, session, seq, kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(piece: list, row: tuple) -> None:
            if row[2] != piece[1]:
                piece[0].add(piece[1], piece[2])
                piece[1:3] = row[2], 0
            piece[2] += 1

        def end(piece: list) -> tuple:
            piece[0].add(piece[1], piece[2])
            return (*piece[3:], *piece[0].packed())

        found = []
        for piece in _pieces(batches, lambda row: [Effect(history), row[2], 0, row[0], row[1]], one, end):
            found.append(piece)
            if len(found) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=names)

    schema = rows.select("part", "session").schema.add("moved", "long").add("edited", "boolean").add("tables", "binary")
    kinds, names = [to_arrow_type(f.dataType) for f in schema], schema.names
    return _in_order(rows).select("part", "session", "kind").mapInArrow(run, schema)


def states_before(effects: DataFrame, history: int = HISTORY) -> DataFrame:
    """part, session, p, r, c: the state before each piece. A group has one row for each range its session touches."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out, state = [], (0, 0, 0)
        for part, moved, edited, tables in group.sort_values("part")[["part", "moved", "edited", "tables"]].itertuples(index=False):
            out.append((part, *state))
            state = after(state, moved, edited, tables, history)
        found = pd.DataFrame(out, columns=["part", "p", "r", "c"])
        found.insert(1, "session", group["session"].iloc[0])
        return found

    kind = dict(effects.dtypes)["session"]
    return effects.groupBy("session").applyInPandas(fold, f"part int, session {kind}, p int, r int, c long")


def _replayed(rows: DataFrame, history: int) -> DataFrame:
    """session, seq, part, kind, value, place, undo_depth, redo_depth, known, present of each row; rows have p, r, c of their piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, p, r, c, tape = None, 0, 0, 0, {}
        for batch in batches:
            out = []
            for part, session, _, kind, value, p0, r0, c0 in zip(*[x.to_pylist() for x in batch.columns]):
                if (part, session) != last:
                    last, p, r, c, tape = (part, session), p0, r0, c0, {}
                if kind == EDIT:
                    p, r, c = min(p - r + 1, history), 0, c + 1
                    tape[c] = value
                    tape.pop(c - history - 1, None)  # out of reach
                elif kind == UNDO and r < p:
                    r, c = r + 1, c - 1
                elif kind == REDO and r > 0:
                    r, c = r - 1, c + 1
                out.append((c, p - r, r, c in tape or c == 0, tape.get(c)))
            made = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (1, 2, 0, 3, 4)], *made], names=schema.names)

    schema = rows.select("session", "seq", "part", "kind", "value").schema
    schema = schema.add("place", "long").add("undo_depth", "integer").add("redo_depth", "integer").add("known", "boolean").add("present", "string")
    return _in_order(rows).select("part", "session", "seq", "kind", "value", "p", "r", "c").mapInArrow(run, schema)


def replay(actions: DataFrame, session: str, seq: str, action: str, value: str, history: int = HISTORY) -> DataFrame:
    """session, seq, present, undo_depth, redo_depth after each action: edit pushes, undo and redo move.

    ``seq`` is the order within a session. Defined results: nothing to undo or redo, other actions and null: the state
    stays; before the first edit present is null; a null value is a step like any other; null sessions are one session;
    rows with equal session and seq are taken in any order; no rows, no rows.
    """
    name = F.col(f"`{action}`")
    kind = F.when(name == "edit", EDIT).when(name == "undo", UNDO).when(name == "redo", REDO).otherwise(0)
    rows = actions.select(F.col(f"`{session}`").alias("session"), F.col(f"`{seq}`").cast("long").alias("seq"), kind.alias("kind"), F.col(f"`{value}`").cast("string").alias("value"))
    rows = stored(rows.repartitionByRange("session", "seq").withColumn("part", F.spark_partition_id()), "actions")
    before = stored(states_before(piece_effects(rows.select("part", "session", "seq", "kind"), history), history), "states")
    to = before.select(F.col("part").alias("_part"), F.col("session").alias("_session"), "p", "r", "c")
    placed = stored(_replayed(rows.join(to, _same([F.col("part"), F.col("session")], [F.col("_part"), F.col("_session")])).drop("_part", "_session"), history), "replayed")
    # steps of earlier pieces: the last one at each place before the piece that asks for it
    asked = placed.where(~F.col("known")).select("session", "part", "place").distinct().withColumn("step", F.lit(None).cast("struct<value:string>")).withColumn("asks", F.lit(0))
    put = placed.where(F.col("kind") == EDIT).groupBy("session", "part", "place").agg(F.max_by(F.struct("value"), "seq").alias("step")).withColumn("asks", F.lit(1))
    earlier = Window.partitionBy("session", "place").orderBy("part", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.union(put).withColumn("step", F.last("step", ignorenulls=True).over(earlier)).where("asks = 0")
    found = found.select(F.col("session").alias("_session"), F.col("part").alias("_part"), F.col("place").alias("_place"), "step")
    both = placed.join(found, ~F.col("known") & _same([F.col("session"), F.col("part"), F.col("place")], [F.col("_session"), F.col("_part"), F.col("_place")]), "left")
    return both.select("session", "seq", F.when(F.col("known"), F.col("present")).otherwise(F.col("step.value")).alias("present"), "undo_depth", "redo_depth")
