"""Undo and redo in pieces against one stack, whatever the pieces; the tables of effects against replays."""

import random

import pytest

from quirefold.operators import session


def stacks(actions, history):
    """(session, seq, present, undo depth, redo depth) after each of (session, seq, action, value)."""
    out, now = [], {}
    for s, seq, action, value in sorted(actions, key=lambda a: (a[0] is not None, a[0] or 0, a[1])):
        past, present, future = now.get(s, ([], None, []))
        if action == "edit":
            past, present, future = [*past, present][-history:], value, []
        elif action == "undo" and past:
            past, present, future = past[:-1], past[-1], [*future, present]
        elif action == "redo" and future:
            past, present, future = [*past, present], future[-1], future[:-1]
        now[s] = past, present, future
        out.append((s, seq, present, len(past), len(future)))
    return sorted(out, key=str)


KIND = {"edit": session.EDIT, "undo": session.UNDO, "redo": session.REDO, "look": 0, None: 0}


@pytest.mark.parametrize("history", [1, 2, 5])
def test_effects_are_replays(history):
    rng = random.Random(history)
    for _ in range(300):
        weights = rng.choice([(5, 1, 1), (1, 5, 1), (1, 3, 3), (0, 1, 1)])
        actions = rng.choices(["edit", "undo", "redo"], weights, k=rng.randint(0, 40))
        cuts = sorted(rng.sample(range(len(actions) + 1), min(3, len(actions) + 1)))
        state = (0, 0, 0)
        for a, b in zip([0, *cuts], [*cuts, len(actions)]):
            effect = session.Effect(history)
            for action in actions[a:b]:
                effect.add(KIND[action], 1)
            state = session.after(state, *effect.packed(), history)
        p, r, _ = state
        *_, undo, redo = (stacks([(1, k, a, k) for k, a in enumerate(actions)], history) and max(stacks([(1, k, a, k) for k, a in enumerate(actions)], history), key=lambda x: x[1])) or (0, 0)
        assert (p - r, r) == (undo, redo)


def test_runs_of_actions_are_single_actions():
    for kinds in ([(1, 5), (2, 3), (3, 2), (1, 1)], [(2, 4), (3, 9), (1, 3), (2, 300)], [(3, 2), (2, 7)]):
        whole, single = session.Effect(), session.Effect()
        for kind, times in kinds:
            whole.add(kind, times)
            for _ in range(times):
                single.add(kind, 1)
        assert whole.packed() == single.packed()


@pytest.mark.parametrize(("history", "partitions"), [(200, 4), (3, 7), (5, 1)])
def test_replay_in_pieces(spark, history, partitions):
    rng = random.Random(partitions)
    actions = []
    for s, n in ((1, 2000), (2, 40), (None, 30), (3, 1), (4, 500)):  # one session over most of the pieces
        weights = rng.choice([(4, 2, 2, 1), (2, 6, 4, 1)])
        for k in range(n):
            if s == 1 and 300 <= k < 1500:
                weights = ((1, 9, 9, 0), (0, 9, 1, 0), (0, 1, 9, 0), (6, 6, 0, 0))[k // 100 % 4]  # pieces without edits, one place edited again and again
            action = rng.choices(["edit", "undo", "redo", rng.choice(["look", None])], weights)[0]
            actions.append((s, k, action, None if rng.random() < 0.05 else f"{s}.{k}"))
    df = spark.createDataFrame(rng.sample(actions, len(actions)), "session long, at int, act string, what string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = session.replay(df, "session", "at", "act", "what", history)
        assert sorted(map(tuple, got.collect()), key=str) == stacks(actions, history)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_actions(spark):
    none = spark.createDataFrame([], "session long, at int, act string, what string")
    assert session.replay(none, "session", "at", "act", "what").count() == 0
