"""Entity edits with undo against a plain stack per session."""

import random

import pytest

from voxhive.operators import edits as ed

ENTITIES = "id string, position array<double>, rotation array<double>, state string, label string"


def play(entities, log, cap):
    """The editor's own bookkeeping: one stack of entries per session."""
    live, stacks = {e[0]: dict(zip(ed.FIELDS, e[1:])) for e in entities}, {}
    for session, _, op, key, entity, before, after, state in sorted(log, key=lambda r: r[1]):
        stack = stacks.setdefault(session, [])
        if op == "undo":
            if stack:
                kind, k, was, ent = stack.pop()
                if kind == "spawn":
                    live.pop(k, None)
                elif kind == "delete":
                    live[k] = dict(zip(ed.FIELDS, ent))
                elif k in live:
                    live[k][{"move": "position", "rotate": "rotation"}[kind]] = was
            continue
        if op == "spawn":
            live[key] = dict(zip(ed.FIELDS, entity))
        elif op == "delete":
            live.pop(key, None)
        elif op == "move":
            live[key]["position"] = after
        elif op == "rotate":
            live[key]["rotation"] = after
        else:
            live[key]["state"] = state
        if op != "state":
            stack.append((op, key, before, entity))
            del stack[:-cap]
    return {k: tuple(v[f] for f in ed.FIELDS) for k, v in live.items()}


def session_log(seed, n, sessions, cap):
    """A valid log: ops apply to entities that exist when they are made."""
    rng = random.Random(seed)
    entities = [(f"e{i}", [float(i), 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], None, "chair") for i in range(6)]
    log, fresh = [], 0
    for seq in range(n):
        live = play(entities, log, cap)
        session = rng.randrange(sessions)
        op = rng.choice(["move", "rotate", "spawn", "delete", "state", "undo", "undo", "undo"])
        keys = sorted(live)
        if op != "undo" and op != "spawn" and not keys:
            op = "spawn"
        key, entity, before, after, state = None, None, None, None, None
        if op == "spawn":
            key, fresh = f"n{fresh}", fresh + 1
            entity = ([float(seq), 1.0, 2.0], [0.0, 0.0, 0.0, 1.0], "off", "lamp")
        elif op != "undo":
            key = rng.choice(keys)
            position, rotation, *_ = live[key]
            if op == "delete":
                entity = live[key]
            elif op == "state":
                state = rng.choice(["on", "off"])
            else:
                before = position if op == "move" else rotation
                after = [float(seq)] * len(before)
        log.append((session, seq, op, key, entity, before, after, state))
    return entities, log


@pytest.mark.parametrize("seed,sessions,cap", [(1, 1, 50), (2, 3, 4), (3, 2, 1)])
def test_equals_stacks(spark, seed, sessions, cap):
    entities, log = session_log(seed, 160, sessions, cap)
    table = spark.createDataFrame(log, ed.LOG_SCHEMA).repartition(5)
    known = spark.createDataFrame(entities, ENTITIES)
    got = {r.id: (r.position, r.rotation, r.state, r.label) for r in ed.fold_entities(known, table, cap).collect()}
    want = {k: (list(v[0]), list(v[1]), v[2], v[3]) for k, v in play(entities, log, cap).items()}
    assert got == want


def test_matching_in_one_hot_session(spark):
    rng = random.Random(9)
    ops = [rng.choice(["move", "move", "undo", "undo", "state"]) for _ in range(3000)]
    stack, want = [], {}
    for seq, op in enumerate(ops):
        if op == "move":
            stack.append(seq)
            del stack[:-7]
        elif op == "undo" and stack:
            want[seq] = stack.pop()
    log = spark.createDataFrame([(1, s, op, "e", None, [0.0], [1.0], None) for s, op in enumerate(ops)], ed.LOG_SCHEMA)
    assert {r.seq: r.undone for r in ed.matched_undos(log, 7).collect()} == want


def test_empty(spark):
    none, known = spark.createDataFrame([], ed.LOG_SCHEMA), spark.createDataFrame([], ENTITIES)
    assert ed.fold_entities(known, none).collect() == []
    only = spark.createDataFrame([(1, 1, "undo", None, None, None, None, None)], ed.LOG_SCHEMA)
    assert ed.fold_entities(known, only).collect() == []
