"""Entity edits as an append-only log with undo.

Log rows: session, seq (one order over all sessions), op, id and what the op needs:

* ``spawn`` entity (all fields), ``delete`` entity (the fields it had);
* ``move`` / ``rotate`` with before and after;
* ``state`` with after; it cannot be undone;
* ``undo`` takes back the session's last edit that is not taken back yet.

A session remembers its last ``UNDO_CAP`` edits; an undo with none left does nothing.
Undos are matched by scans over ranges of the log, so neither a session nor an entity has
to fit a task.  The log is never rewritten: a matched undo becomes a compensating record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxhive.session import cut

UNDO_CAP = 50

FIELDS = ("position", "rotation", "state", "label")
ENTITY = "struct<position:array<double>,rotation:array<double>,state:string,label:string>"
LOG_SCHEMA = (
    f"session bigint, seq bigint, op string, id string, entity {ENTITY}, before array<double>, after array<double>, state string"
)
UNDOABLE = ("spawn", "delete", "move", "rotate")


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt to ranges of ``order``, with the number of the range; written, so that the numbers stay."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def _void_undos(steps: DataFrame, cap: int) -> DataFrame:
    """session, seq of undos that find nothing: the count of remembered edits is a walk held between 0 and ``cap``.

    Steps held to an interval compose to one such step, so a range is summed up in three
    numbers per session: x becomes min(top, max(low, x + shift)).
    """
    dealt = _ranges(steps, "session", "seq")

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[int]] = {}
        for frame in frames:
            for part, session, step in zip(frame["_range"], frame["session"], frame["step"]):
                f = held.setdefault((part, session), [0, 0, cap])  # shift, low, top
                f[:] = [f[0] + step, min(max(f[1] + step, 0), cap), min(max(f[2] + step, 0), cap)]
        yield pd.DataFrame([(*k, *f) for k, f in held.items()], columns=["_range", "session", "shift", "low", "top"])

    # Inside a range the rows of a session are in order once the partition is sorted; the partitioning stays.
    ordered = dealt.sortWithinPartitions("_range", "session", "seq")
    sums = cut(ordered.mapInPandas(summed, "_range int, session long, shift long, low long, top long"))
    before = Window.partitionBy("session").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.aggregate(
        F.collect_list(F.struct("shift", "low", "top")).over(before), F.lit(0).cast("long"),
        lambda x, f: F.least(f["top"], F.greatest(f["low"], x + f["shift"])))
    starts = sums.select(F.col("_range").alias("_r"), F.col("session").alias("_s"), start.alias("_start"))
    # Ranges per session are at most the number of partitions.
    joined = dealt.join(F.broadcast(starts.where("_start > 0")), (F.col("_range") == F.col("_r")) & (F.col("session") == F.col("_s")), "left")

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], int] = {}
        for frame in frames:
            out = []
            for part, session, seq, step, start_at in zip(frame["_range"], frame["session"], frame["seq"], frame["step"], frame["_start"]):
                x = held.get((part, session), start_at)
                if step < 0 and x == 0:
                    out.append((session, seq))
                held[part, session] = min(max(x + step, 0), cap)
            yield pd.DataFrame(out, columns=["session", "seq"])

    rows = joined.select("_range", "session", "seq", "step", F.coalesce("_start", F.lit(0)).alias("_start"))
    return rows.sortWithinPartitions("_range", "session", "seq").mapInPandas(walked, "session long, seq long")


def _levels(steps: DataFrame) -> DataFrame:
    """Add ``level``: the height of the stack at which each push and its undo lie."""
    dealt = _ranges(steps, "session", "seq")
    inside = Window.partitionBy("_range", "session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("_range", "session").agg(F.sum("step").alias("_sum"))
    before = Window.partitionBy("session").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_range", "session", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    height = F.col("_base") + F.sum("step").over(inside)
    return dealt.join(bases, ["_range", "session"]).withColumn("level", F.when(F.col("step") > 0, height).otherwise(height + 1)).drop("_base", "_range")


def matched_undos(log: DataFrame, cap: int = UNDO_CAP) -> DataFrame:
    """session, seq of every undo that takes an edit back, and ``undone``: the seq of that edit."""
    step = F.when(F.col("op") == "undo", -1).when(F.col("op").isin(*UNDOABLE), 1)
    steps = log.select("session", "seq", step.cast("long").alias("step")).where(F.col("step").isNotNull())
    void = _void_undos(steps, cap)
    placed = _levels(steps.join(void, ["session", "seq"], "left_anti"))
    # At one level of a session pushes and undos take turns: an undo's edit is the row before it.
    dealt = _ranges(placed.select("session", "level", "seq", "step"), "session", "level", "seq")
    here = Window.partitionBy("_range", "session", "level").orderBy("seq")
    edges = dealt.groupBy("_range").agg(F.max(F.struct("session", "level", "seq")).alias("last"))
    across = Window.orderBy("_range")  # one row per range
    carried = edges.select((F.lead("_range").over(across)).alias("_range"), "last").where(F.col("_range").isNotNull())
    rows = dealt.withColumn("undone", F.lag("seq").over(here)).join(F.broadcast(carried), "_range", "left")
    same = (F.col("last.session") == F.col("session")) & (F.col("last.level") == F.col("level"))
    return rows.where("step < 0").select("session", "seq", F.coalesce("undone", F.when(same, F.col("last.seq"))).alias("undone"))


def compensated(log: DataFrame, cap: int = UNDO_CAP) -> DataFrame:
    """The log with every undo replaced by the record that takes its edit back; undos of nothing are left out.

    A spawn is taken back by ``remove``, a delete by ``restore``, a move or rotation by one to where it came from.
    """
    pairs = matched_undos(log, cap).select(F.col("session").alias("_s"), F.col("seq").alias("_at"), F.col("undone").alias("_of"))
    edits = log.where(F.col("op") != "undo")
    back = edits.join(pairs, (F.col("session") == F.col("_s")) & (F.col("seq") == F.col("_of")))
    op = F.when(F.col("op") == "spawn", "remove").when(F.col("op") == "delete", "restore").otherwise(F.col("op"))
    back = back.select("session", F.col("_at").alias("seq"), op.alias("op"), "id", "entity", F.col("after").alias("before"),
                       F.col("before").alias("after"), "state")
    return edits.select(*back.columns).unionByName(back)


def _last(value: Column, when: Column) -> Column:
    """The value of the latest record for which ``when`` holds (its value may be null)."""
    return F.max(F.when(when, F.struct("seq", value.alias("v"))))["v"]


def fold_entities(entities: DataFrame, log: DataFrame, cap: int = UNDO_CAP) -> DataFrame:
    """id, position, rotation, state, label of all entities after the log; records of unknown ids are left out.

    Aggregates combine before the shuffle, so an entity may have any number of records.
    """
    known = entities.select(
        F.lit(None).cast("bigint").alias("session"), F.lit(-(1 << 62)).alias("seq"), F.lit("spawn").alias("op"), "id",
        F.struct(*FIELDS).cast(ENTITY).alias("entity"), F.lit(None).cast("array<double>").alias("before"),
        F.lit(None).cast("array<double>").alias("after"), F.lit(None).cast("string").alias("state"))
    rows = known.unionByName(compensated(log, cap))
    op = F.col("op")
    whole, gone = op.isin("spawn", "restore"), op.isin("delete", "remove")

    def field(name: str, own: str | None, value: str) -> Column:
        full = F.col(f"entity.{name}")
        if own is None:
            return _last(full, whole)
        return _last(F.when(op == own, F.col(value)).otherwise(full), whole | (op == own))

    folded = rows.groupBy("id").agg(
        _last(whole, whole | gone).alias("alive"), field("position", "move", "after").alias("position"),
        field("rotation", "rotate", "after").alias("rotation"), field("state", "state", "state").alias("state"),
        field("label", None, "").alias("label"))
    return folded.where("alive").drop("alive")
