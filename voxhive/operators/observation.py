"""The observation map: log-odds, majority label and mean colour per cell.

Input is one row per measured point:
``frame_seq, row_seq, ox, oy, oz, px, py, pz`` and optionally ``label`` and
``r, g, b``. Order matters (two-sided clamp, streaming majority, rounding per
frame), so every fold runs over an explicitly sorted history.

A cell that every ray crosses would gather all frames in one row. Histories are
therefore folded in segments of ``SEGMENT`` frames first. The clamped log-odds
step is monotone, so folding a segment from the lowest and from the highest state
at once tells whether it forgets its input: if both ends meet, the segment is a
constant and its events are dropped before the per-cell shuffle. Votes shrink to
runs of equal labels. Both reductions are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxhive.functions.cells import voxel_index
from voxhive.operators import rayfold
from voxhive.operators.blocks import BLOCK_COLS
from voxhive.operators.voxels import XYZ
from voxhive.session import spread

# Evidence weights and thresholds (log-odds).
L_HIT, L_MISS = 0.85, -0.4
L_MIN, L_MAX = -2.0, 3.5
OCC_THR, FREE_THR = 0.85, -0.4
COUNT_MAX, RGB_COUNT_MAX = 65535, 255
FREE_MARGIN_M = 0.10
SEGMENT = 1024
#: Ray pieces of one block that a single task may fold.
CROWD = 5_000_000

OBS_SCHEMA = (
    "x bigint, y bigint, z bigint, logodds float, sem_label int, sem_count int, "
    "r int, g int, b int, rgb_count int"
)


def _f32(value: float) -> Column:
    return F.lit(value).cast("float")


def ray_cells(points: DataFrame, voxel_size: float, margin: float = FREE_MARGIN_M,
              keep: tuple[str, ...] = ("frame_seq",)) -> DataFrame:
    """Cells a ray passes before its surface, sampled every voxel length."""
    vs = F.lit(float(voxel_size))
    d = {a: F.col(f"p{a}") - F.col(f"o{a}") for a in XYZ}
    length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    rays = points.withColumn("len", length).where(F.col("len") > margin)
    last = F.ceil((F.col("len") - margin) / vs).cast("int")
    steps = rays.withColumn("s", F.explode(F.sequence(F.lit(0), last)))
    steps = steps.where(F.col("s") * vs < F.col("len") - margin)
    at = [
        voxel_index(F.col(f"o{a}") + F.col("s") * vs * (d[a] / F.col("len")), voxel_size).alias(a)
        for a in XYZ
    ]
    return steps.select(*keep, *at)


def hit_cells(points: DataFrame, voxel_size: float, margin: float = FREE_MARGIN_M) -> DataFrame:
    """Endpoint cells of the rays longer than the margin, other columns kept."""
    d = [F.col(f"p{a}") - F.col(f"o{a}") for a in XYZ]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    cells = {a: voxel_index(F.col(f"p{a}"), voxel_size) for a in XYZ}
    return points.where(length > margin).withColumns(cells)


def carve_free(points: DataFrame, voxel_size: float, margin: float = FREE_MARGIN_M) -> DataFrame:
    """Observed-free mask: every cell some ray passed through."""
    return ray_cells(points, voxel_size, margin).select(*XYZ).distinct()


def frame_evidence(points: DataFrame, voxel_size: float, margin: float = FREE_MARGIN_M) -> DataFrame:
    """One row per (frame, cell): crossed and/or hit, and the frame's mean colour.

    Plain hash aggregates only, so repeated samples collapse map-side.
    """
    coloured = "r" in points.columns
    none = F.lit(None).cast("double")
    miss = ray_cells(points, voxel_size, margin).select(
        "frame_seq", *XYZ, F.lit(1).alias("miss"), F.lit(0).alias("hit"), *[none.alias(c) for c in "rgb"])
    hit = hit_cells(points, voxel_size, margin).select(
        "frame_seq", *XYZ, F.lit(0).alias("miss"), F.lit(1).alias("hit"),
        *[(F.col(c).cast("double") if coloured else none).alias(c) for c in "rgb"])
    return miss.union(hit).groupBy("frame_seq", *XYZ).agg(
        F.max("miss").alias("miss"), F.max("hit").alias("hit"), *[F.avg(c).alias(c) for c in "rgb"])


def frame_votes(points: DataFrame, voxel_size: float, margin: float = FREE_MARGIN_M) -> DataFrame:
    """Label votes of the hit points; label 0 does not vote."""
    return hit_cells(points.where("label <> 0"), voxel_size, margin).select(
        "frame_seq", F.col("row_seq").cast("bigint").alias("row_seq"), *XYZ, F.col("label").cast("int").alias("label"))


def _step(state: Column, event: Column) -> Column:
    """One frame: add miss, then hit, in single precision, then clamp."""
    lowered = F.when(event["miss"] == 1, (state + _f32(L_MISS)).cast("float")).otherwise(state)
    raised = F.when(event["hit"] == 1, (lowered + _f32(L_HIT)).cast("float")).otherwise(lowered)
    return F.least(_f32(L_MAX), F.greatest(_f32(L_MIN), raised))


def _fold(start: Column, events: Column) -> Column:
    return F.aggregate(events, start, _step)


def label_runs(labels: Column) -> Column:
    """Array of labels to array of (label, n) runs."""
    n = F.size(labels)
    starts = F.filter(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (F.get(labels, i) != F.get(labels, i - 1)),
    )
    return F.transform(
        starts,
        lambda at, j: F.struct(
            F.get(labels, at).alias("label"),
            (F.coalesce(F.get(starts, j + 1), n) - at).alias("n"),
        ),
    )


def _vote(state: Column, run: Column) -> Column:
    """Streaming majority over a run of equal votes."""
    label, n, cur, cnt = run["label"], run["n"], state["label"], state["count"]
    same = cur == label
    over = n > cnt
    return F.struct(
        F.when(~same & over, label).otherwise(cur).alias("label"),
        F.least(
            F.lit(COUNT_MAX),
            F.when(same, cnt + n).when(over, n - cnt).otherwise(cnt - n),
        ).cast("int").alias("count"),
    )


def majority_fold(label: Column, count: Column, runs: Column) -> Column:
    start = F.struct(label.cast("int").alias("label"), count.cast("int").alias("count"))
    return F.aggregate(runs, start, _vote)


def _blend(state: Column, mean: Column) -> Column:
    n = state["n"].cast("double") + F.lit(1.0)
    def channel(c: str) -> Column:
        cur = state[c].cast("double")
        moved = F.rint(cur + (mean[c] - cur) / n)
        return F.least(F.lit(255.0), F.greatest(F.lit(0.0), moved)).cast("int").alias(c)
    return F.struct(
        channel("r"), channel("g"), channel("b"),
        F.least(F.lit(RGB_COUNT_MAX), state["n"] + 1).cast("int").alias("n"),
    )


def colour_fold(start: Column, means: Column) -> Column:
    """Running mean colour, rounded half-even after every frame."""
    return F.aggregate(means, start, _blend)


def integrate_frames(
    points: DataFrame,
    voxel_size: float,
    margin: float = FREE_MARGIN_M,
    prior: DataFrame | None = None,
    segment: int = SEGMENT,
) -> DataFrame:
    """Fold measured points into the observation map (schema ``OBS_SCHEMA``).

    ``prior`` is the map to continue from.  Blocks fold whole histories by arrays
    (``rayfold``) unless one of them is crossed by more than ``CROWD`` ray pieces;
    then every cell folds its history in segments.
    """
    pieces = rayfold.ray_pieces(points, voxel_size, margin)
    part = F.floor(F.col("frame_seq") / segment)
    blocks = pieces.groupBy(*BLOCK_COLS).agg(F.count(F.lit(1)).alias("n"), F.min(part).alias("low"), F.max(part).alias("high"))
    crowd, low, high = blocks.agg(F.max("n"), F.min("low"), F.max("high")).first()
    if (crowd or 0) <= CROWD:
        task = rayfold.folder(voxel_size, margin, L_MISS, L_HIT, L_MIN, L_MAX, COUNT_MAX, RGB_COUNT_MAX,
                              apart=prior is None and low == high)
        dealt = spread(rayfold.with_prior(pieces, prior), *BLOCK_COLS).sortWithinPartitions(*BLOCK_COLS)
        return dealt.mapInArrow(task, OBS_SCHEMA)
    votes = frame_votes(points, voxel_size, margin) if "label" in points.columns else None
    return fold_evidence(frame_evidence(points, voxel_size, margin), votes, prior, segment, low == high)


def fold_evidence(
    evidence: DataFrame, votes: DataFrame | None = None, prior: DataFrame | None = None,
    segment: int = SEGMENT, one_segment: bool = False,
) -> DataFrame:
    """Fold per-frame evidence and votes, in frame order.

    ``one_segment`` says that all frames share a segment, which saves the second
    grouping.
    """
    event = F.struct("frame_seq", "miss", "hit", "r", "g", "b")
    vote = F.struct("frame_seq", "row_seq", "label")
    part = F.floor(F.col("frame_seq") / segment).alias("segment")
    rows = evidence.select(*XYZ, part, event.alias("event"))
    if votes is not None:
        rows = rows.unionByName(votes.select(*XYZ, part, vote.alias("vote")), allowMissingColumns=True)
    else:
        rows = rows.withColumn("vote", F.lit(None).cast("struct<frame_seq:bigint,row_seq:bigint,label:int>"))
    history = rows.groupBy(*XYZ, "segment").agg(
        F.sort_array(F.collect_list("event")).alias("h"), F.sort_array(F.collect_list("vote")).alias("v"))
    low, high = _fold(_f32(L_MIN), F.col("h")), _fold(_f32(L_MAX), F.col("h"))
    summary = history.select(
        *XYZ, "segment", low.alias("low"), high.alias("high"),
        F.transform("h", lambda e: F.struct(e["miss"].alias("miss"), e["hit"].alias("hit"))).alias("events"),
        F.transform("v", lambda v: v["label"]).alias("labels"),
        F.transform(
            F.filter("h", lambda e: e["r"].isNotNull()),
            lambda e: F.struct(e["r"].alias("r"), e["g"].alias("g"), e["b"].alias("b")),
        ).alias("means"),
    ).select(
        *XYZ, "segment", label_runs(F.col("labels")).alias("runs"), "means",
        F.when(F.col("low") == F.col("high"), F.col("low")).alias("settled"),
        F.when(F.col("low") != F.col("high"), F.col("events")).alias("events"),
    )
    record = F.struct("segment", "settled", "events", "runs", "means")
    if one_segment:
        merged = summary.select(*XYZ, F.array(record).alias("s"))
    else:
        merged = summary.groupBy(*XYZ).agg(F.sort_array(F.collect_list(record)).alias("s"))
    if prior is None:
        state = merged.select("*", *[F.lit(0).alias(f"q_{c}") for c in ("sem_label", "sem_count", "r", "g", "b", "rgb_count")],
                              _f32(0.0).alias("q_logodds"))
    else:
        renamed = prior.select(*XYZ, *[F.col(c).alias(f"q_{c}") for c in prior.columns if c not in XYZ])
        state = merged.join(renamed, XYZ, "full")
        for c in ("sem_label", "sem_count", "r", "g", "b", "rgb_count"):
            state = state.withColumn(f"q_{c}", F.coalesce(f"q_{c}", F.lit(0)))
        state = state.withColumn("q_logodds", F.coalesce("q_logodds", _f32(0.0)))
        empty = F.array().cast(merged.schema["s"].dataType)
        state = state.withColumn("s", F.coalesce("s", empty))
    logodds = F.aggregate(
        "s", F.col("q_logodds").cast("float"),
        lambda acc, seg: F.when(seg["settled"].isNotNull(), seg["settled"]).otherwise(
            _fold(acc, F.coalesce(seg["events"], F.array().cast("array<struct<miss:int,hit:int>>")))
        ),
    )
    vote = majority_fold(
        F.col("q_sem_label"), F.col("q_sem_count"),
        F.flatten(F.transform("s", lambda seg: seg["runs"])),
    )
    start = F.struct(*[F.col(f"q_{c}").cast("int").alias(c) for c in "rgb"], F.col("q_rgb_count").cast("int").alias("n"))
    colour = colour_fold(start, F.flatten(F.transform("s", lambda seg: seg["means"])))
    return state.select(*XYZ, logodds.alias("logodds"), vote.alias("v"), colour.alias("c")).select(
        *XYZ, "logodds",
        F.col("v.label").alias("sem_label"), F.col("v.count").alias("sem_count"),
        F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b"),
        F.col("c.n").alias("rgb_count"),
    )


def is_occupied(col: str = "logodds") -> Column:
    return F.col(col) >= _f32(OCC_THR)


def is_free(col: str = "logodds") -> Column:
    return F.col(col) <= _f32(FREE_THR)


def occupied(obs: DataFrame) -> DataFrame:
    """Occupied cells with their label."""
    return obs.where(is_occupied()).select(*XYZ, F.col("sem_label").alias("label"))


def observed_free(obs: DataFrame) -> DataFrame:
    return obs.where(is_free()).select(*XYZ)


def cell_state(col: str = "logodds") -> Column:
    """occupied / free / unknown."""
    return F.when(is_occupied(col), F.lit("occupied")).when(is_free(col), F.lit("free")).otherwise(F.lit("unknown"))


def dirty_box(evidence: DataFrame) -> DataFrame:
    """Box of touched cells, max exclusive."""
    return evidence.agg(
        *[F.min(a).alias(f"{a}_min") for a in XYZ],
        *[(F.max(a) + 1).alias(f"{a}_max") for a in XYZ],
    )


def decouple(obs: DataFrame, mask: DataFrame | None = None, labels: tuple[int, ...] = ()) -> DataFrame:
    """Reset cells to unknown: those in ``mask``, or occupied ones with given labels."""
    if mask is not None:
        return obs.join(mask.select(*XYZ), XYZ, "left_anti")
    return obs.where(~(is_occupied() & F.col("sem_label").isin(*labels)))


def tri_state_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy(cell_state().alias("state")).agg(F.count(F.lit(1)).alias("cells"))
