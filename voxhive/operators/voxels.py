"""Set, aggregate and stencil operators over voxel tables.

Neighbour access is always "explode a fixed offset list, then group or equi-join
on the shifted index"; nothing here is a range join or a per-row Python call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxhive.functions.cells import (
    AXES, FACES, ball_offsets, chunk_of, floor_div, last_first, local_of, offset_array, voxel_index,
)
from voxhive.operators.cluster import CORNER, FACE, label_components
from voxhive.operators.holes import filled_cells
from voxhive.session import by_sorting, cut, spread

XYZ = list(AXES)
CHUNK = ["cx", "cy", "cz"]
LOCAL = ["lx", "ly", "lz"]


# ---------------------------------------------------------------- projections
def voxelize(points: DataFrame, voxel_size: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metric points to distinct cells."""
    cells = points.select(*[voxel_index(a, voxel_size).alias(a) for a in XYZ], *keep)
    return cells.distinct()


def add_chunk(cells: DataFrame, extent: int) -> DataFrame:
    """Chunk coordinate and position inside the chunk."""
    return cells.withColumns(
        {**{c: chunk_of(a, extent) for c, a in zip(CHUNK, XYZ)},
         **{l: local_of(a, extent) for l, a in zip(LOCAL, XYZ)}}
    )


def chunk_bounds(cells: DataFrame, extent: int) -> DataFrame:
    """Chunk-space bounds, max exclusive."""
    chunks = cells.select(*[chunk_of(a, extent).alias(c) for c, a in zip(CHUNK, XYZ)])
    return chunks.agg(
        *[F.min(c).alias(f"{c}_min") for c in CHUNK],
        *[(F.max(c) + 1).alias(f"{c}_max") for c in CHUNK],
    )


def bounds(cells: DataFrame, pad: int = 0, group: tuple[str, ...] = ()) -> DataFrame:
    """Tight inclusive bounding box, one row (per group)."""
    aggs = [(F.min(a) - pad).alias(f"{a}_lo") for a in XYZ]
    aggs += [(F.max(a) + pad).alias(f"{a}_hi") for a in XYZ]
    return cells.groupBy(*group).agg(*aggs) if group else cells.agg(*aggs)


def clip(cells: DataFrame, box: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Keep cells inside the box (a single row, or one row per group)."""
    inside = F.lit(True)
    for a in XYZ:
        inside = inside & F.col(a).between(F.col(f"{a}_lo"), F.col(f"{a}_hi"))
    joined = cells.join(box, list(group)) if group else cells.crossJoin(F.broadcast(box))
    return joined.where(inside).select(cells.columns)


def dense_box(box: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Every cell of a one-row box, but those of ``without``. Planes are spread over tasks before the fill.

    Cells to leave out meet the lines (x, y) of the box; a line is filled after that, so its cells are never shuffled.
    """
    planes = box.select("*", F.explode(F.sequence("x_lo", "x_hi")).alias("x"))
    rows = planes.repartition("x").select("x", F.explode(F.sequence("y_lo", "y_hi")).alias("y"), F.sequence("z_lo", "z_hi").alias("line"))
    if without is not None:
        taken = without.groupBy("x", "y").agg(F.collect_set("z").alias("taken"))
        rows = spread(rows, "x", "y").join(by_sorting(taken), ["x", "y"], "left")
        rows = rows.withColumn("line", F.when(F.col("taken").isNull(), F.col("line")).otherwise(F.array_except("line", "taken")))
    return rows.select("x", "y", F.explode("line").alias("z"))


def box_difference(cells: DataFrame, lo: tuple, hi: tuple, fresh: DataFrame) -> DataFrame:
    """Replace a region: cells outside [lo, hi) stay, inside comes from ``fresh``."""
    inside = F.lit(True)
    for a, low, high in zip(XYZ, lo, hi):
        inside = inside & (F.col(a) >= low) & (F.col(a) < high)
    return cells.where(~inside).unionByName(fresh.where(inside))


# ---------------------------------------------------------------- aggregates
def count_then_vote(observations: DataFrame, frame: str, label: str = "label") -> DataFrame:
    """Majority label per cell over frames, ties to the smallest label.

    One vote per (frame, cell, label); ``total`` is the number of votes.
    """
    votes = observations.select(frame, *XYZ, label).distinct()
    counted = votes.groupBy(*XYZ, label).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*XYZ).agg(
        F.max_by(F.col(label), F.struct(F.col("n"), -F.col(label))).alias(label),
        F.sum("n").alias("total"),
    )


def drop_unseen(cells: DataFrame, min_observations: int, label: str = "label") -> DataFrame:
    """Drop unknown labels and cells seen too rarely."""
    kept = cells.where(F.col(label) != 0)
    return kept.where(F.col("total") >= min_observations) if min_observations > 1 else kept


def histogram(cells: DataFrame, col: str) -> DataFrame:
    return cells.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def mean_per_cell(points: DataFrame, voxel_size: float) -> DataFrame:
    """Voxel-grid downsampling: mean position of the points of each cell."""
    keyed = points.select(*XYZ, *[voxel_index(a, voxel_size).alias(f"c{a}") for a in XYZ])
    return keyed.groupBy("cx", "cy", "cz").agg(
        *[F.avg(a).alias(f"m{a}") for a in XYZ], F.count(F.lit(1)).alias("n")
    )


def coarsen(cells: DataFrame, factor: int, min_fine: int = 1, label: str = "label") -> DataFrame:
    """Coarse blocks: occupied from ``min_fine`` cells on, majority non-zero label.

    World indices make the block grid align by itself. Ties go to the smallest label.
    """
    block = cells.select(
        *[floor_div(a, factor).alias(a) for a in XYZ], F.col(label).alias("label")
    )
    counted = block.groupBy(*XYZ, "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(
        F.when(F.col("label") != 0, F.col("label")),
        F.when(F.col("label") != 0, F.struct(F.col("n"), -F.col("label"))),
    )
    merged = counted.groupBy(*XYZ).agg(
        F.sum("n").alias("fine"), F.coalesce(best, F.lit(0)).alias(label)
    )
    return merged.where(F.col("fine") >= min_fine)


def lod_factor(cells: DataFrame, cap: int, highest: int = 16) -> int:
    """Smallest integer factor that brings the cell count under ``cap``."""
    n, lod = cells.count(), 1
    while n > cap * lod**3 and lod < highest:
        lod += 1
    return lod


def lod_cells(cells: DataFrame, lod: int, value: str, order: Column) -> DataFrame:
    """Coarse display cells that take the value of their first member."""
    block = cells.select(*[floor_div(a, lod).alias(f"c{a}") for a in XYZ], value, order.alias("_o"))
    return block.groupBy("cx", "cy", "cz").agg(F.min_by(value, "_o").alias(value))


def group_extent(cells: DataFrame, *group: str) -> DataFrame:
    """Count, centroid and inclusive box per group."""
    return cells.groupBy(*group).agg(
        F.count(F.lit(1)).alias("voxel_count"),
        *[F.avg(a).alias(f"mean_{a}") for a in XYZ],
        *[F.min(a).alias(f"min_{a}") for a in XYZ],
        *[F.max(a).alias(f"max_{a}") for a in XYZ],
    )


# ---------------------------------------------------------------- neighbours
def shifted(cells: DataFrame, offsets=FACES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (cell, offset) at the shifted position."""
    spread = cells.select(*XYZ, *keep, F.explode(offset_array(offsets)).alias("o"))
    moved = [(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in XYZ]
    return spread.select(*moved, *keep)


def neighbour_counts(cells: DataFrame, offsets=FACES) -> DataFrame:
    """Occupied neighbours of every touched position, with a membership flag.

    A single grouped aggregate, no join. Rows are dealt by position first: an aggregate
    before the shuffle would hold all touched positions of its task in memory.
    """
    touch = F.concat(F.array(F.struct(*[F.lit(0).alias(f"d{a}") for a in XYZ], F.lit(0).alias("n"))), F.transform(
        offset_array(offsets), lambda o: F.struct(*[o[f"d{a}"].alias(f"d{a}") for a in XYZ], F.lit(1).alias("n"))))
    rows = cells.select(*XYZ, F.explode(touch).alias("o")).select(
        *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in XYZ], F.col("o.n").alias("n"))
    return spread(rows, *XYZ).groupBy(*XYZ).agg(
        F.sum("n").alias("neighbours"), F.max(1 - F.col("n")).alias("occupied")
    )


def exposed_faces(cells: DataFrame) -> DataFrame:
    """One row per cell face whose neighbour is absent."""
    faces = cells.select(*XYZ, F.explode(offset_array(FACES)).alias("o"))
    placed = faces.select(*XYZ, *[F.col(f"o.d{a}").alias(f"d{a}") for a in XYZ])
    other = cells.select(*[F.col(a).alias(f"n{a}") for a in XYZ])
    match = [F.col(a) + F.col(f"d{a}") == F.col(f"n{a}") for a in XYZ]
    return placed.join(other, match, "left_anti")


def dilate(cells: DataFrame, steps: int, offsets=FACES, box=None, group=()) -> DataFrame:
    out = cells.select(*group, *XYZ).distinct()
    for _ in range(steps):
        grown = out.union(shifted(out, offsets, tuple(group)).select(*group, *XYZ)).distinct()
        out = clip(grown, box, group) if box is not None else grown
    return out


def erode(cells: DataFrame, steps: int, offsets=FACES, group=()) -> DataFrame:
    """Keep cells whose whole neighbourhood is present (outside counts as empty)."""
    out = cells
    for _ in range(steps):
        votes = out.select(*group, *XYZ).union(shifted(out, offsets, tuple(group)).select(*group, *XYZ))
        out = (
            votes.groupBy(*group, *XYZ).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == len(offsets) + 1).drop("n")
        )
    return out


def closing(cells: DataFrame, steps: int, offsets=FACES, box=None, group=()) -> DataFrame:
    """Binary closing; with a box, growth stops at it and its rim erodes."""
    return erode(dilate(cells, steps, offsets, box, group), steps, offsets, group)


def nearest_value(queries: DataFrame, cells: DataFrame, value: str, radius: int) -> DataFrame:
    """Value of the closest cell within ``radius``; ties to the first in scan order."""
    probes = queries.select(*XYZ, F.explode(offset_array(ball_offsets(radius * radius, True))).alias("o"))
    at = probes.select(
        *[F.col(a).alias(f"q{a}") for a in XYZ],
        *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in XYZ],
        (F.col("o.dx") ** 2 + F.col("o.dy") ** 2 + F.col("o.dz") ** 2).alias("d2"),
    )
    found = at.join(by_sorting(cells.select(*XYZ, value)), XYZ)
    best = found.groupBy("qx", "qy", "qz").agg(
        F.min_by(value, F.struct("d2", *XYZ)).alias(value)
    )
    return best.select(*[F.col(f"q{a}").alias(a) for a in XYZ], value)


def close_holes(cells: DataFrame, iterations: int = 1, label: str = "label") -> DataFrame:
    """Fill small holes; new cells inherit the nearest existing label."""
    if iterations <= 0:
        return cells
    cells = cut(cells.select(*XYZ, label))
    filled = filled_cells(cells, label, iterations, bounds(cells).first())
    return cells.select(*XYZ, label, F.lit(False).alias("filled")).union(
        filled.select(*[F.col(a).cast(cells.schema[a].dataType).alias(a) for a in XYZ], label, F.lit(True).alias("filled"))
    )


def prune_dangles(cells: DataFrame, iterations: int = 2, label: str = "label") -> DataFrame:
    """Repeatedly drop cells with at most one face neighbour."""
    out = cut(cells.select(*XYZ, label))
    for _ in range(iterations):
        firm = neighbour_counts(out).where("occupied = 1 AND neighbours > 1").select(*XYZ)
        out = out.join(firm, XYZ, "left_semi")
    return out


def drop_small_components(
    cells: DataFrame, min_size: int, connectivity: int = CORNER
) -> DataFrame:
    """Remove connected components below ``min_size`` cells."""
    if min_size <= 1:
        return cells
    labelled = cut(label_components(cells, connectivity))
    big = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    keep = labelled.join(big, "component", "left_semi").select(*XYZ)
    return cells.join(keep, XYZ, "left_semi")


def keep_largest_component(cells: DataFrame, connectivity: int = FACE) -> DataFrame:
    """Only the biggest component; ties go to the one met first in scan order."""
    labelled = cut(label_components(cells, connectivity))
    best = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("component", F.struct("n", *last_first(*[f"component.{a}" for a in AXES]))).alias("component")
    )
    keep = labelled.join(F.broadcast(best), "component", "left_semi").select(*XYZ)
    return cells.join(keep, XYZ, "left_semi")


def clean_coarse(
    cells: DataFrame, min_component: int = 2, close_radius: int = 1, keep_largest: bool = False,
    label: str = "label", box: DataFrame | None = None,
) -> DataFrame:
    """Close holes, drop specks, optionally keep the main body only.

    ``box`` is the grid the map lives on. Closing erodes against it, so cells on
    its rim survive only when closing added nothing.
    """
    out = cut(cells.select(*XYZ, label))
    if close_radius > 0:
        grid = box if box is not None else bounds(out)
        closed = cut(closing(out, close_radius, FACES, grid))
        fresh = closed.join(out, XYZ, "left_anti")
        filled = nearest_value(fresh, out, label, close_radius)
        added = filled.agg(F.count(F.lit(1)).alias("added"))
        kept = (
            out.join(closed.withColumn("_in", F.lit(True)), XYZ, "left")
            .crossJoin(F.broadcast(added))
            .where("_in OR added = 0")
            .select(*XYZ, label)
        )
        out = cut(kept.union(filled.select(*XYZ, label)))
    if min_component > 1:
        out = drop_small_components(out, min_component, FACE)
    return keep_largest_component(out, FACE) if keep_largest else out


def flood(free: DataFrame, seed: tuple[int, int, int]) -> DataFrame:
    """Face-connected region of ``free`` that contains ``seed``."""
    labelled = label_components(free, FACE)
    here = labelled.where(
        (F.col("x") == seed[0]) & (F.col("y") == seed[1]) & (F.col("z") == seed[2])
    ).select("component")
    if here.isEmpty():
        raise ValueError(f"seed {seed} is not a free cell")
    return labelled.join(F.broadcast(here), "component", "left_semi").select(*XYZ)


def fill_holes_2d(cells: DataFrame, group: tuple[str, ...], a: str, b: str) -> DataFrame:
    """Cells enclosed by a planar footprint: empty face-components off the rim.

    Returns the hole cells only, per group.
    """
    names = [f"p{i}" for i in range(len(group))]
    keyed = cut(cells.select(
        *[F.col(g).alias(n) for g, n in zip(group, names)], F.col(a).cast("bigint").alias("x"),
        F.col(b).cast("bigint").alias("y")).distinct())
    box = keyed.groupBy(*names).agg(
        F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
        F.min("y").alias("y_lo"), F.max("y").alias("y_hi"),
    )
    # occupied cells meet the lines of the area, which are filled after that: its cells are not shuffled for it
    lines = spread(box.withColumn("x", F.explode(F.sequence("x_lo", "x_hi"))), *names, "x").join(
        by_sorting(keyed.groupBy(*names, "x").agg(F.collect_set("y").alias("taken"))), [*names, "x"], "left")
    line = F.sequence("y_lo", "y_hi")
    rest = F.when(F.col("taken").isNull(), line).otherwise(F.array_except(line, "taken"))
    # the plane lies inside a layer of blocks: at its edge, every cell would go to two of them
    area = lines.withColumn("y", F.explode(rest)).withColumn("z", F.lit(1).cast("bigint"))
    empty = cut(area.select(*names, *XYZ, F.expr("x = x_lo OR x = x_hi OR y = y_lo OR y = y_hi").alias("at_rim")))
    parts = cut(label_components(empty, FACE, tuple(names)))
    rim = empty.where("at_rim").select(*names, *XYZ)
    open_parts = parts.join(by_sorting(rim), [*names, *XYZ], "left_semi").select(*names, "component").distinct()
    holes = parts.join(open_parts, [*names, "component"], "left_anti")
    return holes.select(*[F.col(n).alias(g) for g, n in zip(group, names)], F.col("x").alias(a), F.col("y").alias(b))


# ---------------------------------------------------------------- runs, rays, edits
def rle_runs(cells: DataFrame, extent: int, value: str = "value") -> DataFrame:
    """Run-length encoding of each chunk in scan order, air included, runs <= 255.

    Cells are dealt to tasks by chunk once, all further steps stay there. Windows hold one
    chunk's cells, at most ``extent``^3.
    """
    total = extent**3
    placed = add_chunk(cells.where(F.col(value) != 0), extent).select(
        *CHUNK, ((F.col("lx") * extent + F.col("ly")) * extent + F.col("lz")).alias("pos"), value
    )
    w = Window.partitionBy(*CHUNK).orderBy("pos")
    starts = spread(placed, *CHUNK).withColumn(
        "new", F.when(
            (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag(value).over(w) == F.col(value)), 0
        ).otherwise(1)
    ).withColumn("run", F.sum("new").over(w))
    solid = starts.groupBy(*CHUNK, "run").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("length"), F.first(value).alias(value)
    )
    solid = solid.withColumns({"next": F.coalesce(F.lead("pos").over(w), F.lit(total)), "turn": F.row_number().over(w)})
    air = F.lit(0).cast(cells.schema[value].dataType).alias(value)
    run = lambda start, length, what: F.struct(start.cast("bigint").alias("start"), length.cast("bigint").alias("length"), what)
    end = F.col("pos") + F.col("length")
    before = F.when(F.col("turn") == 1, F.col("pos")).otherwise(0)
    parts = F.array(run(F.lit(0), before, air), run(F.col("pos"), F.col("length"), F.col(value)), run(end, F.col("next") - end, air))
    runs = solid.select(*CHUNK, F.explode(parts).alias("r")).select(*CHUNK, "r.*").where("length > 0")
    pieces = runs.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / 255) - 1)))
    return pieces.select(
        *CHUNK, (F.col("start") + F.col("k") * 255).alias("start"),
        F.least(F.lit(255), F.col("length") - F.col("k") * 255).cast("int").alias("length"), value,
    )


def march_rays(rays: DataFrame, cells: DataFrame, voxel_size: float, max_distance: float) -> DataFrame:
    """First occupied cell along each ray, and the last empty cell before it.

    ``rays``: ray_id, ox, oy, oz, dx, dy, dz. Half-voxel steps, rounded indices.
    """
    step = max(0.0001, voxel_size * 0.5)
    n_steps = int(-(-max_distance // step))
    norm = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    samples = rays.where(norm > 1e-6).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_steps))))
    inv = 1.0 / voxel_size
    for a in XYZ:
        p = F.col(f"o{a}") + F.col(f"d{a}") / norm * (F.col("s") * F.lit(step))
        # the editor rounds halves away from zero
        samples = samples.withColumn(a, F.round(p * F.lit(inv)).cast("bigint"))
    visited = samples.groupBy("ray_id", *XYZ).agg(F.min("s").alias("s"))
    hit = cells.select(*XYZ).distinct().withColumn("occ", F.lit(True))
    marked = visited.join(by_sorting(hit), XYZ, "left")
    first = marked.groupBy("ray_id").agg(F.min(F.when(F.col("occ"), F.col("s"))).alias("hit_s"))
    path = marked.join(by_sorting(first.where("hit_s IS NOT NULL")), "ray_id").where("s <= hit_s")
    spot = F.struct(*XYZ)
    return path.groupBy("ray_id").agg(
        F.min_by(spot, F.col("s") != F.col("hit_s")).alias("hit"),
        F.max_by(spot, F.when(F.col("s") < F.col("hit_s"), F.col("s"))).alias("prev"),
    ).select(
        "ray_id", *[F.col(f"hit.{a}").alias(f"hit_{a}") for a in XYZ],
        *[F.coalesce(F.col(f"prev.{a}"), F.col(f"hit.{a}")).alias(f"prev_{a}") for a in XYZ],
    )


def stamp(cells: DataFrame, marks: DataFrame) -> DataFrame:
    """Overwrite cells: marks win, everything else stays."""
    return cells.join(marks.select(*XYZ), XYZ, "left_anti").unionByName(marks, allowMissingColumns=True)


def marker_cells(nodes: DataFrame, radius: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cubes of cells around node positions."""
    span = range(-radius, radius + 1)
    cube = [(i, j, k) for i in span for j in span for k in span]
    return shifted(nodes, cube, keep).distinct()


def apply_edits(cells: DataFrame, edits: DataFrame, value_cols: list[str], seq: str = "seq") -> DataFrame:
    """Last write wins per cell; writing material 0 clears the cell."""
    last = edits.groupBy(*XYZ).agg(F.max_by(F.struct(*value_cols), seq).alias("v"))
    new = last.select(*XYZ, *[F.col(f"v.{c}").alias(c) for c in value_cols])
    return (
        cells.join(new.select(*XYZ), XYZ, "left_anti").select(*XYZ, *value_cols)
        .union(new.where(F.col(value_cols[0]) != 0))
    )


def undo_edits(edits: DataFrame, undone: DataFrame, seq: str = "seq") -> DataFrame:
    """Compensating records for the edits named in ``undone`` (seq, undo_seq).

    Restores material 1 for a destroyed voxel, as the editor does, and clears a
    placed one.
    """
    hit = edits.join(undone, seq)
    restored = F.when(F.col("material_id") == 0, F.lit(1)).otherwise(F.lit(0))
    return hit.select(
        F.col("undo_seq").alias(seq), *XYZ, restored.cast("smallint").alias("material_id"),
        F.lit(0).cast("smallint").alias("semantic_id"),
    )


def dirty_chunks(edits: DataFrame, extent: int) -> DataFrame:
    """Chunks an edit log touches: the partitions an incremental save rewrites."""
    return edits.select(*[chunk_of(a, extent).alias(c) for c, a in zip(CHUNK, XYZ)]).distinct()


# ---------------------------------------------------------------- standing room
def headroom_cells(floor: DataFrame, occupied: DataFrame, cells_above: int) -> DataFrame:
    """Floor cells with nothing occupied in the column of ``cells_above`` over them.

    One sort per (x, z) column, whose length is bounded by the map's height.
    """
    marked = occupied.select(*XYZ, F.lit(0).alias("f")).union(floor.select(*XYZ, F.lit(1).alias("f")))
    column = marked.groupBy(*XYZ).agg(F.max("f").alias("f"))
    above = F.lead("y").over(Window.partitionBy("x", "z").orderBy("y"))
    room = column.withColumn("next_y", above).where("f = 1")
    return room.where(F.col("next_y").isNull() | (F.col("next_y") > F.col("y") + cells_above)).select(*XYZ)


def spawn_hint(cells: DataFrame, voxel_size: float, floor_label: int = 3, label: str = "label") -> DataFrame:
    """Standing point nearest the floor's centroid with 2.5 m of air above it."""
    floor = cells.where(F.col(label) == floor_label).select(*XYZ).distinct()
    rise = max(2, int(round(2.5 / voxel_size)))
    open_floor = headroom_cells(floor, cells.select(*XYZ).distinct(), rise)
    mid = floor.agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"))
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("z") - F.col("mz")) ** 2
    best = (
        open_floor.crossJoin(F.broadcast(mid))
        .agg(F.min_by(F.struct(*XYZ, "mx", "mz"), F.struct(d2, *XYZ)).alias("b"))
        .where("b IS NOT NULL")
    )
    sx = (F.col("b.x") + 0.5) * voxel_size
    sy = (F.col("b.y") + 1) * voxel_size + 1.0
    sz = (F.col("b.z") + 0.5) * voxel_size
    yaw = F.degrees(F.atan2(F.col("b.mx") * voxel_size - sx, -(F.col("b.mz") * voxel_size - sz)))
    return best.select(
        F.bround(sx, 3).alias("spawn_x"), F.bround(sy, 3).alias("spawn_y"),
        F.bround(sz, 3).alias("spawn_z"), F.bround(yaw, 1).alias("yaw_deg"),
    )


def standable_spot(cells: DataFrame, voxel_size: float, head_m: float = 1.8) -> DataFrame:
    """Viewer variant: lowest standable cell of the column nearest the centroid."""
    occ = cells.select(*XYZ).distinct()
    head = int(-(-head_m // voxel_size))
    mid = occ.agg(F.round(F.avg("x")).alias("mx"), F.round(F.avg("z")).alias("mz"))
    open_cells = headroom_cells(occ, occ, head)
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("z") - F.col("mz")) ** 2
    best = open_cells.crossJoin(F.broadcast(mid)).agg(
        F.min_by(F.struct(*XYZ), F.struct(d2, "x", "z", "y")).alias("b")
    )
    return best.select(*[F.col(f"b.{a}").alias(a) for a in XYZ])
