"""Object instances: clustering, de-fragmentation, descriptors, placement input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxhive.functions.cells import cell_id
from voxhive.functions.labels import (
    ENTITY_LABELS, ITEM_OF_LABEL, MODEL_LABELS, SMALL_OBJECT_LABELS, STRUCTURE_LABELS, WALL_LABEL,
    map_lookup, uuid_from,
)
from voxhive.operators.blocks import BLOCK_COLS, block_starts, min_label, whole_blocks, with_halo
from voxhive.operators.cluster import AT_ONCE, BORDER, CELL, CORNER, LINK, cluster_cells, joined_blocks, label_components, number_groups
from voxhive.operators.components import with_component
from voxhive.operators.voxels import XYZ, group_extent, shifted
from voxhive.session import by_sorting, cut, spread

BOX = [f"{side}_{a}" for side in ("min", "max") for a in XYZ]


# ---------------------------------------------------------------- box adjacency
def box_links(
    boxes: DataFrame, id_col: str, group_cols: list[str], gap: float, tile: float, strict_cells: bool = False
) -> DataFrame:
    """Pairs of same-group boxes whose axis gaps are all at most ``gap``.

    Boxes are spread over coarse tiles by their grown extent and meet only in the
    tile that holds the low corner of their overlap, so each pair appears once
    and no group is compared all against all. ``strict_cells`` counts the empty
    cells between integer boxes.
    """
    reach = gap + (1 if strict_cells else 0)
    sides = boxes.select(id_col, *group_cols, *BOX)
    tiles = sides
    for a in XYZ:
        lo = F.floor(F.col(f"min_{a}") / F.lit(tile)).cast("bigint")
        hi = F.floor((F.col(f"max_{a}") + F.lit(reach)) / F.lit(tile)).cast("bigint")
        tiles = tiles.withColumn(f"t{a}", F.explode(F.sequence(lo, hi)))
    left = tiles
    right = tiles.select(
        F.col(id_col).alias("other"), *group_cols, *[F.col(c).alias(f"o_{c}") for c in BOX], "tx", "ty", "tz"
    )
    near, home = F.lit(True), F.lit(True)
    for a in XYZ:
        near = near & (F.col(f"min_{a}") <= F.col(f"o_max_{a}") + F.lit(reach))
        near = near & (F.col(f"o_min_{a}") <= F.col(f"max_{a}") + F.lit(reach))
        corner = F.greatest(F.col(f"min_{a}"), F.col(f"o_min_{a}"))
        home = home & (F.floor(corner / F.lit(tile)).cast("bigint") == F.col(f"t{a}"))
    pairs = left.join(right, [*group_cols, "tx", "ty", "tz"]).where(
        (F.col(id_col) < F.col("other")) & near & home
    )
    return pairs.select(F.col(id_col).alias("src"), F.col("other").alias("dst"))


def merge_boxes_once(
    boxes: DataFrame, id_col: str, group_cols: list[str], gap: int, tile: float = 64.0, out: str = "merged"
) -> DataFrame:
    """(id, merged): union of clusters whose boxes lie within ``gap`` cells."""
    links = box_links(boxes, id_col, group_cols, gap, tile, strict_cells=True)
    return with_component(boxes.select(id_col), links, id_col, out=out)


def merge_boxes_until_stable(
    boxes: DataFrame, id_col: str, group_cols: list[str], gap: int, tile: float = 64.0
) -> DataFrame:
    """Like :func:`merge_boxes_once`, repeated with the grown boxes."""
    assign = cut(boxes.select(id_col, F.col(id_col).alias("merged")))
    live = cut(boxes.select(F.col(id_col).alias("merged"), *group_cols, *BOX))
    while True:
        step = cut(merge_boxes_once(live, "merged", group_cols, gap, tile, out="into"))
        if step.where("merged <> into").isEmpty():
            return assign
        assign = cut(assign.join(step, "merged").select(id_col, F.col("into").alias("merged")))
        live = cut(
            live.join(step, "merged").groupBy(F.col("into").alias("merged"), *group_cols).agg(
                *[F.min(c).alias(c) for c in BOX[:3]], *[F.max(c).alias(c) for c in BOX[3:]])
        )


# ---------------------------------------------------------------- descriptors
def _moments() -> list[Column]:
    """Second moments, combined map-side; only one row per object reaches Python."""
    return [F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]]


def shape_columns(moments: DataFrame, voxel_size: float) -> DataFrame:
    """Principal-axis standard deviations, longest first; zeros below 3 cells."""

    def solve(batches):
        for pdf in batches:
            m = np.empty((len(pdf), 3, 3))
            for i, a in enumerate(XYZ):
                for j, b in enumerate(XYZ):
                    m[:, i, j] = pdf[f"c{min(a, b)}{max(a, b)}"].fillna(0.0)
            dev = np.sqrt(np.clip(np.linalg.eigvalsh(m), 0, None))[:, ::-1] * voxel_size
            dev[pdf["voxel_count"].to_numpy() < 3] = 0.0
            out = pdf.drop(columns=[c for c in pdf.columns if c[0] == "c" and len(c) == 3])
            for i in range(3):
                out[f"shape_{i}"] = dev[:, i]
            yield out

    kept = [f for f in moments.schema.fields if not (f.name[0] == "c" and len(f.name) == 3)]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"shape_{i} double" for i in range(3)])
    return moments.mapInPandas(solve, schema=schema)


def shape_distance(a: list[str], b: list[str]) -> Column:
    return F.sqrt(sum(((F.col(p) - F.col(q)) ** 2 for p, q in zip(a[1:], b[1:])), (F.col(a[0]) - F.col(b[0])) ** 2))


def _flat_id(label: str, cluster: str) -> Column:
    return F.struct(F.col(label).alias("of"), *[F.col(f"{cluster}.{a}").alias(a) for a in XYZ])


def extract_objects(
    cells: DataFrame, voxel_size: float, structure: tuple[int, ...] = STRUCTURE_LABELS,
    min_voxels: int = 20, eps: float = 3.0, min_samples: int = 5, merge_gap: int = 2, label: str = "label",
) -> DataFrame:
    """Object instances per class: cluster, drop specks, merge near boxes, describe.

    Returns object_id (scan order of the first cell), label, centroid cell,
    inclusive box, voxel_count and shape.
    """
    candidates = cells.where((F.col(label) != 0) & ~F.col(label).isin(*structure)).select(*XYZ, label)
    clusters = cut(cluster_cells(candidates, eps, min_samples, (label,)).where("cluster IS NOT NULL"))
    boxes = group_extent(clusters, label, "cluster").where(F.col("voxel_count") >= min_voxels)
    boxes = cut(boxes.withColumn("cid", _flat_id(label, "cluster")))
    merged = merge_boxes_once(boxes, "cid", [label], merge_gap)
    owner = merged.select(cell_id(*[f"cid.{a}" for a in XYZ]).alias("cluster"), F.col("cid.of").alias(label),
                          cell_id(*[f"merged.{a}" for a in XYZ]).alias("object_key"))
    members = clusters.join(owner, [label, "cluster"])
    described = members.groupBy(label, "object_key").agg(
        F.count(F.lit(1)).alias("voxel_count"), *[F.avg(a).alias(f"mean_{a}") for a in XYZ],
        *[F.min(a).alias(f"min_{a}") for a in XYZ], *[F.max(a).alias(f"max_{a}") for a in XYZ], *_moments(),
    )
    shaped = shape_columns(described, voxel_size)
    placed = shaped.select(
        label, "object_key", "voxel_count",
        *[F.rint(f"mean_{a}").cast("bigint").alias(n) for a, n in zip(XYZ, "ijk")],
        *BOX, *[f"shape_{i}" for i in range(3)],
    )
    return number_groups(placed, [label, "object_key"], "object_id")


# ---------------------------------------------------------------- entities
def oriented_boxes(members: DataFrame, group_cols: list[str], voxel_size: float) -> DataFrame:
    """PCA box per group: centre, rotation (x, y, z, w) and extents.

    Covariances are plain aggregates; the 3x3 eigenproblem runs on one row per
    group; extents are a second aggregate in the rotated frame.
    """
    vs = float(voxel_size)
    metric = members.select(*group_cols, *[((F.col(a) + 0.5) * F.lit(vs)).alias(a) for a in XYZ])
    moments = metric.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("voxel_count"), *[F.avg(a).alias(f"mean_{a}") for a in XYZ], *_moments()
    ).where("voxel_count >= 3")

    def solve(batches):
        for pdf in batches:
            m = np.empty((len(pdf), 3, 3))
            for i, a in enumerate(XYZ):
                for j, b in enumerate(XYZ):
                    m[:, i, j] = pdf[f"c{min(a, b)}{max(a, b)}"]
            axes = np.linalg.eigh(m)[1][:, :, ::-1].copy()
            axes[np.linalg.det(axes) < 0, :, 2] *= -1
            out = pdf.drop(columns=[c for c in pdf.columns if c[0] == "c" and len(c) == 3])
            for i in range(3):
                for j in range(3):
                    out[f"e{i}{j}"] = axes[:, i, j]
            quat = np.array([_quaternion(a) for a in axes]).reshape(-1, 4)
            for j, q in enumerate(("qx", "qy", "qz", "qw")):
                out[q] = quat[:, j]
            yield out

    kept = [f for f in moments.schema.fields if not (f.name[0] == "c" and len(f.name) == 3)]
    names = [f"e{i}{j}" for i in range(3) for j in range(3)] + ["qx", "qy", "qz", "qw"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{n} double" for n in names])
    frames = cut(moments.mapInPandas(solve, schema=schema))
    rel = metric.join(frames, group_cols)
    local = rel.select(*group_cols, *[
        sum(((F.col(a) - F.col(f"mean_{a}")) * F.col(f"e{i}{j}") for i, a in enumerate(XYZ)), F.lit(0.0)).alias(f"l{j}")
        for j in range(3)
    ])
    span = local.groupBy(*group_cols).agg(
        *[F.min(f"l{j}").alias(f"lo{j}") for j in range(3)], *[F.max(f"l{j}").alias(f"hi{j}") for j in range(3)]
    )
    out = frames.join(span, group_cols)
    centre = [
        (F.col(f"mean_{a}") + sum((F.col(f"e{i}{j}") * (F.col(f"lo{j}") + F.col(f"hi{j}")) / 2 for j in range(3)), F.lit(0.0))).alias(f"pos_{a}")
        for i, a in enumerate(XYZ)
    ]
    dims = [(F.col(f"hi{j}") - F.col(f"lo{j}")).alias(f"dim_{j}") for j in range(3)]
    return out.select(*group_cols, "voxel_count", *centre, "qx", "qy", "qz", "qw", *dims)


def _quaternion(m: np.ndarray) -> np.ndarray:
    """Rotation matrix to unit quaternion (x, y, z, w), largest component first."""
    trace = np.array([m[0, 0] - m[1, 1] - m[2, 2], m[1, 1] - m[0, 0] - m[2, 2], m[2, 2] - m[0, 0] - m[1, 1], np.trace(m)])
    pair = np.array([
        [0.0, m[0, 1] + m[1, 0], m[0, 2] + m[2, 0], m[2, 1] - m[1, 2]],
        [m[0, 1] + m[1, 0], 0.0, m[1, 2] + m[2, 1], m[0, 2] - m[2, 0]],
        [m[0, 2] + m[2, 0], m[1, 2] + m[2, 1], 0.0, m[1, 0] - m[0, 1]],
        [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1], 0.0],
    ])
    lead = 3 if np.trace(m) > 0 else int(np.argmax(trace[:3]))
    q = pair[lead].copy()
    q[lead] = 1.0 + trace[lead]
    return q / np.linalg.norm(q)


def extract_entities(
    cells: DataFrame, voxel_size: float, labels: tuple[int, ...] = ENTITY_LABELS,
    eps: float = 2.0, min_samples: int = 10, label: str = "label",
) -> tuple[DataFrame, DataFrame]:
    """Movable objects leave the grid: (entities, remaining cells)."""
    found = cut(
        cluster_cells(cells.where(F.col(label).isin(*labels)), eps, min_samples, (label,)).where("cluster IS NOT NULL")
    )
    entities = oriented_boxes(found, [label, "cluster"], voxel_size).withColumns({
        "id": uuid_from(F.concat_ws("-", F.lit("entity"), label, *[f"cluster.{a}" for a in XYZ])),
        "mc_item": map_lookup(ITEM_OF_LABEL, F.col(label)),
    })
    taken = found.join(entities.select(label, "cluster"), [label, "cluster"], "left_semi").select(*XYZ)
    return entities, cells.join(taken, XYZ, "left_anti")


# ---------------------------------------------------------------- small objects
QUANT_M = 0.01
#: Pairs of points that a task looks at in one step.
CANDIDATES = 2_000_000


def small_object_instances(
    points: DataFrame, labels: tuple[int, ...] = SMALL_OBJECT_LABELS, eps_m: float = 0.06,
    min_points: int = 30, min_dim_m: float = 0.03,
) -> DataFrame:
    """Cup-sized objects from raw points (px, py, pz, label, r, g, b, seq).

    Points fall on a 1 cm grid, first seen wins; repeated views cost nothing after
    the map-side minimum. Distances are taken between the retained points.
    """
    grid = {f"g{a}": F.rint(F.col(f"p{a}") / QUANT_M).cast("bigint") for a in XYZ}
    kept = points.where(F.col("label").isin(*labels)).withColumns(grid)
    first = cut(
        kept.groupBy("label", "gx", "gy", "gz")
        .agg(F.min_by(F.struct("px", "py", "pz", "r", "g", "b"), "seq").alias("p"))
        .select("label", *[F.col(f"g{a}").alias(a) for a in XYZ], "p.*")
    )
    enough = first.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points)
    first = first.join(F.broadcast(enough.select("label")), "label", "left_semi")
    labelled = cluster_metric_points(first, eps_m, min_points)
    placed = labelled.where("cluster IS NOT NULL").groupBy("label", "cluster").agg(
        F.count(F.lit(1)).alias("voxel_count"),
        *[F.min(f"p{a}").alias(f"lo_{a}") for a in XYZ], *[F.max(f"p{a}").alias(f"hi_{a}") for a in XYZ],
        *[F.rint(F.avg(c)).cast("int").alias(c) for c in "rgb"],
    )
    # clusters are numbered per label by their first core point
    ranked = number_groups(placed, ["label", "cluster"], "n")
    base = ranked.groupBy("label").agg(F.min("n").alias("n0"))
    ranked = ranked.join(F.broadcast(base), "label").withColumn("cid", F.col("n") - F.col("n0"))
    mid = {f"pos_{a}": (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 for a in XYZ}
    dims = {f"dim_{a}": F.greatest(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(min_dim_m)) for a in XYZ}
    out = ranked.withColumns({**mid, **dims})
    seed = F.format_string("small-%d-%d-%.3f-%.3f", "label", "cid", "pos_x", "pos_z")
    return out.select(
        uuid_from(seed).alias("id"), "label", "cid", *mid, *dims, "voxel_count", "r", "g", "b"
    )


def _near_pairs(bins: np.ndarray, number: np.ndarray, pos: np.ndarray, eps_m: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points of one block within ``eps_m``, each once, a bounded number of candidates at a time.

    ``bins``: cubes of a side no shorter than ``eps_m`` that the points lie in, counted from 0 in each block.
    """
    side = int(bins.max()) + 3
    key = ((number * side + bins[:, 0] + 1) * side + bins[:, 1] + 1) * side + bins[:, 2] + 1
    order = np.argsort(key, kind="stable")
    filled, start, size = np.unique(key[order], return_index=True, return_counts=True)
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    for i, j, k in around:
        wanted = filled + (i * side + j) * side + k
        at = np.minimum(np.searchsorted(filled, wanted), len(filled) - 1)
        one = np.flatnonzero(filled[at] == wanted)
        two = at[one]
        ends = np.cumsum(size[one] * size[two])
        first = 0
        while first < len(one):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CANDIDATES, side="right")))
            p, q = one[first:last], two[first:last]
            times = size[p] * size[q]
            of = np.repeat(np.arange(len(p)), times)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            a, b = start[p][of] + nth // size[q][of], start[q][of] + nth % size[q][of]
            if (i, j, k) == (0, 0, 0):
                a, b = a[a < b], b[a < b]
            a, b = order[a], order[b]
            near = ((pos[a] - pos[b]) ** 2).sum(axis=1) <= eps_m * eps_m
            yield a[near], b[near]
            first = last


def _metric_kernel(block: int, reach: int, eps_m: float, min_points: int):
    """Density clusters inside blocks of points with a halo of twice the reach, many blocks a call; see ``joined_blocks``."""
    halo, names = 2 * reach, ["label", *BLOCK_COLS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches, names, AT_ONCE):
            begins = block_starts(t, names)
            number = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, t.num_rows]))
            columns = lambda names: np.stack([t[c].to_numpy() for c in names], axis=1)
            at = columns(XYZ)
            order = np.lexsort((*at.T[::-1], number))  # scan order: the smallest index of a cluster is its first cell
            at, number, pos = at[order], number[order], columns(["px", "py", "pz"])[order]
            rel = at - (columns(BLOCK_COLS)[order] * block - halo)
            own = ((rel >= halo) & (rel < halo + block)).all(axis=1)
            bins, n = rel // reach, len(at)
            count = np.ones(n, np.int64)
            for a, b in _near_pairs(bins, number, pos, eps_m):
                count += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            core = count >= min_points
            root, links, fringe = np.arange(n), [], []
            for a, b in _near_pairs(bins, number, pos, eps_m):
                inside = core[a] & core[b] & own[a] & own[b] & (root[a] != root[b])
                root = min_label(n, root[a[inside]], root[b[inside]])[root]
                for a, b in ((a, b), (b, a)):
                    out = own[a] & core[a] & core[b] & ~own[b]
                    edge = own[a] & ~core[a] & core[b]
                    links.append(np.unique(np.stack([root[a[out]], b[out]]), axis=1))
                    fringe.append(np.unique(np.stack([a[edge], np.where(own[b[edge]], root[b[edge]], b[edge])]), axis=1))
            mine = np.flatnonzero(own & core)
            links, fringe = (np.concatenate(x, axis=1) if x else np.empty((2, 0), np.int64) for x in (links, fringe))
            links = np.unique(np.stack([root[links[0]], links[1]]), axis=1)
            fringe = np.unique(np.stack([fringe[0], np.where(own[fringe[1]], root[fringe[1]], fringe[1])]), axis=1)
            kind = np.repeat(np.array([CELL, LINK, BORDER], np.int8), [len(mine), links.shape[1], fringe.shape[1]])
            first, second = np.r_[mine, links[0], fringe[0]], np.r_[root[mine], links[1], fringe[1]]
            ends = [pa.array(at[rows, i]) for i in range(3) for rows in (first, second)]
            yield pa.RecordBatch.from_arrays(
                [t["label"].combine_chunks().take(pa.array(order[first])), pa.array(kind), *ends],
                ["g0", "kind", *[f"{s}{a}" for a in XYZ for s in "ab"]])

    return run


def cluster_metric_points(points: DataFrame, eps_m: float, min_points: int) -> DataFrame:
    """Density clustering of metric points that are unique on the 1 cm grid.

    A block of the grid finds its own core points and clusters and reports, like ``cluster_cells``, only what leaves it;
    pairs of points stay in the task.
    """
    reach = int(np.ceil(eps_m / QUANT_M)) + 1
    block = 8 * reach
    base = points.withColumn("key", F.struct("label", "x", "y", "z"))
    rows = points.select("label", *[F.col(a).cast("bigint").alias(a) for a in XYZ], *[F.col(f"p{a}").cast("double").alias(f"p{a}") for a in XYZ])
    rows = rows.where(" AND ".join(f"p{a} IS NOT NULL" for a in XYZ))
    names = ["label", *BLOCK_COLS]
    schema = f"g0 {points.schema['label'].dataType.simpleString()}, kind tinyint, " + ", ".join(f"{s}{a} bigint" for a in XYZ for s in "ab")
    halo = spread(with_halo(rows, block, 2 * reach), *names).sortWithinPartitions(*names)
    parts = cut(halo.mapInArrow(_metric_kernel(block, reach, eps_m, min_points), schema))
    found = joined_blocks(parts, ["g0"], True)
    point = lambda c: F.struct(F.col(f"{c}.g0").alias("label"), *[F.col(f"{c}.{a}").alias(a) for a in XYZ])
    found = found.select(point("cell").alias("key"), point("label").alias("cluster"))
    return base.join(by_sorting(found), "key", "left").drop("key")


# ---------------------------------------------------------------- item models
def mount_of(members: DataFrame, cells: DataFrame, group_cols: list[str], label: str = "label", reach: int = 8) -> DataFrame:
    """ceiling / wall / floor per object, from the structure around it.

    The wall probe looks at every n-th member, n = size // 64, in scan order.
    """
    structure = cells.where(F.col(label).isin(*STRUCTURE_LABELS)).select(*XYZ)
    walls = cells.where(F.col(label) == WALL_LABEL).select(*XYZ)
    ends = members.groupBy(*group_cols).agg(
        F.max("y").alias("top"), F.min("y").alias("bot"), F.count(F.lit(1)).alias("n"))
    body = members.join(ends, group_cols)

    def touches(rows: DataFrame, direction: int) -> DataFrame:
        probe = rows.select(*group_cols, *XYZ, F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("d"))
        probe = probe.withColumn("y", F.col("y") + F.lit(direction) * F.col("d"))
        return probe.join(structure, XYZ, "left_semi").select(*group_cols).distinct()

    above = touches(body.where("y = top"), 1).withColumn("above", F.lit(True))
    below = touches(body.where("y = bot"), -1).withColumn("below", F.lit(True))
    order = F.row_number().over(Window.partitionBy(*group_cols).orderBy(*XYZ)) - 1
    sampled = body.withColumn("ord", order).where("ord % greatest(1, n div 64) = 0")
    cross = [(d, 0, 0) for d in range(-reach, reach + 1)] + [(0, 0, d) for d in range(-reach, reach + 1)]
    side = shifted(sampled, cross, tuple(group_cols)).join(walls, XYZ, "left_semi")
    side = side.select(*group_cols).distinct().withColumn("side", F.lit(True))
    out = ends.join(above, group_cols, "left").join(below, group_cols, "left").join(side, group_cols, "left")
    mount = (
        F.when(F.col("above") & F.col("below").isNull(), "ceiling")
        .when(F.col("below").isNull() & F.col("side"), "wall").otherwise("floor")
    )
    return out.select(*group_cols, mount.alias("mount"))


def object_models(
    obs_cells: DataFrame, voxel_size: float, min_voxels: int = 30, labels: tuple[int, ...] = MODEL_LABELS,
    max_extent_m: float = 2.6, label: str = "label",
) -> tuple[DataFrame, DataFrame]:
    """26-connected components of a class become placed models.

    ``obs_cells``: occupied x, y, z, label[, r, g, b, rgb_count]. Returns (models,
    member cells). Fragments with touching boxes are one object; oversized ones
    stay voxels.
    """
    picked = obs_cells.where(F.col(label).isin(*labels))
    parts = cut(label_components(picked, CORNER, (label,)))
    boxes = group_extent(parts, label, "component").where(F.col("voxel_count") >= max(4, min_voxels // 4))
    boxes = cut(boxes.withColumn("cid", _flat_id(label, "component")))
    owner = merge_boxes_until_stable(boxes, "cid", [label], 2).select(
        cell_id(*[f"cid.{a}" for a in XYZ]).alias("component"), F.col("cid.of").alias(label),
        cell_id(*[f"merged.{a}" for a in XYZ]).alias("object_key"))
    members = cut(parts.join(owner, [label, "component"]).select(label, "object_key", *XYZ))
    extent = group_extent(members, label, "object_key")
    vs = F.lit(float(voxel_size))
    dims = {f"dim_{a}": (F.col(f"max_{a}") - F.col(f"min_{a}") + 1.0) * vs for a in XYZ}
    mid = {f"pos_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}") + 1.0) * 0.5 * vs for a in XYZ}
    # numbering within a class follows the box corner and counts small ones too
    ranked = number_groups(extent, [label, "min_x", "min_y", "min_z", "object_key"], "n")
    base = ranked.groupBy(label).agg(F.min("n").alias("n0"))
    ranked = ranked.join(F.broadcast(base), label).withColumn("cid", F.col("n") - F.col("n0") + 1)
    kept = ranked.where(F.col("voxel_count") >= min_voxels).withColumns({**dims, **mid})
    kept = cut(kept.where(F.greatest(*dims) <= max_extent_m))
    used = members.join(kept.select(label, "object_key"), [label, "object_key"], "left_semi")
    mount = mount_of(used, obs_cells, [label, "object_key"], label)
    out = kept.join(mount, [label, "object_key"])
    if "rgb_count" in obs_cells.columns:
        seen = used.join(obs_cells.where("rgb_count > 0").select(*XYZ, "r", "g", "b"), XYZ)
        colour = seen.groupBy(label, "object_key").agg(*[F.rint(F.avg(c)).cast("int").alias(c) for c in "rgb"])
        out = out.join(colour, [label, "object_key"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("int") for c in "rgb"})
    seed = F.format_string("%d-%d-%.3f-%.3f", label, "cid", "pos_x", "pos_z")
    item = F.when(F.col("mount") == "floor", map_lookup(ITEM_OF_LABEL, F.col(label)))
    models = out.select(
        uuid_from(seed).alias("id"), label, "object_key", *mid, *dims, "voxel_count", "mount",
        item.alias("mc_item"), "r", "g", "b",
    )
    return models, used


def snap_small_to_support(small: DataFrame, furniture: DataFrame, max_drop_m: float = 1.5, tile: float = 4.0) -> DataFrame:
    """Drop small objects onto the furniture top under them.

    Both tables carry id, pos_*, dim_*. An object inside a piece of furniture
    stays. Furniture is spread over floor tiles; each small object reads one.
    """
    t = lambda c: F.floor(c / F.lit(tile)).cast("bigint")
    host = furniture.select(*[F.col(f"pos_{a}").alias(f"f{a}") for a in XYZ], *[(F.col(f"dim_{a}") / 2).alias(f"h{a}") for a in XYZ])
    host = host.withColumn("tx", F.explode(F.sequence(t(F.col("fx") - F.col("hx")), t(F.col("fx") + F.col("hx")))))
    host = host.withColumn("tz", F.explode(F.sequence(t(F.col("fz") - F.col("hz")), t(F.col("fz") + F.col("hz")))))
    item = small.withColumns({"tx": t(F.col("pos_x")), "tz": t(F.col("pos_z")), "bottom": F.col("pos_y") - F.col("dim_y") / 2})
    over = item.join(host, ["tx", "tz"]).where(
        (F.abs(F.col("pos_x") - F.col("fx")) <= F.col("hx")) & (F.abs(F.col("pos_z") - F.col("fz")) <= F.col("hz"))
    )
    top, bot = F.col("fy") + F.col("hy"), F.col("fy") - F.col("hy")
    found = over.groupBy("id").agg(
        F.max((bot - 0.02 < F.col("pos_y")) & (F.col("pos_y") < top + 0.02)).alias("inside"),
        F.max(F.when(top <= F.col("bottom") + 0.05, top)).alias("top"),
    )
    out = item.join(found, "id", "left")
    lands = ~F.coalesce("inside", F.lit(False)) & F.col("top").isNotNull() & (F.col("bottom") - F.col("top") <= max_drop_m)
    lands = F.coalesce(lands, F.lit(False))
    return out.withColumn("support", F.when(lands, F.lit("furniture"))).withColumn(
        "pos_y", F.when(lands, F.col("top") + F.col("dim_y") / 2).otherwise(F.col("pos_y"))
    ).select(*small.columns, "support")


# ---------------------------------------------------------------- nearest node
def nearest_node(
    queries: DataFrame, nodes: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), tile: float = 1.0
) -> DataFrame:
    """Closest node per query (qid, axes), ties to the smallest node id.

    ``nodes``: id, axes. Nodes on one spot count once (smallest id). Tiles are
    searched in growing rings; an answer is final once it is closer than the ring
    searched, so crowded places settle in small tiles and only far queries go on.
    """
    import itertools

    todo = cut(queries.select("qid", *[F.col(a).cast("double").alias(f"q{a}") for a in axes]))
    if nodes.isEmpty():
        return todo.select("qid", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("d2"))
    spots = nodes.select("id", *[F.col(a).cast("double").alias(a) for a in axes])
    pool = cut(spots.groupBy(*axes).agg(F.min("id").alias("id")))
    done, ring = None, tile
    while True:
        t = lambda c: F.floor(c / F.lit(ring)).cast("bigint")
        tiles = [f"t{a}" for a in axes]
        placed = pool.withColumns({f"t{a}": t(F.col(a)) for a in axes})
        steps = F.array(*[F.struct(*[F.lit(v).alias(f"s{a}") for a, v in zip(axes, s)])
                          for s in itertools.product((-1, 0, 1), repeat=len(axes))])
        probe = todo.select("*", F.explode(steps).alias("s")).select(
            "qid", *[f"q{a}" for a in axes], *[(t(F.col(f"q{a}")) + F.col(f"s.s{a}")).alias(f"t{a}") for a in axes])
        d2 = sum(((F.col(a) - F.col(f"q{a}")) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.col(f"q{axes[0]}")) ** 2)
        best = probe.join(placed, tiles).groupBy("qid").agg(F.min(F.struct(d2.alias("d2"), "id")).alias("b"))
        out = cut(best.where(F.col("b.d2") <= ring * ring).select("qid", F.col("b.id").alias("id"), F.col("b.d2").alias("d2")))
        done = out if done is None else done.union(out)
        todo = cut(todo.join(out, "qid", "left_anti"))
        if todo.isEmpty():
            return done
        ring *= 4


def entity_order(entities: DataFrame, up: str = "y", seq: str = "seq") -> DataFrame:
    """Entities with their places by observed bottom (lowest first) and by box volume (largest first), from 0.

    Both orders are range sorts; equal bottoms or volumes keep ``seq`` order, an
    unknown box (null edge) comes last in both.
    """
    volume = F.lit(1.0)
    for a in XYZ:
        volume = volume * (F.col(f"max_{a}") - F.col(f"min_{a}"))
    ranked = entities.withColumns({
        "_high": F.col(f"min_{up}").isNull().cast("int"), "_flat": volume.isNull().cast("int"), "_small": -volume})
    ranked = number_groups(ranked, ["_high", f"min_{up}", seq], "by_bottom")
    return number_groups(ranked, ["_flat", "_small", seq], "by_volume").drop("_high", "_flat", "_small")
