"""Exact density clustering and connected components of lattice cells.

One shuffle brings each block its cells and a halo. A task decides which of its
cells are core, labels them inside the block, and reports only the links that
leave the block; those links form a far smaller graph that the star contraction
finishes. Plain n-connectivity is the case ``min_samples = 1``.

Cluster ids are the cluster's first core cell in scan order, struct (x, y, z), so
the smallest id among a border cell's core neighbours is the earliest cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxhive.functions.cells import AXES, ball_offsets
from voxhive.operators.blocks import BLOCK_COLS, block_starts, min_label, whole_blocks, with_halo
from voxhive.operators.components import TAIL_EDGES, connected_components
from voxhive.session import by_sorting, cut, spread

CELL, LINK, BORDER = 0, 1, 2
# Side of the cube of cells that one kernel call takes, unless a block is larger.
TASK_SIDE = 32
# Cells that a task reads before it labels their blocks, and blocks labelled in one call.
AT_ONCE, TOGETHER = 50_000, 64
FACE, EDGE, CORNER = 1, 2, 3  # squared radius of 6-, 18- and 26-connectivity


def _block_kernel(block: int, halo: int, radius2: float, min_samples: int, gnames: list[str], cube: int):
    """Labels inside blocks, for a task's block-sorted cells.

    A kernel call takes up to ``TOGETHER`` cubes of whole blocks, each in a grid of its own, so that small blocks and
    groups do not cost a call each.
    """
    names = [*gnames, *BLOCK_COLS]
    offsets = np.array(ball_offsets(radius2), dtype=np.int64)
    reach = int(np.abs(offsets).max())
    side = cube + 2 * (halo + reach)
    steps = (offsets[:, 0] * side + offsets[:, 1]) * side + offsets[:, 2]
    forward = steps[steps > 0]

    def label(t: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        columns = lambda names: np.stack([t[c].to_numpy() for c in names], axis=1)
        xyz = columns(AXES)
        rel = xyz - (columns(BLOCK_COLS) * cube - halo - reach)
        flat = ((number * side + rel[:, 0]) * side + rel[:, 1]) * side + rel[:, 2]
        order = np.argsort(flat)
        flat, rel, xyz = flat[order], rel[order], xyz[order]
        n = flat.size
        grid = np.full((int(number[-1]) + 1) * side**3, -1, dtype=np.int32)
        grid[flat] = np.arange(n)
        margin = halo + reach
        own = ((rel >= margin) & (rel < margin + cube)).all(axis=1)
        part = (rel - margin) // block

        core = np.ones(n, dtype=bool)
        if min_samples > 1:
            # cells of the outermost ring see too few neighbours; they are never read
            inner = ((rel >= 2 * reach) & (rel < side - 2 * reach)).all(axis=1)
            count = np.ones(n, dtype=np.int64)
            spots = flat[inner]
            for step in steps:
                count[inner] += grid[spots + step] >= 0
            core = inner & (count >= min_samples)

        mine = np.flatnonzero(own & core)
        inside, outside = [], []
        for step in forward:
            other = grid[flat[mine] + step]
            hit = other >= 0
            a, b = mine[hit], other[hit]
            keep = core[b]
            a, b = a[keep], b[keep]
            local = own[b] & (part[a] == part[b]).all(axis=1)
            inside.append((a[local], b[local]))
            outside.append((a[~local], b[~local]))
        left = np.concatenate([p[0] for p in inside]) if inside else np.empty(0, int)
        right = np.concatenate([p[1] for p in inside]) if inside else np.empty(0, int)
        root = min_label(n, left, right)

        kinds, firsts, seconds = [np.full(mine.size, CELL)], [mine], [root[mine]]
        la = np.concatenate([p[0] for p in outside]) if outside else np.empty(0, int)
        lb = np.concatenate([p[1] for p in outside]) if outside else np.empty(0, int)
        if la.size:
            links = np.unique(np.stack([root[la], lb]), axis=1)
            kinds.append(np.full(links.shape[1], LINK))
            firsts.append(links[0])
            seconds.append(links[1])
        if min_samples > 1:
            fringe = np.flatnonzero(own & ~core)
            fa, fb = [], []
            for step in steps:
                other = grid[flat[fringe] + step]
                hit = other >= 0
                a, b = fringe[hit], other[hit]
                keep = core[b]
                a, b = a[keep], b[keep]
                fa.append(a)
                fb.append(np.where(own[b], root[b], b))
            if fa and sum(map(len, fa)):
                refs = np.unique(np.stack([np.concatenate(fa), np.concatenate(fb)]), axis=1)
                kinds.append(np.full(refs.shape[1], BORDER))
                firsts.append(refs[0])
                seconds.append(refs[1])
        first, second = np.concatenate(firsts), np.concatenate(seconds)
        ends = [xyz[rows, i] for i in range(3) for rows in (first, second)]
        of = pa.array(order[first])
        return pa.RecordBatch.from_arrays(
            [t[g].combine_chunks().take(of) for g in gnames] + [pa.array(np.concatenate(kinds).astype(np.int8)), *map(pa.array, ends)],
            [*gnames, "kind", *[f"{s}{a}" for a in AXES for s in "ab"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches, names, AT_ONCE):
            begins = block_starts(t, names)
            number = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, t.num_rows]))
            stops = [*begins[TOGETHER::TOGETHER].tolist(), t.num_rows]
            for start, stop in zip([0, *stops], stops):
                yield label(t.slice(start, stop - start), number[start:stop] - number[start])

    return run


def cluster_cells(
    cells: DataFrame,
    radius: float,
    min_samples: int = 1,
    group_cols: tuple[str, ...] = (),
    block: int = 32,
    out: str = "cluster",
) -> DataFrame:
    """Label distinct cells: group columns, x, y, z, ``out`` (NULL = noise).

    Semantics of exact DBSCAN: a cell is core if at least ``min_samples`` cells,
    itself included, lie within ``radius``; clusters are connected core cells; a
    border cell joins the earliest cluster among its core neighbours.
    """
    return cluster_cells2(cells, radius * radius, min_samples, group_cols, block, out)


def label_components(
    cells: DataFrame, connectivity: int = FACE, group_cols: tuple[str, ...] = (),
    block: int = 32, out: str = "component", tail_edges: int = TAIL_EDGES,
) -> DataFrame:
    """Connected components of cells (connectivity FACE, EDGE or CORNER)."""
    return cluster_cells2(cells, connectivity, 1, group_cols, block, out, tail_edges)


def joined_blocks(parts: DataFrame, gnames: list[str], fringe: bool, tail_edges: int = TAIL_EDGES) -> DataFrame:
    """(cell, label) from what the blocks report: group columns, kind, ax..az and bx..bz.

    A ``CELL`` comes with its root inside the block, a ``LINK`` leads from a root to a cell of another block, a
    ``BORDER`` cell (with ``fringe``) names its core neighbours.  A label is the smallest cell of the whole component.
    """

    def node(side: str):
        return F.struct(*gnames, *[F.col(f"{side}{a}").alias(a) for a in AXES])

    roots = parts.where(F.col("kind") == CELL).select(node("a").alias("cell"), node("b").alias("root"))
    links = (
        parts.where(F.col("kind") == LINK)
        .select(node("a").alias("src"), node("b").alias("cell"))
        .join(by_sorting(roots), "cell")
        .select("src", F.col("root").alias("dst"))
    )
    joined = connected_components(links, tail_edges=tail_edges)
    labelled = roots.join(by_sorting(joined), F.col("root") == F.col("node"), "left").select(
        "cell", F.coalesce("component", "root").alias("label")
    )
    if not fringe:
        return labelled
    border = (
        parts.where(F.col("kind") == BORDER)
        .select(node("a").alias("border"), node("b").alias("cell"))
        .join(by_sorting(labelled), "cell")
        .groupBy("border")
        .agg(F.min("label").alias("label"))
        .select(F.col("border").alias("cell"), "label")
    )
    return labelled.union(border)


def cluster_cells2(cells, radius2, min_samples, group_cols=(), block=32, out="cluster", tail_edges=TAIL_EDGES):
    spark = cells.sparkSession
    reach = max(1, int(math.sqrt(radius2) + 1e-9))
    halo = 2 * reach if min_samples > 1 else reach
    groups = [F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)]
    gnames = [f"g{i}" for i in range(len(group_cols))]
    distinct = cells.select(*groups, *[F.col(a).cast("bigint").alias(a) for a in AXES]).distinct()
    gtypes = [distinct.schema[g].dataType.simpleString() for g in gnames]
    schema = ", ".join(
        [f"{g} {t}" for g, t in zip(gnames, gtypes)] + ["kind tinyint"] + [f"{s}{a} bigint" for a in AXES for s in "ab"]
    )
    cube = block * max(1, TASK_SIDE // block)
    run = _block_kernel(block, halo, radius2, min_samples, gnames, cube)
    names = [*gnames, *BLOCK_COLS]
    parts = cut(spread(with_halo(distinct, cube, halo), *names).sortWithinPartitions(*names).mapInArrow(run, schema))

    found = joined_blocks(parts, gnames, min_samples > 1, tail_edges)
    if min_samples > 1:
        everything = distinct.select(F.struct(*gnames, *AXES).alias("cell"))
        found = everything.join(by_sorting(found), "cell", "left")
    label = F.when(F.col("label").isNotNull(), F.struct(*[F.col(f"label.{a}").alias(a) for a in AXES]))
    back = [F.col(f"cell.{g}").alias(c) for g, c in zip(gnames, group_cols)]
    return found.select(*back, *[F.col(f"cell.{a}").alias(a) for a in AXES], label.alias(out))


def number_groups(
    df: DataFrame, order_cols: list[str], out: str = "number", start: int = 0
) -> DataFrame:
    """Consecutive numbers in ``order_cols`` order without a single-task sort.

    Range partitioning sorts across tasks; only one row count per partition is
    combined globally.
    """
    ranged = cut(df.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select(
        F.col("_pid").alias("_p"),
        (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_shift"),
    )
    rank = F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols))
    return (
        ranged.withColumn("_r", rank)
        .join(F.broadcast(shift), F.col("_pid") == F.col("_p"))
        .withColumn(out, (F.col("_shift") + F.col("_r") - 1 + start).cast("bigint"))
        .drop("_pid", "_p", "_r", "_shift")
    )
