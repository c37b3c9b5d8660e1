"""Closing of small holes inside blocks: a block and the cells around it decide its own new cells and their values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxhive.functions.cells import AXES, FACES, ball_offsets
from voxhive.operators.blocks import BLOCK_COLS, block_starts, whole_blocks, with_halo
from voxhive.operators.cluster import AT_ONCE, TOGETHER
from voxhive.session import spread

BLOCK = 32


def _around(grid: np.ndarray) -> Iterator[np.ndarray]:
    """The grids seen from each face neighbour; nothing lies outside."""
    for axis in (1, 2, 3):
        for ahead in (True, False):
            moved = np.zeros_like(grid)
            to, of = [slice(None)] * 4, [slice(None)] * 4
            to[axis], of[axis] = (slice(1, None), slice(None, -1)) if ahead else (slice(None, -1), slice(1, None))
            moved[tuple(to)] = grid[tuple(of)]
            yield moved


def _closing_kernel(value: str, steps: int, low: np.ndarray, high: np.ndarray):
    halo = 2 * steps
    side = BLOCK + 2 * halo
    # nearest first, equal distances in scan order of the cell they lead to
    offsets = np.array(sorted(ball_offsets(steps * steps, True), key=lambda o: (sum(v * v for v in o), tuple(o))))
    names = list(BLOCK_COLS)

    def fill(t: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        columns = lambda names: np.stack([t[c].to_numpy() for c in names], axis=1)
        corner = columns(BLOCK_COLS) * BLOCK - halo
        rel = columns(AXES) - corner
        at = np.full((int(number[-1]) + 1, side, side, side), -1, dtype=np.int32)
        at[number, rel[:, 0], rel[:, 1], rel[:, 2]] = np.arange(len(rel))
        corners = corner[np.flatnonzero(np.diff(number, prepend=-1))]
        full = at >= 0
        grown, inside = full, np.ones_like(full)
        for k in range(3):
            spot = corners[:, k, None] + np.arange(side)
            inside &= ((spot >= low[k]) & (spot <= high[k])).reshape(len(corners), *[side if i == k else 1 for i in range(3)])
        for _ in range(steps):
            grown = np.logical_or.reduce([grown, *_around(grown)]) & inside
        for _ in range(steps):
            grown = np.logical_and.reduce([grown, *_around(grown)])
        own = (slice(None), *[slice(halo, halo + BLOCK)] * 3)
        new = np.stack(np.nonzero(grown[own] & ~full[own]), axis=1)
        new[:, 1:] += halo
        source = np.full(len(new), -1, dtype=np.int64)
        for offset in offsets:
            open_ = np.flatnonzero(source < 0)
            b, xyz = new[open_, 0], new[open_, 1:] + offset
            source[open_] = at[b, xyz[:, 0], xyz[:, 1], xyz[:, 2]]
        new, source = new[source >= 0], source[source >= 0]
        xyz = new[:, 1:] + corners[new[:, 0]]
        return pa.RecordBatch.from_arrays(
            [*[pa.array(xyz[:, k]) for k in range(3)], t[value].combine_chunks().take(pa.array(source))], [*AXES, value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches, names, AT_ONCE):
            begins = block_starts(t, names)
            number = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, t.num_rows]))
            stops = [*begins[TOGETHER::TOGETHER].tolist(), t.num_rows]
            for start, stop in zip([0, *stops], stops):
                yield fill(t.slice(start, stop - start), number[start:stop] - number[start])

    return run


def filled_cells(cells: DataFrame, value: str, steps: int, box) -> DataFrame:
    """x, y, z, value of the cells that a closing by face neighbours adds inside the one-row ``box``.

    The value is that of the closest cell within ``steps``, ties to the first in scan order; cells without one are left out.
    """
    low, high = (np.array([box[f"{a}_{s}"] for a in AXES], dtype=object) for s in ("lo", "hi"))
    if low[0] is None or low[1] is None or low[2] is None:  # no cell at all
        low, high = np.zeros(3), -np.ones(3)
    rows = cells.select(*[F.col(a).cast("bigint").alias(a) for a in AXES], value)
    near = spread(with_halo(rows, BLOCK, 2 * steps), *BLOCK_COLS).sortWithinPartitions(*BLOCK_COLS)
    schema = StructType([*[StructField(a, LongType()) for a in AXES], StructField(value, cells.schema[value].dataType)])
    return near.mapInArrow(_closing_kernel(value, steps, low.astype(np.int64), high.astype(np.int64)), schema)
