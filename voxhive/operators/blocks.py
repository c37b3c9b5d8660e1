"""Spatial blocking: every task gets one cube of cells plus a halo.

A group is bounded by geometry, (block + 2*halo)^3 distinct cells, however many
raw rows fell into it, because the callers de-duplicate cells first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxhive.functions.cells import AXES, floor_div

BLOCK_COLS = ("bx", "by", "bz")
BLOCK_OF = dict(zip(AXES, BLOCK_COLS))


def with_halo(cells: DataFrame, block: int, halo: int) -> DataFrame:
    """Repeat each cell in every block whose halo reaches it."""
    out = cells
    for axis, name in BLOCK_OF.items():
        first = floor_div(F.col(axis) - F.lit(halo), block)
        last = floor_div(F.col(axis) + F.lit(halo), block)
        out = out.withColumn(name, F.explode(F.sequence(first, last)))
    return out


def with_block(cells: DataFrame, block: int) -> DataFrame:
    """Each cell in its own block only."""
    return cells.withColumns({name: floor_div(axis, block) for axis, name in BLOCK_OF.items()})


def block_starts(t: pa.Table, names: list[str]) -> np.ndarray:
    """Where a new block begins in rows sorted by ``names`` (nulls are equal)."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for name in names:
        col = t[name]
        before, after = col.slice(0, len(col) - 1), col.slice(1)
        new[1:] |= pc.fill_null(pc.not_equal(before, after), False).to_numpy() | (before.is_null().to_numpy() != after.is_null().to_numpy())
    return np.flatnonzero(new)


def whole_blocks(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole blocks, at least ``rows`` rows or the rest, from rows sorted by ``names``."""
    waiting, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        held += batch.num_rows
        if held < rows or all(waiting[0][c][0] == batch[c][batch.num_rows - 1] for c in names):
            continue
        t = pa.Table.from_batches(waiting)
        last = int(block_starts(t, names)[-1])
        if last:
            yield t.slice(0, last)
        rest = t.slice(last).combine_chunks()
        waiting, held = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(waiting)


def min_label(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index per vertex for the pairs (left, right)."""
    label = np.arange(n)
    while left.size:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
        live = label[left] != label[right]
        left, right = left[live], right[live]
    return label
