"""The observation fold in blocks: rays are dealt to cubes of cells and folded there by arrays.

A ray is cut into pieces of ``PIECE`` steps and each piece goes to the blocks its
bounding box meets, so the shuffle carries rays, not the cells they cross.  A task
reads its blocks in order, lists the (cell, frame) events of some whole blocks at a
time without repeats, and steps all cells through their histories at once.  The
arithmetic is that of ``observation`` (single precision, half-even colours).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxhive.functions.cells import AXES, floor_div, voxel_index
from voxhive.operators.blocks import BLOCK_COLS, block_starts, whole_blocks, with_block

BLOCK = 32
PIECE = 32
#: Pieces folded in one step of a task (whole blocks), and exploded at a time.
FLUSH = 50_000
STATE = ("sem_label", "sem_count", "r", "g", "b", "rgb_count")


def ray_pieces(points: DataFrame, voxel_size: float, margin: float) -> DataFrame:
    """One row per (ray, piece, block) with bx, by, bz; ``final`` pieces hold the end of the ray."""
    vs = F.lit(float(voxel_size))
    d = {a: F.col(f"p{a}") - F.col(f"o{a}") for a in AXES}
    length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    rays = points.withColumn("len", length).where(F.col("len") > margin)
    rays = rays.withColumn("last", F.ceil((F.col("len") - margin) / vs).cast("int"))
    whole = F.floor(F.col("last") / PIECE).cast("int")
    out = rays.withColumn("piece", F.explode(F.sequence(F.lit(0), whole))).withColumn("final", F.col("piece") == whole)
    first = F.col("piece") * PIECE
    stop = F.least("last", first + (PIECE - 1))
    for axis, name in zip(AXES, BLOCK_COLS):
        ends = [voxel_index(F.col(f"o{axis}") + s * vs * (d[axis] / F.col("len")), voxel_size) for s in (first, stop)]
        ends.append(F.when(F.col("final"), voxel_index(F.col(f"p{axis}"), voxel_size)))
        low, high = (floor_div(f(*ends), BLOCK) for f in (F.least, F.greatest))
        out = out.withColumn(name, F.explode(F.sequence(low, high)))
    return out.drop("len", "last")


def _distinct(*parts: np.ndarray) -> np.ndarray:
    """Sorted different values; plain sorting is faster here than numpy's hashed ``unique``."""
    out = np.sort(np.concatenate(parts))
    return out[np.r_[True, out[1:] != out[:-1]]] if len(out) else out


def _steps(first: np.ndarray, counts: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs ordered by falling length: for each turn, how many are left and where their next item is."""
    for turn in range(int(counts[0]) if len(counts) else 0):
        left = int(np.searchsorted(-counts, -turn, side="left"))
        yield left, start[first[:left]] + turn


def _folded(keys: np.ndarray, cells: np.ndarray, of_state: np.ndarray, step: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Call ``step(states, items)`` for the first items of all histories, the second ones, and so on.

    ``keys`` are the cells of the items in history order (sorted); ``of_state`` is the cell of each state.
    """
    start = np.searchsorted(keys, cells)
    counts = (np.searchsorted(keys, cells, side="right") - start)[of_state]
    order = np.argsort(-counts, kind="stable")
    for left, items in _steps(of_state[order], counts[order], start):
        step(order[:left], items)


def folder(voxel_size: float, margin: float, miss: float, hit: float, low: float, high: float,
           most: int, most_rgb: int, apart: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function from block-sorted pieces (and rows of an earlier map) to the map.

    ``apart`` keeps the points without a frame in rows of their own.
    """
    f32 = np.float32

    def numbers(col: pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
        return col.fill_null(0).to_numpy().astype(kind)

    def missing(col: pa.ChunkedArray) -> np.ndarray:
        return col.is_null().to_numpy()

    def crossed(o, p, corner, base, frame, frames, piece) -> np.ndarray:
        """Distinct cell * frames + frame of the steps inside the block."""
        d = [p[i] - o[i] for i in range(3)]
        length = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        limit = length - margin
        first = piece * PIECE
        n = np.minimum(np.ceil(limit / voxel_size).astype(np.int64), first + (PIECE - 1)) - first + 1
        row = np.repeat(np.arange(len(n)), n)
        s = (first - (np.cumsum(n) - n))[row] + np.arange(len(row))
        far = s * voxel_size
        held, local = far < limit[row], np.zeros(len(row), np.int64)
        for i in range(3):
            at = np.floor((o[i][row] + far * (d[i] / length)[row]) / voxel_size).astype(np.int64) - corner[i][row]
            held &= (at >= 0) & (at < BLOCK)
            local = local * BLOCK + at
        row = row[held]
        return _distinct((base[row] + local[held]) * frames + frame[row])

    def fold(t: pa.Table) -> pa.RecordBatch:
        block = [numbers(t[c]) for c in BLOCK_COLS]
        begins = block_starts(t, list(BLOCK_COLS))
        number = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, t.num_rows]))
        old = t["prior"].to_numpy()
        base = number * (2 * BLOCK**3)
        nameless = missing(t["frame_seq"])
        if apart:
            base = base + np.where(nameless & ~old, BLOCK**3, 0)
        named = numbers(t["frame_seq"])
        seen = _distinct(named[~old])
        frame, frames = np.where(nameless, 0, np.searchsorted(seen, named) + 1), len(seen) + 1

        ray = np.flatnonzero(~old)
        o, p = ([numbers(t[f"{k}{a}"], np.float64) for a in AXES] for k in "op")
        corner, piece = [b * BLOCK for b in block], numbers(t["piece"])
        missed = [crossed([c[r] for c in o], [c[r] for c in p], [c[r] for c in corner], base[r], frame[r], frames, piece[r])
                  for r in (ray[i:i + FLUSH] for i in range(0, len(ray), FLUSH))]
        missed = _distinct(np.empty(0, np.int64), *missed)
        end = ray[t["final"].fill_null(False).to_numpy()[ray]]
        at = [np.floor(p[i][end] / voxel_size).astype(np.int64) - corner[i][end] for i in range(3)]
        held = np.all([(a >= 0) & (a < BLOCK) for a in at], axis=0)
        end, at = end[held], [a[held] for a in at]
        end_cell = base[end] + (at[0] * BLOCK + at[1]) * BLOCK + at[2]
        end_key = end_cell * frames + frame[end]
        hits = _distinct(end_key)
        which = np.searchsorted(hits, end_key)
        events = _distinct(missed, hits)

        was = np.flatnonzero(old)
        was_at = [numbers(t[a])[was] - corner[i][was] for i, a in enumerate(AXES)]
        was_cell = base[was] + (was_at[0] * BLOCK + was_at[1]) * BLOCK + was_at[2]
        cells = _distinct(events // frames, was_cell)
        fresh = np.flatnonzero(~np.isin(cells, was_cell))
        of_state = np.r_[np.searchsorted(cells, was_cell), fresh]
        begin = lambda name, kind: np.r_[numbers(t[f"q_{name}"], kind)[was], np.zeros(len(fresh), kind)]

        odds = begin("logodds", f32)
        is_miss, is_hit = np.isin(events, missed, assume_unique=True), np.isin(events, hits, assume_unique=True)
        down, up = np.where(is_miss, f32(miss), f32(0)), np.where(is_hit, f32(hit), f32(0))

        def evidence(state, item):
            odds[state] = np.minimum(f32(high), np.maximum(f32(low), (odds[state] + down[item]) + up[item]))

        _folded(events // frames, cells, of_state, evidence)

        label, count = begin("sem_label", np.int64), begin("sem_count", np.int64)
        name = numbers(t["label"])[end]
        vote = np.flatnonzero(name != 0)
        rank, unranked = numbers(t["row_seq"])[end], missing(t["row_seq"])[end]
        vote = vote[np.lexsort((name[vote], rank[vote], ~unranked[vote], end_key[vote]))]
        cell, name = end_cell[vote], name[vote]
        run = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (name[1:] != name[:-1])]) if len(vote) else vote
        size = np.diff(np.r_[run, len(vote)])
        cell, name = cell[run], name[run]

        def majority(state, item):
            had, n = count[state], size[item]
            same, over = label[state] == name[item], n > had
            label[state] = np.where(~same & over, name[item], label[state])
            count[state] = np.minimum(most, np.where(same, had + n, np.abs(n - had)))

        _folded(cell, cells, of_state, majority)

        colour = [begin(c, np.int64) for c in "rgb"]
        shades = begin("rgb_count", np.int64)
        means = []
        for c in "rgb":
            there = ~missing(t[c])[end]
            total = np.bincount(which[there], numbers(t[c], np.float64)[end][there], len(hits))
            with np.errstate(invalid="ignore"):
                means.append(total / np.bincount(which[there], minlength=len(hits)))
        shaded = ~np.isnan(means[0])

        def blend(state, item):
            n = shades[state] + 1.0
            for now, mean in zip(colour, tones):
                moved = np.rint(now[state] + (mean[item] - now[state]) / n)
                now[state] = np.clip(np.nan_to_num(moved), 0, 255).astype(np.int64)
            shades[state] = np.minimum(most_rgb, shades[state] + 1)

        tones = [m[shaded] for m in means]
        _folded(hits[shaded] // frames, cells, of_state, blend)

        out = cells[of_state]
        first = begins[out // (2 * BLOCK**3)]
        inside = out % BLOCK**3
        spot = (inside // BLOCK**2, inside // BLOCK % BLOCK, inside % BLOCK)
        columns = [corner[i][first] + spot[i] for i in range(3)] + [odds]
        columns += [c.astype(np.int32) for c in (label, count, *colour, shades)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*AXES, "logodds", *STATE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches, list(BLOCK_COLS), FLUSH):
            yield fold(t)

    return run


def with_prior(pieces: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Pieces and the rows of an earlier map, told apart by ``prior``."""
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kinds = {"label": "int", "r": "double", "g": "double", "b": "double"}
    rows = pieces.select(
        *BLOCK_COLS, "piece", "final", F.col("frame_seq").cast("bigint").alias("frame_seq"),
        F.col("row_seq").cast("bigint").alias("row_seq") if "row_seq" in pieces.columns else null("row_seq", "bigint"),
        *[F.col(f"{k}{a}").cast("double").alias(f"{k}{a}") for k in "op" for a in AXES],
        *[F.when(F.col("final"), F.col(c).cast(kind)).alias(c) if c in pieces.columns else null(c, kind) for c, kind in kinds.items()],
        F.lit(False).alias("prior"))
    if prior is None:
        return rows.select("*", *[null(a, "bigint") for a in AXES], null("q_logodds", "float"), *[null(f"q_{c}", "int") for c in STATE])
    kept = with_block(prior, BLOCK).select(
        *BLOCK_COLS, *AXES, F.lit(True).alias("prior"), F.col("logodds").cast("float").alias("q_logodds"),
        *[F.col(c).cast("int").alias(f"q_{c}") for c in STATE])
    return rows.unionByName(kept, allowMissingColumns=True)
