"""Surface bands: all cells whose centre lies within a reach of a measured point."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from voxhive.functions.cells import voxel_index
from voxhive.operators.voxels import XYZ

#: Offsets that share one BIGINT of marks.
WORD = 62
#: Relative slack of the two bounds, above any rounding of the exact test.
SLACK = 1e-9


def band_kernel(voxel_size: float, reach: float) -> tuple[list[tuple], list[tuple]]:
    """Offsets (from the cell that holds a point) that are always in reach, and those that depend on the point."""
    half = math.ceil(reach / voxel_size) + 1
    always, rim = [], []
    for offset in itertools.product(range(-half, half + 1), repeat=3):
        least = voxel_size * math.sqrt(sum(max(abs(o) - 0.5, 0.0) ** 2 for o in offset))
        most = voxel_size * math.sqrt(sum((abs(o) + 0.5) ** 2 for o in offset))
        if most <= reach * (1 - SLACK):
            always.append(offset)
        elif least <= reach * (1 + SLACK):
            rim.append(offset)
    return always, rim


def _named(offset: tuple) -> list[Column]:
    return [F.lit(o).alias(n) for o, n in zip(offset, "ijk")]


def _marked(offsets: list[tuple]) -> Column:
    return F.array(*[F.struct(*_named(offset), F.lit(1 << b).cast("bigint").alias("bit"))
                     for b, offset in enumerate(offsets)])


def _on(word: str) -> Callable[[Column], Column]:
    return lambda o: F.col(word).bitwiseAND(o["bit"]) != 0


def surface_band(points: DataFrame, voxel_size: float, reach: float, columns: tuple[str, str, str] = ("px", "py", "pz")) -> DataFrame:
    """Distinct cells x, y, z whose centre is at most ``reach`` from some point, exactly.

    A point marks the offsets it reaches as bits; the marks of all points of a cell
    are or-ed before the shuffle, so a cell with any number of points sends one row,
    and only distinct cells are spread over the kernel. Points with a null or
    non-finite coordinate reach nothing; no points, no cells.
    """
    if voxel_size <= 0 or reach < 0:
        raise ValueError("voxel_size must be positive, reach not negative")
    size = F.lit(float(voxel_size))
    always, rim = band_kernel(float(voxel_size), float(reach))
    words = [rim[i:i + WORD] for i in range(0, len(rim), WORD)]
    metric = points.select(*[F.col(c).cast("double").alias(f"_p{a}") for c, a in zip(columns, XYZ)])
    for a in XYZ:
        metric = metric.where(F.abs(f"_p{a}") < F.lit(math.inf))  # false for null and, since it sorts above, NaN
    metric = metric.withColumns({a: voxel_index(f"_p{a}", voxel_size) for a in XYZ})

    # squared distances per axis and offset, each computed once a point
    spans = {n: sorted({o[i] for o in rim}) for i, n in enumerate("ijk")}
    gap = {n: [(F.col(a) + F.lit(o) + F.lit(0.5)) * size - F.col(f"_p{a}") for o in spans[n]] for a, n in zip(XYZ, "ijk")}
    squared = metric.select(*XYZ, *[(g * g).alias(f"_{n}{o}") for n in "ijk" for o, g in zip(spans[n], gap[n])])

    def marks(offsets: list[tuple]) -> Column:
        terms = []
        for b, (i, j, k) in enumerate(offsets):
            reached = F.sqrt(F.col(f"_i{i}") + F.col(f"_j{j}") + F.col(f"_k{k}")) <= F.lit(float(reach))
            terms.append(F.when(reached, F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        while len(terms) > 1:  # pairwise, so the expression stays flat
            terms = [Column.bitwiseOR(*t) if len(t) > 1 else t[0] for t in (terms[i:i + 2] for i in range(0, len(terms), 2))]
        return terms[0]

    marked = squared.select(*XYZ, *[marks(w).alias(f"_w{i}") for i, w in enumerate(words)])
    owners = marked.groupBy(*XYZ).agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(len(words))])
    parts = [F.array(*[F.struct(*_named(o)) for o in always])] if always else []
    for i, w in enumerate(words):
        hit = F.filter(_marked(w), _on(f"_w{i}"))
        parts.append(F.transform(hit, lambda o: F.struct(*[o[n].alias(n) for n in "ijk"])))
    spread = owners.select(*XYZ, F.explode(F.concat(*parts)).alias("_o"))
    return spread.select(*[(F.col(a) + F.col(f"_o.{n}")).alias(a) for a, n in zip(XYZ, "ijk")]).distinct()
