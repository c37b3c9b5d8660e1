"""Voxel index arithmetic.

All tables carry world voxel indices (BIGINT), never array offsets, so cropping
and padding need no bookkeeping. A cell's identity is the struct (x, y, z), which
sorts in raster order (x slowest), so "first cell in scan order" is a plain ``min``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AXES = ("x", "y", "z")


def floor_div(value: Column | str, size: int) -> Column:
    """Floor division (Spark's ``div`` truncates towards zero)."""
    col = F.col(value) if isinstance(value, str) else value
    return F.floor(col / F.lit(size)).cast("bigint")


def floor_mod(value: Column | str, size: int) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.pmod(col, F.lit(size)).cast("bigint")


def voxel_index(metres: Column | str, voxel_size: float) -> Column:
    """Index of the cell holding a coordinate: floor(p / size)."""
    col = F.col(metres) if isinstance(metres, str) else metres
    return F.floor(col / F.lit(float(voxel_size))).cast("bigint")


def rounded_index(metres: Column | str, voxel_size: float) -> Column:
    """Index used by mesh import and the editor: nearest grid point."""
    col = F.col(metres) if isinstance(metres, str) else metres
    return F.floor(col * F.lit(1.0 / float(voxel_size)) + F.lit(0.5)).cast("bigint")


def chunk_of(value: Column | str, extent: int) -> Column:
    return floor_div(value, extent)


def local_of(value: Column | str, extent: int) -> Column:
    return floor_mod(value, extent)


def cell_id(x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> Column:
    """Identity of a cell: a struct that sorts in raster order, over the whole BIGINT range."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (x, y, z)]
    return F.struct(*[c.cast("bigint").alias(a) for c, a in zip(cols, AXES)])


def last_first(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """Ordering columns for maxima whose ties go to the first cell in scan order."""
    return [(-F.col(c)).alias(f"neg_{a}") for c, a in zip((x, y, z), AXES)]


def offset_array(offsets: list[tuple[int, int, int]]) -> Column:
    """Literal array of offset structs, to be exploded next to a voxel table."""
    return F.array(
        *[
            F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz"))
            for dx, dy, dz in offsets
        ]
    )


def ball_offsets(radius2: float, include_origin: bool = False) -> list[tuple[int, int, int]]:
    """Integer offsets with squared length up to ``radius2``."""
    reach = int(radius2**0.5 + 1e-9)
    span = range(-reach, reach + 1)
    return [
        (dx, dy, dz)
        for dx in span
        for dy in span
        for dz in span
        if dx * dx + dy * dy + dz * dz <= radius2 + 1e-9
        and (include_origin or (dx, dy, dz) != (0, 0, 0))
    ]


FACES = ball_offsets(1)
NEIGHBOURS_26 = ball_offsets(3)


def centre(index: Column | str, voxel_size: float, half: bool = True) -> Column:
    """Metric position of a cell: its centre, or its low corner (``half=False``)."""
    col = F.col(index) if isinstance(index, str) else index
    return (col + F.lit(0.5 if half else 0.0)) * F.lit(float(voxel_size))
