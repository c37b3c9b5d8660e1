"""Export jobs: observation map to world, object boxes onto voxels, post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxhive.functions.geometry import point_in_obb
from voxhive.operators import observation as ob, voxels as vx
from voxhive.operators.objects import extract_entities
from voxhive.session import by_sorting

XYZ = vx.XYZ


def overlay_boxes(voxels: DataFrame, boxes: DataFrame, tile: float = 4.0) -> DataFrame:
    """Material of the last box (by ``seq``) that contains each voxel centre.

    ``boxes``: seq, cx, cy, cz, hx, hy, hz, qx, qy, qz, qw, material. Boxes are
    spread over the tiles of their bounding sphere's cube and meet voxels there by
    an equi-join; the oriented test follows.
    """
    reach = F.sqrt(F.col("hx") ** 2 + F.col("hy") ** 2 + F.col("hz") ** 2)
    t = lambda c: F.floor(c / F.lit(tile)).cast("bigint")
    spread = boxes
    for a in XYZ:
        spread = spread.withColumn(f"t{a}", F.explode(F.sequence(t(F.col(f"c{a}") - reach), t(F.col(f"c{a}") + reach))))
    placed = voxels.select(*XYZ, *[t(F.col(a)).alias(f"t{a}") for a in XYZ])
    inside = placed.join(by_sorting(spread), ["tx", "ty", "tz"]).where(
        point_in_obb("x", "y", "z", ("cx", "cy", "cz"), ("hx", "hy", "hz"), ("qx", "qy", "qz", "qw")))
    return inside.groupBy(*XYZ).agg(F.max_by("material", "seq").alias("material"))


def world_cells(cells: DataFrame, material_of: dict[int, int] | None = None, label: str = "label") -> DataFrame:
    """Occupied labelled cells as world voxels; unknown classes use material 1."""
    sem = F.col(label).cast("smallint")
    if material_of is None:
        material = F.when(sem == 0, 1).otherwise(sem)
    else:
        table = F.create_map(*[F.lit(v) for kv in material_of.items() for v in kv])
        material = F.coalesce(F.element_at(table, sem.cast("int")), F.lit(1))
    return cells.select(*XYZ, material.cast("smallint").alias("material_id"), sem.alias("semantic_id"),
                        F.lit(0).cast("smallint").alias("state"), F.lit(0).cast("smallint").alias("color_palette_idx"))


def observation_to_world(obs: DataFrame, voxel_size: float, material_of: dict[int, int] | None = None,
                         eps: float = 2.0, min_samples: int = 10):
    """(structure voxels, entities, spawn hint) of an observation map."""
    known = ob.occupied(obs).where("label <> 0")
    entities, structure = extract_entities(known, voxel_size, eps=eps, min_samples=min_samples)
    return world_cells(structure, material_of), entities, vx.spawn_hint(structure, voxel_size)


def postprocess_world(voxels: DataFrame, iterations: int = 1) -> DataFrame:
    """Close holes in a world; new voxels take material and class of the nearest one."""
    closed = vx.close_holes(voxels.select(*XYZ, F.struct("material_id", "semantic_id").alias("label")), iterations)
    return closed.select(*XYZ, "label.material_id", "label.semantic_id", "filled")
