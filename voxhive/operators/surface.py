"""Walkable floor: tiles, occupancy grids, floor regions and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxhive.functions.cells import offset_array
from voxhive.operators.cluster import CORNER, label_components, number_groups
from voxhive.operators.components import with_component
from voxhive.operators.voxels import XYZ
from voxhive.session import cut

RING_2D = [(i, j, 0) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def surface_tiles(free: DataFrame, solid: DataFrame, voxel_size: float, clearance: int = 4) -> DataFrame:
    """Floor tiles under a fully free column of ``clearance`` cells.

    Floor height is the 3rd percentile of the obstacle heights.
    """
    base = solid.agg(F.floor(F.percentile("y", 0.03)).cast("bigint").alias("y_floor"))
    band = free.select(*XYZ).distinct().crossJoin(F.broadcast(base)).where(
        (F.col("y") > F.col("y_floor")) & (F.col("y") <= F.col("y_floor") + clearance))
    full = band.groupBy("x", "z", "y_floor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == clearance)
    vs = F.lit(float(voxel_size))
    return full.select(
        ((F.col("x") + 0.5) * vs).alias("px"), ((F.col("y_floor") + 1.0) * vs).alias("py"), ((F.col("z") + 0.5) * vs).alias("pz"))


def occupancy_cost(surface_hits: Column | str, obstacle_hits: Column | str, surface_min: int = 1, obstacle_min: int = 2) -> Column:
    """0 walkable, 100 blocked, -1 unknown."""
    s, o = (F.col(c) if isinstance(c, str) else c for c in (surface_hits, obstacle_hits))
    return F.when(o >= obstacle_min, 100).when(s >= surface_min, 0).otherwise(-1)


def hit_grid(points: DataFrame, resolution: float, surface: tuple[int, ...], invalid: tuple[int, ...] = (0,)) -> DataFrame:
    """Surface and obstacle hits per floor cell, with the cost value.

    ``points``: px, py, label.
    """
    gx, gy = (F.floor(F.col(c) / F.lit(resolution)).cast("bigint").alias(n) for c, n in (("px", "gx"), ("py", "gy")))
    is_surface = F.col("label").isin(*surface)
    hits = points.where(~F.col("label").isin(*invalid)).select(gx, gy, is_surface.cast("bigint").alias("s"))
    grid = hits.groupBy("gx", "gy").agg(F.sum("s").alias("surf"), F.sum(1 - F.col("s")).alias("obst"))
    return grid.withColumn("cost", occupancy_cost("surf", "obst"))


def surface_places(
    walkable: DataFrame, resolution: float, min_cells: int = 15, door_m: float = 0.9, blocked: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Walkable regions and which of them connect through a door.

    8-connected components of (gx, gy). A region grows ring by ring through
    non-blocked cells, ``door_m`` far; reaching another region links the two.
    Growth stays inside the bounding box of the grid, as on an array.
    """
    cells = walkable.select(F.col("gx").alias("x"), F.col("gy").alias("y"), F.lit(0).cast("bigint").alias("z"))
    parts = label_components(cells, CORNER)
    size = parts.groupBy("component").agg(
        F.count(F.lit(1)).alias("cell_count"), F.avg("x").alias("mx"), F.avg("y").alias("my")
    ).where(F.col("cell_count") >= min_cells)
    # regions are numbered in row-major order of the image: y first
    first = parts.groupBy("component").agg(F.min(F.struct("y", "x")).alias("first"))
    ranked = number_groups(size.join(first, "component").select(
        "component", "cell_count", "mx", "my", F.col("first.y").alias("fy"), F.col("first.x").alias("fx")), ["fy", "fx"], "id")
    ranked = cut(ranked)
    regions = ranked.select(
        "id", ((F.col("mx") + 0.5) * resolution).alias("cx"), ((F.col("my") + 0.5) * resolution).alias("cy"),
        (F.col("cell_count") * (resolution * resolution)).alias("area_m2"), "cell_count")
    member = cut(parts.join(ranked.select("component", "id"), "component").select("id", *XYZ))
    box = cells.union(blocked.select(F.col("gx"), F.col("gy"), F.lit(0).cast("bigint")) if blocked is not None else cells.where("false"))
    box = box.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    walls = blocked.select(F.col("gx").alias("x"), F.col("gy").alias("y")) if blocked is not None else None
    reach = frontier = member
    for _ in range(max(int(round(door_m / resolution)), 1)):
        grown = frontier.select("id", *XYZ, F.explode(offset_array(RING_2D)).alias("o")).select(
            "id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "z").distinct()
        grown = grown.crossJoin(F.broadcast(box)).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select("id", *XYZ)
        if walls is not None:
            grown = grown.join(walls, ["x", "y"], "left_anti").select("id", *XYZ)
        frontier = cut(grown.join(reach, ["id", *XYZ], "left_anti"))
        reach = reach.union(frontier)
    other = member.select(F.col("id").alias("other"), *XYZ)
    edges = reach.join(other, XYZ).where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    return regions, edges


def roadmap_components(regions: DataFrame, edges: DataFrame) -> DataFrame:
    return with_component(regions.select("id"), edges, "id", "a", "b")


def level_histogram(points: DataFrame, bin_m: float) -> DataFrame:
    """Heights of surface points per bin: the only thing level finding needs."""
    return points.groupBy(F.floor(F.col("pz") / F.lit(bin_m)).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pz").alias("z_sum"))


def level_hits(points: DataFrame, levels: DataFrame, resolution: float, gap_m: float, ground_eps: float, robot_h: float) -> DataFrame:
    """Surface and obstacle hits per (level, gx, gy), lowest floor height included.

    ``levels``: level, rep_z - at most a handful of floors, so a broadcast.
    ``points``: px, py, pz, is_surface.
    """
    cell = points.select(
        F.floor(F.col("px") / F.lit(resolution)).cast("bigint").alias("gx"),
        F.floor(F.col("py") / F.lit(resolution)).cast("bigint").alias("gy"), "pz", "is_surface",
    )
    # fold equal rows first, then match floors
    table = levels.agg(F.sort_array(F.collect_list(F.struct("rep_z", "level"))).alias("lv"))
    both = cell.crossJoin(F.broadcast(table))
    gap = lambda l: F.abs(F.col("pz") - l["rep_z"])
    nearest = F.array_min(F.transform("lv", lambda l: F.struct(gap(l).alias("d"), l["level"].alias("level"))))
    surf = both.where("is_surface").withColumn("m", nearest).where(F.col("m.d") <= gap_m).select(
        F.col("m.level").alias("level"), "gx", "gy", F.lit(1).alias("s"), F.lit(0).alias("o"), "pz")
    band = both.where("NOT is_surface").select("gx", "gy", "pz", F.explode(F.filter(
        "lv", lambda l: (F.col("pz") > l["rep_z"] + ground_eps) & (F.col("pz") < l["rep_z"] + robot_h))).alias("l"))
    obst = band.select(F.col("l.level").alias("level"), "gx", "gy", F.lit(0).alias("s"), F.lit(1).alias("o"), F.lit(None).cast("double").alias("pz"))
    out = surf.union(obst).groupBy("level", "gx", "gy").agg(
        F.sum("s").alias("surf"), F.sum("o").alias("obst"), F.min("pz").alias("floor_z"))
    return out.withColumn("cost", occupancy_cost("surf", "obst"))


def assign_levels(surface: DataFrame, gap_m: float = 0.5, min_points: int = 200, max_levels: int | None = None) -> DataFrame:
    """(level, rep_z): floors found from the lowest remaining band upwards.

    A band opens a level if it holds enough points; its height is the band's
    median. One aggregate per floor; ``max_levels`` may bound them.
    """
    spark = surface.sparkSession
    levels: list[float] = []
    while max_levels is None or len(levels) < max_levels:
        rest = surface.select("pz")
        for z in levels:
            rest = rest.where(F.abs(F.col("pz") - F.lit(z)) > gap_m)
        low = rest.agg(F.min("pz"), F.count(F.lit(1))).first()
        if low[1] < min_points:
            break
        band = rest.where(F.col("pz") <= low[0] + gap_m).agg(F.percentile("pz", 0.5), F.count(F.lit(1))).first()
        if band[1] < min_points:
            break
        levels.append(band[0])
    rows = [(i, z) for i, z in enumerate(sorted(levels))]
    return spark.createDataFrame(rows, "level int, rep_z double")
