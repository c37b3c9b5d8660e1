"""End-to-end jobs: topology extraction, live cycle, completed structure, full recipe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from voxhive.functions.labels import STRUCTURE_LABELS
from voxhive.operators import completion as cp, field as fd, graph as gr, objects as obj, observation as ob
from voxhive.operators import placement as pl, scene as sg, surface as sf, voxels as vx
from voxhive.operators.thinning import thin
from voxhive.session import cut

XYZ = vx.XYZ
MIN_OCCUPIED = 500


@dataclass
class TopologyConfig:
    """Thresholds of the topology job, in metres unless named otherwise."""

    min_component: int = 30
    d_min: float = 0.20
    theta_sep: float = 0.40
    band_max: float | None = None
    merge_radius_m: float = 0.15
    prune_spurs_m: float = 0.3
    merge_close_m: float = 0.2
    drop_small_nodes: int = 5
    rooms: str = "clearance"  # or "modularity"
    room_resolution: float = 1.0
    door_clearance_m: float = 0.85
    min_room_nodes: int = 8
    object_min_voxels: int = 20
    structure: tuple[int, ...] = STRUCTURE_LABELS


@dataclass
class Topology:
    nodes: DataFrame
    edges: DataFrame
    objects: DataFrame
    skeleton: DataFrame
    tiles: DataFrame


def extract_topology(cells: DataFrame, free: DataFrame, voxel_size: float, cfg: TopologyConfig = TopologyConfig()) -> Topology:
    """Occupied labelled cells and free cells to places, rooms, objects and tiles."""
    solid = cut(vx.drop_small_components(cells.select(*XYZ, "label"), cfg.min_component))
    box = vx.bounds(cells, 1)
    open_cells = vx.clip(free.select(*XYZ), box).join(cells.select(*XYZ), XYZ, "left_anti")
    field = fd.distance_field(open_cells, solid, voxel_size)
    if cfg.band_max:
        field = field.where(F.col("dist_m") <= cfg.band_max)
    ridge = cut(fd.voronoi_cells(cut(field), voxel_size, cfg.d_min, cfg.theta_sep))
    skeleton = cut(thin(ridge).join(ridge, XYZ))
    nodes, edges = gr.skeleton_to_graph(skeleton, voxel_size, cfg.merge_radius_m)
    nodes, edges = gr.prune_spurs(nodes, edges, cfg.prune_spurs_m)
    nodes, edges = gr.merge_close(nodes, edges, cfg.merge_close_m, voxel_size)
    nodes, edges = gr.drop_small_graph_parts(nodes, edges, cfg.drop_small_nodes)
    nodes, edges = cut(nodes), cut(edges)
    if cfg.rooms == "modularity":
        rooms = gr.rooms_by_modularity(nodes, edges, cfg.room_resolution)
        nodes = nodes.join(rooms, "id")
    else:
        rooms = gr.rooms_by_clearance(nodes, edges, cfg.door_clearance_m, cfg.min_room_nodes)
        nodes = gr.merge_nested_rooms(nodes.join(rooms, "id"), voxel_size)
    nodes = cut(nodes)
    found = cut(obj.extract_objects(solid, voxel_size, cfg.structure, cfg.object_min_voxels))
    near = obj.nearest_node(
        found.select(F.col("object_id").alias("qid"), *[(F.col(n) * voxel_size).alias(a) for a, n in zip(XYZ, "ijk")]),
        nodes.select("id", *[(F.col(n) * voxel_size).alias(a) for a, n in zip(XYZ, "ijk")]))
    linked = found.join(near.select(F.col("qid").alias("object_id"), F.col("id").alias("place_id")), "object_id", "left")
    return Topology(nodes, edges, linked, skeleton, sf.surface_tiles(open_cells, solid, voxel_size))


def as_scene_objects(objects: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Object rows in the shape the scene graph expects."""
    label = F.col("label").cast("int")
    name = label.cast("string")
    if names:
        table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
        name = F.coalesce(F.element_at(table, label), name)
    return objects.withColumns({
        "seq": F.col("object_id"), "class": label, "label_name": name,
        "oid": F.concat(F.lit("object:"), F.lpad(F.lower(F.hex("object_id")), 8, "0"))})


def update_scene(obs: DataFrame, scene: DataFrame | None, voxel_size: float, names: dict[int, str] | None = None,
                 cfg: TopologyConfig = TopologyConfig(), first_new: int = 0):
    """One cycle: map to scene graph, merged into the previous one.

    Returns (scene, stats or None); the scene is unchanged while too few cells are
    occupied.
    """
    occupied = cut(ob.occupied(obs))
    if occupied.limit(MIN_OCCUPIED).count() < MIN_OCCUPIED:
        return scene, None
    top = extract_topology(occupied, ob.observed_free(obs), voxel_size, cfg)
    fresh = cut(as_scene_objects(top.objects, names))
    if scene is None:
        return sg.build_scene_graph(top.nodes, fresh, voxel_size), None
    return sg.merge_observation(scene, top.nodes, fresh, voxel_size, first_new=first_new)


DEFAULT_RULES = lambda: [
    cp.SlabFill(label=3, side="floor"), cp.SlabFill(label=4, side="ceiling"), cp.WallFill(), cp.StairsFill(),
    cp.OcclusionFill(), cp.PlaneRegularize(), cp.RoofCap(), cp.OpeningCarve(),
]


def complete_structure(
    obs: DataFrame, voxel_size: float, rules: list[cp.Generator] | None = None, coarsen_to_m: float | None = None,
    drop_unlabelled: bool = True, clean: bool = True, min_component: int = 2, close_radius: int = 0,
    keep_largest: bool = True, dangle_iterations: int = 2,
) -> DataFrame:
    """Run the rules, apply their changes, coarsen and clean: x, y, z, label.

    Unlabelled cells go before cleaning, so the debris they leave is cleaned too.
    """
    log = cp.run_generators(obs, rules if rules is not None else DEFAULT_RULES(), voxel_size)
    cells = cp.compose(obs, log)
    if coarsen_to_m:
        cells = vx.coarsen(cells, max(1, round(coarsen_to_m / voxel_size))).select(*XYZ, "label")
    if drop_unlabelled:
        cells = cells.where("label <> 0")
    if clean:
        cells = vx.clean_coarse(cells, min_component, close_radius, keep_largest)
        if dangle_iterations:
            cells = vx.prune_dangles(cells, dangle_iterations)
    return cells


def build_completed_world(
    obs: DataFrame, voxel_size: float, small: DataFrame | None = None, extents: DataFrame | None = None, coarse: float = 0.2,
):
    """Full recipe: instantiate objects, place them, take them out, complete what remains.

    ``extents`` (mc_item, model_x, model_y, model_z) are the sizes of drawn models; floors
    and ceilings are met at blocks of ``coarse`` metres.  Returns (structure cells, models).
    """
    from voxhive.functions.labels import DYNAMIC_LABELS, MODEL_LABELS, SMALL_OBJECT_LABELS

    obs = cut(obs)
    labels = tuple(l for l in MODEL_LABELS if small is None or l not in SMALL_OBJECT_LABELS)
    cells = ob.occupied(obs)
    models, used = obj.object_models(cells, voxel_size, labels=labels)
    sized = models.join(extents, "mc_item", "left") if extents is not None else models
    models = pl.resolve_placements(sized, cells, voxel_size, coarse)
    other = cells.where(F.col("label").isin(*SMALL_OBJECT_LABELS, *DYNAMIC_LABELS)).select(*XYZ)
    structure = ob.decouple(obs, used.select(*XYZ).union(other).distinct())
    if small is not None:
        models = models.unionByName(obj.snap_small_to_support(small, models), allowMissingColumns=True)
    return complete_structure(structure, voxel_size, coarsen_to_m=coarse), models
