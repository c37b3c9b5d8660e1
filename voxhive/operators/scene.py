"""Hierarchical scene graph: building > rooms > places and objects.

One row per node: ``seq, id, layer, label, x, y, z, parent`` plus object columns
``class, voxel_count, bbox (min_*/max_* in metres), place_id, misses, seen_count,
shape_*``. Children are derived by grouping on ``parent``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxhive.operators.components import with_component
from voxhive.operators.features import ObjectFeature, cost_terms, vector_cost
from voxhive.operators.objects import BOX, box_links
from voxhive.operators.voxels import XYZ
from voxhive.session import cut, spread

NODE_COLS = ["seq", "id", "layer", "label", *XYZ, "parent"]
OBJECT_COLS = ["class", "voxel_count", *BOX, "place_id", "misses", "seen_count", "shape_0", "shape_1", "shape_2"]
MAX_JUMPS = 40
SUPPORT_GAP_M = 0.20


# ---------------------------------------------------------------- tree walks
def room_of(nodes: DataFrame) -> DataFrame:
    """(id, room): the room above each node, NULL if there is none.

    Pointer doubling: a chain of depth d resolves in log2(d) joins. Nodes whose
    parent is a room are done after one join with the few rooms. A cycle never
    reaches a room and ends as NULL.
    """
    rooms = nodes.where("layer = 'room'").select(F.col("id").alias("parent"), F.lit(True).alias("in_room"))
    start = nodes.select("id", "layer", "parent").join(rooms, "parent", "left")
    state = cut(start.select(
        "id",
        F.when(F.col("layer") == "room", F.col("id")).otherwise(F.col("parent")).alias("at"),
        ((F.col("layer") == "room") | F.col("parent").isNull() | F.coalesce("in_room", F.lit(False))).alias("done"),
        ((F.col("layer") == "room") | F.coalesce("in_room", F.lit(False))).alias("found"),
    ))
    for _ in range(MAX_JUMPS):
        if state.where("NOT done").isEmpty():
            break
        hop = state.select(F.col("id").alias("at"), F.col("at").alias("next"),
                           F.col("done").alias("ndone"), F.col("found").alias("nfound"))
        moved = state.where("NOT done").join(hop, "at", "left").select(
            "id", F.col("next").alias("at"),
            F.coalesce("ndone", F.lit(True)).alias("done"), F.coalesce("nfound", F.lit(False)).alias("found"),
        )
        state = cut(state.where("done").union(moved))
    return state.select("id", F.when(F.col("found"), F.col("at")).alias("room"))


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(id, depth, ancestor, layer) for the ids in ``start``, nearest first; a cycle of parents raises an error."""
    deepest = nodes.count()
    links = nodes.select(F.col("id").alias("ancestor"), "layer", F.col("parent").alias("up"))
    here = start.select("id").join(nodes.select("id", "parent"), "id").select("id", F.col("parent").alias("up0"))
    out, depth = None, 0
    while True:
        depth += 1
        if depth > deepest + 1:
            raise ValueError("the parents of the scene form a cycle")
        level = cut(here.join(links, F.col("up0") == F.col("ancestor")).select(
            "id", F.lit(depth).alias("depth"), "ancestor", "layer", "up"))
        if level.isEmpty():
            break
        out = level if out is None else out.union(level)
        here = level.where("up IS NOT NULL").select("id", F.col("up").alias("up0"))
    if out is None:
        out = here.select("id", F.lit(0).alias("depth"), F.col("id").alias("ancestor"), F.lit("").alias("layer"),
                          F.col("up0").alias("up")).where("false")
    return out.drop("up")


def descendants(nodes: DataFrame, root_id: str) -> DataFrame:
    """All nodes below one node, with their depth."""
    links = nodes.select("id", "layer", "parent")
    level = links.where(F.col("parent") == root_id).withColumn("depth", F.lit(1))
    out, depth = None, 1
    while True:
        level = cut(level)
        if level.isEmpty():
            return out if out is not None else level
        out = level if out is None else out.union(level)
        depth += 1
        up = level.select(F.col("id").alias("parent"))
        level = links.join(up, "parent").select("id", "layer", "parent", F.lit(depth).alias("depth"))


def objects_in_room(nodes: DataFrame, room_id: str) -> DataFrame:
    return descendants(nodes, room_id).where("layer = 'object'")


# ---------------------------------------------------------------- edits
def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Append nodes; a clashing id is an error."""
    clash = new.join(nodes.select("id"), "id", "left_semi").select("id").limit(1).collect()
    if clash:
        raise ValueError(f"node id exists: {clash[0][0]}")
    return nodes.unionByName(new, allowMissingColumns=True)


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite the columns present in ``changes`` (by id) where not NULL."""
    cols = [c for c in changes.columns if c != "id"]
    patch = changes.select("id", *[F.col(c).alias(f"_{c}") for c in cols])
    out = nodes.join(patch, "id", "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in nodes.columns])


def remove_nodes(nodes: DataFrame, ids: DataFrame, reparent: bool = True) -> DataFrame:
    """Drop nodes; their children go to the nearest surviving ancestor, or loose."""
    gone = ids.select(F.col("id").alias("parent"))
    heir = cut(nodes.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("parent"), F.col("parent").alias("heir")))
    while reparent:
        hop = heir.select(F.col("parent").alias("heir"), F.col("heir").alias("next"), F.lit(True).alias("hit"))
        step = heir.join(hop, "heir", "left")
        if step.where("hit").isEmpty():
            break
        heir = cut(step.select("parent", F.when(F.col("hit"), F.col("next")).otherwise(F.col("heir")).alias("heir")))
    kept = nodes.join(gone, nodes["id"] == gone["parent"], "left_anti")
    moved = kept.join(heir.withColumn("hit", F.lit(True)), "parent", "left")
    new = F.when(F.col("hit"), F.col("heir") if reparent else F.lit(None)).otherwise(F.col("parent"))
    return moved.withColumn("parent", new).select(nodes.columns)


# ---------------------------------------------------------------- support
def support_of(objects: DataFrame, gap_m: float = SUPPORT_GAP_M, tile: float = 2.0) -> DataFrame:
    """(id, support): the object each one rests on.

    The underside must lie on or just above the other's top, with floor overlap;
    the highest top wins, then the earliest object. Tops are bucketed by the gap,
    so the join key is (floor tile, height bucket), never a bare range.
    """
    t = lambda c: F.floor(F.col(c) / F.lit(tile)).cast("bigint")
    level = lambda c: F.floor(c / F.lit(gap_m)).cast("bigint")
    base = objects.select("seq", "id", *BOX)
    def tiles(df: DataFrame) -> DataFrame:
        df = df.withColumn("tx", F.explode(F.sequence(t("min_x"), t("max_x"))))
        return df.withColumn("tz", F.explode(F.sequence(t("min_z"), t("max_z"))))
    same = ["min_x", "max_x", "min_z", "max_z", "max_y"]
    tops = tiles(base).select(
        "tx", "tz", level(F.col("max_y")).alias("lv"), F.col("seq").alias("k_seq"), F.col("id").alias("support"),
        *[F.col(c).alias(f"k_{c}") for c in same],
    )
    near = base.withColumn("lv", F.explode(F.array(level(F.col("min_y")), level(F.col("min_y")) - 1, level(F.col("min_y")) - 2)))
    pairs = tiles(near).join(tops, ["tx", "tz", "lv"]).where(
        (F.col("id") != F.col("support"))
        & (F.col("k_max_y") <= F.col("min_y")) & (F.col("min_y") <= F.col("k_max_y") + F.lit(gap_m))
        & (F.col("max_x") >= F.col("k_min_x")) & (F.col("min_x") <= F.col("k_max_x"))
        & (F.col("max_z") >= F.col("k_min_z")) & (F.col("min_z") <= F.col("k_max_z"))
    )
    return pairs.groupBy("id").agg(F.max_by("support", F.struct("k_max_y", -F.col("k_seq"))).alias("support"))


def build_scene_graph(
    places: DataFrame, objects: DataFrame, voxel_size: float, world_id: str = "apartment",
    gap_m: float = SUPPORT_GAP_M,
) -> DataFrame:
    """Assemble the node table.

    ``places``: id, i, j, k, clearance_m, degree, room. ``objects``: oid, seq,
    label_name, class, i, j, k, box in cells, voxel_count, place_id, shape_*.
    """
    vs = F.lit(float(voxel_size))
    none = lambda t: F.lit(None).cast(t)
    blank = {c: none("double") for c in [*BOX, "shape_0", "shape_1", "shape_2"]}
    blank |= {c: none("bigint") for c in ("class", "voxel_count", "place_id", "misses", "seen_count")}
    place_at = places.select("id", "room", "clearance_m", "degree", *[(F.col(n) * vs).alias(a) for a, n in zip(XYZ, "ijk")])
    rooms = place_at.where("room >= 0").groupBy("room").agg(*[F.avg(a).alias(a) for a in XYZ])
    building = places.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("seq"), F.lit("building:0").alias("id"), F.lit("building").alias("layer"),
        F.lit(world_id).alias("label"), *[F.lit(0.0).alias(a) for a in XYZ], none("string").alias("parent"))
    room_rows = rooms.select(
        (F.lit(1 << 40) + F.col("room")).alias("seq"), F.concat(F.lit("room:"), "room").alias("id"),
        F.lit("room").alias("layer"), F.concat(F.lit("room_"), "room").alias("label"), *XYZ,
        F.lit("building:0").alias("parent"))
    place_rows = place_at.select(
        (F.lit(2 << 40) + F.col("id")).alias("seq"), F.concat(F.lit("place:"), "id").alias("id"),
        F.lit("place").alias("layer"), F.lit("").alias("label"), *XYZ,
        F.when(F.col("room") >= 0, F.concat(F.lit("room:"), "room")).otherwise(F.lit("building:0")).alias("parent"),
        "clearance_m", "degree")
    metric = objects.withColumns({c: F.col(c) * vs for c in BOX}).withColumns(
        {a: F.col(n) * vs for a, n in zip(XYZ, "ijk")})
    metric = cut(metric.withColumn("id", F.col("oid")))
    held = support_of(metric, gap_m)
    home = place_at.select(F.col("id").alias("place_id"), F.col("room").alias("place_room"))
    object_rows = (
        metric.join(held, "id", "left").join(home, "place_id", "left")
        .select(
            (F.lit(3 << 40) + F.col("seq")).alias("seq"), "id", F.lit("object").alias("layer"),
            F.col("label_name").alias("label"), *XYZ,
            F.coalesce("support", F.when(F.col("place_room") >= 0, F.concat(F.lit("room:"), "place_room")),
                       F.lit("building:0")).alias("parent"),
            F.col("class").cast("bigint").alias("class"), "voxel_count", *BOX, "place_id",
            F.lit(0).cast("bigint").alias("misses"), F.lit(1).cast("bigint").alias("seen_count"),
            "shape_0", "shape_1", "shape_2",
        )
    )
    graph = building.withColumns(blank).unionByName(room_rows.withColumns(blank))
    graph = graph.unionByName(place_rows.withColumns(blank), allowMissingColumns=True)
    return graph.unionByName(object_rows, allowMissingColumns=True)


# ---------------------------------------------------------------- identity
def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-cost one-to-one matching (shortest augmenting paths)."""
    return assign_by(cost.shape, lambda i: cost[i], lambda j: cost[:, j])


def assign_by(shape: tuple[int, int], row_cost: Callable[[int], np.ndarray], col_cost: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``assign`` of costs that are given a row or a column at a time; it holds no more than the sides are long."""
    flipped = shape[0] > shape[1]
    rows, cols = shape[::-1] if flipped else shape
    costs = col_cost if flipped else row_cost
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    holder = np.full(cols, -1)
    path_rows, path_cols = np.empty(rows + 1, np.int64), np.empty(rows + 1, np.int64)
    for row in range(rows):
        slack, via = np.full(cols, np.inf), np.full(cols, -1)
        closed = np.zeros(cols, dtype=bool)
        here, last, length = row, -1, 1
        path_rows[0] = row
        while True:
            reduced = costs(here) - row_price[here] - col_price
            closer = ~closed & (reduced < slack)
            slack[closer] = reduced[closer]
            via[closer] = last
            nxt = int(np.where(closed, np.inf, slack).argmin())
            step = slack[nxt]
            row_price[path_rows[:length]] += step
            col_price[path_cols[1:length]] -= step
            slack[~closed] -= step
            closed[nxt] = True
            last = nxt
            if holder[nxt] < 0:
                break
            here = int(holder[nxt])
            path_rows[length], path_cols[length] = here, nxt
            length += 1
        while last >= 0:
            before = via[last]
            holder[last] = holder[before] if before >= 0 else row
            last = before
    cols_used = np.flatnonzero(holder >= 0)
    pair = (holder[cols_used], cols_used)
    return pair[::-1] if flipped else pair


#: Costs of pairs that a task holds at once while it solves a class.
HELD_COSTS = 4_000_000


MATCH_COLS = ["x", "y", "z", "shape_0", "shape_1", "shape_2"]


def match_objects(
    existing: DataFrame, fresh: DataFrame, radius_m: float = 0.5, shape_weight: float = 2.0,
    group_cols: tuple[str, ...] = ("class",), features: tuple[ObjectFeature, ...] = (),
) -> DataFrame:
    """(fresh_id, id): best one-to-one pairing per class, then a radius gate.

    Cost = distance + weighted shape difference + cost of further ``features`` (columns
    ``feature_<name>`` on both sides, see ``extract_features``). The pairing is solved per class
    (of one world) in one task, which holds ``HELD_COSTS`` costs and finds others anew when it needs them; a task takes
    a bucket of classes.
    """

    terms, more = cost_terms(features), [f.column for f in features]
    classes = list(group_cols)

    def solve_class(a: np.ndarray, b: np.ndarray, va: dict[str, list], vb: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        def between(i: slice, j: slice) -> np.ndarray:
            dist = np.sqrt(((a[i, None, :3] - b[None, j, :3]) ** 2).sum(axis=2))
            shape = np.sqrt(((a[i, None, 3:] - b[None, j, 3:]) ** 2).sum(axis=2))
            shape = np.where(np.isnan(shape), 0.0, shape)
            return dist + shape_weight * shape + vector_cost(dist.shape, {c: v[i] for c, v in va.items()}, {c: v[j] for c, v in vb.items()}, terms)

        every = slice(None)
        if len(a) * len(b) <= HELD_COSTS:
            rows, cols = assign(between(every, every))
        else:
            row = lru_cache(max(1, HELD_COSTS // len(b)))(lambda i: between(slice(i, i + 1), every)[0])
            col = lru_cache(max(1, HELD_COSTS // len(a)))(lambda j: between(every, slice(j, j + 1))[:, 0])
            rows, cols = assign_by((len(a), len(b)), row, col)
        near = np.sqrt(((a[rows, :3] - b[cols, :3]) ** 2).sum(axis=1)) <= radius_m
        return rows[near], cols[near]

    def solve(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        """All classes of a bucket, one after the other; small classes would cost a call each."""
        none = pd.DataFrame({"fresh_id": [], "id": []}).astype(str)
        if old.empty or new.empty:
            return none
        number = pd.concat([old[classes], new[classes]]).groupby(classes, dropna=False, sort=False).ngroup().to_numpy()
        old = old.assign(_class=number[:len(old)]).sort_values(["_class", "seq"], kind="stable")
        new = new.assign(_class=number[len(old):]).sort_values(["_class", "seq"], kind="stable")
        a, b = old[MATCH_COLS].to_numpy(float), new[MATCH_COLS].to_numpy(float)
        kind_a, kind_b = old["_class"].to_numpy(), new["_class"].to_numpy()
        vectors = [{c: list(t[c]) for c in more} for t in (old, new)]
        found_old, found_new = [], []
        for kind in np.intersect1d(kind_a, kind_b):
            (i, j), (k, m) = (np.searchsorted(x, [kind, kind + 1]).tolist() for x in (kind_a, kind_b))
            rows, cols = solve_class(a[i:j], b[k:m], *({c: v[s:e] for c, v in t.items()} for t, s, e in ((vectors[0], i, j), (vectors[1], k, m))))
            found_old.append(rows + i)
            found_new.append(cols + k)
        if not found_old:
            return none
        return pd.DataFrame({"fresh_id": new["fresh_id"].to_numpy()[np.concatenate(found_new)], "id": old["id"].to_numpy()[np.concatenate(found_old)]})

    # one key type on both sides, so equal classes hash to the same bucket
    keys = [F.col(c).cast("string").alias(c) for c in group_cols]
    buckets = 16 * int(existing.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    left = existing.select(*keys, bucket, "seq", "id", *MATCH_COLS, *more)
    # own names: both sides may come from one table, and the co-group would then read the left one's columns twice
    right = fresh.select(*keys, bucket, "seq", "fresh_id", *MATCH_COLS, *[F.coalesce(c, F.lit(None)).alias(c) for c in more])
    return (
        spread(left, "_bucket").groupBy("_bucket")
        .cogroup(spread(right, "_bucket").groupBy("_bucket"))
        .applyInPandas(solve, schema="fresh_id string, id string")
    )


def merge_objects(
    existing: DataFrame, fresh: DataFrame, radius_m: float = 0.5, max_misses: int = 3, id_prefix: str = "object:",
    first_new: int = 0, features: tuple[ObjectFeature, ...] = (),
) -> DataFrame:
    """Object rows of the next graph, with ``status`` matched/added/carried/removed.

    ``existing``: object nodes. ``fresh``: same columns with ``fresh_id`` in place
    of ``id``. New objects get counter ids from ``first_new`` on.
    """
    from voxhive.operators.cluster import number_groups

    pairs = cut(match_objects(existing, fresh, radius_m, features=features))
    kept = fresh.join(pairs, "fresh_id", "left")
    old = existing.select("id", F.col("seen_count").alias("old_seen"))
    matched = kept.where("id IS NOT NULL").join(old, "id").withColumns({
        "misses": F.lit(0).cast("bigint"), "seen_count": F.coalesce("old_seen", F.lit(1)) + 1,
        "status": F.lit("matched")}).drop("old_seen")
    added = number_groups(kept.where("id IS NULL"), ["seq", "fresh_id"], "n", first_new).withColumns({
        "id": F.concat(F.lit(id_prefix), F.lpad(F.lower(F.hex("n")), 8, "0")), "misses": F.lit(0).cast("bigint"),
        "seen_count": F.lit(1).cast("bigint"), "status": F.lit("added")}).drop("n")
    unseen = existing.join(pairs, "id", "left_anti").withColumn("misses", F.coalesce("misses", F.lit(0)) + 1)
    carried = unseen.withColumn("status", F.when(F.col("misses") > max_misses, "removed").otherwise("carried"))
    return (
        matched.unionByName(added, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    )


def merge_stats(merged: DataFrame) -> DataFrame:
    n = lambda s: F.sum((F.col("status") == s).cast("bigint")).alias(s)
    return merged.agg(n("matched"), n("added"), n("removed"), n("carried"),
                      F.sum((F.col("status") != "removed").cast("bigint")).alias("objects_total"))


def merge_observation(
    existing: DataFrame, places: DataFrame, fresh: DataFrame, voxel_size: float, world_id: str = "apartment",
    gap_m: float = SUPPORT_GAP_M, radius_m: float = 0.5, max_misses: int = 3, first_new: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Next scene graph and merge statistics.

    The scaffold is rebuilt from ``places``; objects keep their identity; unseen
    objects are carried for ``max_misses`` rounds under their last room if it
    still exists.
    """
    vs = float(voxel_size)
    old = existing.where("layer = 'object'")
    metric = fresh.withColumns({a: F.col(n) * vs for a, n in zip(XYZ, "ijk")}).withColumn(
        "fresh_id", F.col("seq").cast("string"))
    result = cut(merge_objects(old, metric, radius_m, max_misses, first_new=first_new))
    alive = result.where("status IN ('matched', 'added')")
    graph = build_scene_graph(places, alive.withColumn("oid", F.col("id")), vs, world_id, gap_m)
    seen = alive.select("id", F.col("seen_count").alias("_seen"))
    graph = cut(graph.join(seen, "id", "left").withColumn("seen_count", F.coalesce("_seen", "seen_count")).drop("_seen"))
    last_room = room_of(existing).join(graph.where("layer = 'room'").select(F.col("id").alias("room")), "room", "left_semi")
    carried = result.where("status = 'carried'").drop("parent").join(last_room, "id", "left").withColumn(
        "parent", F.coalesce("room", F.lit("building:0"))).withColumn("layer", F.lit("object"))
    cols = [c for c in graph.columns if c in carried.columns]
    return graph.unionByName(carried.select(cols), allowMissingColumns=True), merge_stats(result)


def consolidate_fragments(
    nodes: DataFrame, gap_m: float = 0.15, min_persist: int = 2, tile: float = 8.0
) -> DataFrame:
    """Fuse same-class objects whose boxes stay close over several observations.

    The one with most voxels survives; boxes unite, voxels add up, positions are
    voxel-weighted means, children move to the survivor.
    """
    steady = nodes.where((F.col("layer") == "object") & (F.col("seen_count") >= min_persist) & F.col("min_x").isNotNull())
    links = box_links(steady, "id", ["class"], gap_m, tile)
    group = cut(with_component(steady.select("id"), links, "id", out="whole"))
    parts = steady.join(group, "id")
    weight = F.col("voxel_count")
    fused = parts.groupBy("whole").agg(
        F.max_by("id", F.struct("voxel_count", -F.col("seq"))).alias("keeper"), F.count(F.lit(1)).alias("parts"),
        F.sum("voxel_count").alias("_voxel_count"), F.max("seen_count").alias("_seen_count"),
        *[F.min(c).alias(f"_{c}") for c in BOX[:3]], *[F.max(c).alias(f"_{c}") for c in BOX[3:]],
        *[(F.sum(F.col(a) * weight) / F.sum(weight)).alias(f"_{a}") for a in XYZ],
    ).where("parts > 1")
    fused = cut(fused)
    heir = group.join(fused.select("whole", "keeper"), "whole").select("id", "keeper")
    absorbed = heir.where("id <> keeper")
    kept = nodes.join(absorbed.select("id"), "id", "left_anti")
    patch = fused.drop("whole", "parts").withColumnRenamed("keeper", "id")
    merged = kept.join(patch, "id", "left")
    cols = {c[1:] for c in patch.columns if c.startswith("_")}
    merged = merged.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in nodes.columns])
    moved = merged.join(absorbed.select(F.col("id").alias("parent"), "keeper"), "parent", "left")
    return moved.withColumn("parent", F.coalesce("keeper", "parent")).select(nodes.columns)


# ---------------------------------------------------------------- named questions
def _names(col: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(col)), ",")


def robot_pose(poses: DataFrame) -> DataFrame:
    """Latest pose by stamp."""
    return poses.agg(F.max_by(F.struct("stamp", "x", "y", "z"), "stamp").alias("p")).select("p.*")


def list_rooms(nodes: DataFrame) -> DataFrame:
    """Per room: centre, direct places, objects at any depth, kinds."""
    rooms = nodes.where("layer = 'room'").select(F.col("id").alias("room_id"), *XYZ)
    places = nodes.where("layer = 'place'").groupBy(F.col("parent").alias("room_id")).agg(
        F.count(F.lit(1)).alias("place_count"))
    inside = nodes.where("layer = 'object'").select("id", "label").join(room_of(nodes), "id").groupBy(
        F.col("room").alias("room_id")).agg(F.count(F.lit(1)).alias("object_count"), _names(F.col("label")).alias("object_kinds"))
    return rooms.join(places, "room_id", "left").join(inside, "room_id", "left").select(
        "room_id", *XYZ, F.coalesce("place_count", F.lit(0)).alias("place_count"),
        F.coalesce("object_count", F.lit(0)).alias("object_count"), F.coalesce("object_kinds", F.lit("")).alias("object_kinds"))


def room_contents(nodes: DataFrame, room_id: str) -> DataFrame:
    """Objects of a room; an unknown room is an error naming the known ones."""
    if nodes.where((F.col("id") == room_id) & (F.col("layer") == "room")).isEmpty():
        known = [r[0] for r in nodes.where("layer = 'room'").select("id").orderBy("id").limit(50).collect()]
        raise ValueError(f"no such room: {room_id}; available: {known}")
    where = room_of(nodes).where(F.col("room") == room_id)
    return nodes.where("layer = 'object'").join(where, "id", "left_semi").select(
        "id", F.col("label").alias("name"), *XYZ, "voxel_count", "seen_count",
        F.when(F.col("parent").startswith("object"), F.col("parent")).alias("on_top_of"))


def find_object(nodes: DataFrame, name: str) -> DataFrame:
    """Case-insensitive substring search over object names."""
    hits = nodes.where("layer = 'object'").where(F.contains(F.lower("label"), F.lit(name.lower())))
    return hits.join(room_of(nodes), "id").select(
        "id", F.col("label").alias("name"), *XYZ, "room", "voxel_count", "seen_count")


def get_object(nodes: DataFrame, object_id: str) -> DataFrame:
    """One object with its room, parent layer and children."""
    kids = nodes.where(F.col("parent") == object_id).agg(_names(F.col("id")).alias("children"))
    layers = nodes.select(F.col("id").alias("parent"), F.col("layer").alias("parent_layer"))
    one = nodes.where((F.col("id") == object_id) & (F.col("layer") == "object"))
    chain = ancestors(nodes, one.select("id")).where("layer = 'room'").groupBy("id").agg(
        F.min_by("ancestor", "depth").alias("room"))
    return one.join(chain, "id", "left").join(layers, "parent", "left").crossJoin(F.broadcast(kids)).select(
        "id", F.col("label").alias("name"), "class", *XYZ, "voxel_count", "seen_count", "misses", "room", "parent",
        "parent_layer", "children")


def get_relations(nodes: DataFrame, node_id: str) -> DataFrame:
    """Ancestors (role, depth) and children of a node."""
    up = ancestors(nodes, nodes.where(F.col("id") == node_id).select("id")).select(
        F.lit("ancestor").alias("role"), "depth", F.col("ancestor").alias("id"), "layer")
    down = nodes.where(F.col("parent") == node_id).select(F.lit("child").alias("role"), F.lit(1).alias("depth"), "id", "layer")
    return up.union(down)


def scene_summary(nodes: DataFrame) -> DataFrame:
    """Nodes per layer."""
    return nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"))


def stacked_objects(nodes: DataFrame) -> DataFrame:
    """Objects resting on objects, with the support's name."""
    base = nodes.select(F.col("id").alias("parent"), F.col("label").alias("support_name"))
    on = nodes.where("layer = 'object'").where(F.col("parent").startswith("object"))
    return on.join(base, "parent").select("id", F.col("label").alias("name"), F.col("parent").alias("on_top_of"), "support_name")


def robot_room(nodes: DataFrame, pose: DataFrame) -> DataFrame:
    """Room of the place nearest the robot (floor plane), with its objects."""
    places = nodes.where("layer = 'place'")
    d2 = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2
    robot = pose.select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = places.crossJoin(F.broadcast(robot)).agg(
        F.min_by(F.struct("id", F.sqrt(d2).alias("d")), F.struct(d2, "seq")).alias("p")).select(
        F.col("p.id").alias("via_place"), F.col("p.d").alias("distance_m"))
    rooms = cut(room_of(nodes))
    at = near.join(rooms.select(F.col("id").alias("via_place"), "room"), "via_place")
    inside = nodes.where("layer = 'object'").select("id", "label").join(rooms, "id")
    found = at.join(inside, "room", "left").groupBy("room", "via_place", "distance_m").agg(
        F.count("id").alias("object_count"), _names(F.col("label")).alias("objects"))
    return found.withColumnRenamed("room", "room_id")
