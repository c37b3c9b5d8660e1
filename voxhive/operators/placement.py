"""Placement of object models: snapped to floors, ceilings and other objects, pushed out of walls, separated.

Objects: id, pos_x..pos_z (observed centre), dim_x..dim_z (observed size), mount
(``floor``, ``wall``, ``ceiling``) and, where the model that is drawn has another size,
model_x..model_z.  Cells: x, y, z, label of the occupied map.  Lengths are metres.

Snapping follows the supports: an object waits for every object it may stand on, so the
table is placed level by level, all stacks at once.  Separation works on contact
components, which never hold the whole table; a component that pushes something into
another one is solved again together with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxhive.functions.labels import STRUCTURE_LABELS
from voxhive.operators.components import with_component
from voxhive.operators.objects import box_links
from voxhive.session import cut, spread

AXES = ("x", "y", "z")
#: Sideways reach of the surface search, its depth, and the longest push.
REACH_M, DEPTH_M, PUSH_M = 0.4, 3.0, 0.5
#: An object stands on another one if its bottom lies this far around that one's top, and its centre over it.
BELOW_M, ABOVE_M, EDGE_M = 0.35, 0.75, 0.05
#: Cells along the side of a tile in which objects and cells meet.
TILE = 16
SWEEPS = 3


def _cell(c: Column, vs: float) -> Column:
    return F.floor(c / F.lit(vs)).cast("bigint")


def _tiles(low: Column, high: Column) -> Column:
    """Tiles of the cells low .. high - 1."""
    at = lambda c: F.floor(c / F.lit(TILE)).cast("bigint")
    return F.explode(F.when(low < high, F.sequence(at(low), at(high - 1))))


def _tiled(cells: DataFrame) -> DataFrame:
    return cells.withColumns({f"t{a}": F.floor(F.col(a) / F.lit(TILE)).cast("bigint") for a in ("x", "z")})


def _window(objects: DataFrame, bounds: DataFrame, vs: float, margin: int) -> DataFrame:
    """Add the cell c* of the centre and the footprint x0 .. x1 - 1, z0 .. z1 - 1, inside the map's bounds."""
    out = objects.crossJoin(F.broadcast(bounds))  # one row
    for a in AXES:
        out = out.withColumn(f"c{a}", _cell(F.col(f"pos_{a}"), vs))
    for a in ("x", "z"):
        span = F.col(f"half_{a}") / F.lit(vs)
        out = out.withColumn(f"{a}0", F.greatest(F.floor(F.col(f"c{a}") - span).cast("bigint") - margin, F.col(f"low_{a}")))
        out = out.withColumn(f"{a}1", F.least(F.floor(F.col(f"c{a}") + span).cast("bigint") + 1 + margin, F.col(f"high_{a}") + 1))
    return out.withColumn("cy", F.least(F.greatest("cy", "low_y"), F.col("high_y")))


def map_bounds(cells: DataFrame) -> DataFrame:
    return cells.agg(*[F.min(a).alias(f"low_{a}") for a in AXES], *[F.max(a).alias(f"high_{a}") for a in AXES])


def sized(objects: DataFrame) -> DataFrame:
    """Add half_* (of the drawn model), bottom and top (observed)."""
    given = [f"model_{a}" in objects.columns for a in AXES]
    out = objects
    for a, own in zip(AXES, given):
        size = F.coalesce(F.col(f"model_{a}"), F.col(f"dim_{a}")) if own else F.col(f"dim_{a}")
        out = out.withColumn(f"half_{a}", size / 2)
    return out.withColumns({"bottom": F.col("pos_y") - F.col("dim_y") / 2, "top": F.col("pos_y") + F.col("dim_y") / 2})


def surfaces(objects: DataFrame, cells: DataFrame, vs: float, coarse: float | None = None) -> DataFrame:
    """id, surface: top of the floor under a floor object, underside of the ceiling over a ceiling object, else null.

    Floors count within DEPTH_M below the centre and one cell above it.  Where none is
    labelled, the middle (by count, lower rank + upper rank halved and cut) of the highest occupied cells of
    the footprint's columns stands in.  ``coarse`` rounds floors up and ceilings down to drawn blocks.
    """
    margin, depth = int(round(REACH_M / vs)), int(round(DEPTH_M / vs))
    seen = _window(sized(objects), map_bounds(cells), vs, margin).where("mount in ('floor', 'ceiling')")
    asked = seen.select("id", "mount", "cy", "x0", "x1", "z0", "z1", _tiles(F.col("x0"), F.col("x1")).alias("tx"))
    asked = asked.withColumn("tz", _tiles(F.col("z0"), F.col("z1")))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z1"))
    met = asked.join(_tiled(cells), ["tx", "tz"]).where(inside)
    floor, ceiling = F.col("label") == STRUCTURE_LABELS[0], F.col("label") == STRUCTURE_LABELS[1]
    columns = met.groupBy("id", "mount", "x", "z").agg(
        F.max(F.when(floor & (F.col("y") >= F.col("cy") - depth) & (F.col("y") <= F.col("cy") + 1), F.col("y"))).alias("floor"),
        F.min(F.when(ceiling & (F.col("y") >= F.col("cy")) & (F.col("y") < F.col("cy") + depth), F.col("y"))).alias("ceiling"),
        F.max(F.when(F.col("y") <= F.col("cy"), F.col("y"))).alias("highest"),
    )
    # Columns per object are bounded by its own footprint.
    found = columns.groupBy("id", "mount").agg(
        F.max("floor").alias("floor"), F.min("ceiling").alias("ceiling"), F.sort_array(F.collect_list("highest")).alias("tops"))
    n = F.size("tops")
    middle = F.when(n > 0, (F.element_at("tops", ((n + 1) / 2).cast("int")) + F.element_at("tops", (n / 2).cast("int") + 1)) / 2)
    # The middle is cut towards the map's lower bound, as cells are counted from there.
    under = F.coalesce(F.col("floor"), F.floor(middle).cast("bigint")) + 1
    up, down = under * F.lit(vs), F.col("ceiling") * F.lit(vs)
    if coarse:
        up = F.ceil(up / F.lit(coarse) - F.lit(1e-9)) * F.lit(coarse)
        down = F.floor(down / F.lit(coarse)) * F.lit(coarse)
    return found.select("id", F.when(F.col("mount") == "floor", up).otherwise(down).cast("double").alias("surface"))


def support_candidates(objects: DataFrame, tile: float = 4.0) -> DataFrame:
    """id, on: pairs where ``id`` may come to stand on ``on`` after any push of the latter.

    Objects are placed by ascending observed bottom, ties by id; only earlier ones carry.
    """
    t = lambda c: F.floor(c / F.lit(tile)).cast("bigint")
    hosts = sized(objects).where("mount <> 'wall'").select(
        F.col("id").alias("on"), F.col("bottom").alias("on_bottom"), F.col("top").alias("on_top"),
        *[F.col(f"pos_{a}").alias(f"f{a}") for a in ("x", "z")],
        *[(F.col(f"half_{a}") + F.lit(EDGE_M + PUSH_M + 1e-6)).alias(f"r{a}") for a in ("x", "z")])
    for a in ("x", "z"):
        hosts = hosts.withColumn(f"t{a}", F.explode(F.sequence(t(F.col(f"f{a}") - F.col(f"r{a}")), t(F.col(f"f{a}") + F.col(f"r{a}")))))
    # The height slab keeps a pile of tall stacks from meeting as a whole.
    hosts = hosts.withColumn("ty", F.explode(F.sequence(t(F.col("on_top") - BELOW_M), t(F.col("on_top") + ABOVE_M))))
    items = sized(objects).where("mount = 'floor'").select(
        "id", "bottom", "pos_x", "pos_z", t(F.col("pos_x")).alias("tx"), t(F.col("bottom")).alias("ty"), t(F.col("pos_z")).alias("tz"))
    near = (F.abs(F.col("pos_x") - F.col("fx")) <= F.col("rx")) & (F.abs(F.col("pos_z") - F.col("fz")) <= F.col("rz"))
    gap = F.col("bottom") - F.col("on_top")
    earlier = (F.col("on_bottom") < F.col("bottom")) | ((F.col("on_bottom") == F.col("bottom")) & (F.col("on") < F.col("id")))
    return items.join(hosts, ["tx", "ty", "tz"]).where(near & (gap >= -BELOW_M) & (gap <= ABOVE_M) & earlier).select("id", "on")


def _pushed(placed: DataFrame, walls: DataFrame, bounds: DataFrame, vs: float) -> DataFrame:
    """Push objects out of walls along the axis on which the overlap is thinner, away from the wall's side."""
    seen = _window(placed, bounds, vs, 0)
    span = F.col("half_y") / F.lit(vs)
    seen = seen.withColumn("cy", _cell(F.col("pos_y"), vs))
    seen = seen.withColumn("y0", F.greatest(F.floor(F.col("cy") - span).cast("bigint") + 1, F.col("low_y")))
    seen = seen.withColumn("y1", F.least(F.floor(F.col("cy") + span).cast("bigint"), F.col("high_y") + 1)).where("mount <> 'wall'")
    asked = seen.select("id", "x0", "x1", "y0", "y1", "z0", "z1", _tiles(F.col("x0"), F.col("x1")).alias("tx"))
    asked = asked.withColumn("tz", _tiles(F.col("z0"), F.col("z1")))
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1"))
    hit = asked.join(walls, ["tx", "tz"]).where(inside).groupBy("id").agg(
        *[f(F.col(a) - F.col(f"{a}0")).alias(f"{n}_{a}") for a in ("x", "z") for f, n in ((F.min, "lo"), (F.max, "hi"))],
        *[F.first(F.col(f"{a}1") - F.col(f"{a}0")).alias(f"ext_{a}") for a in ("x", "z")])
    out = placed.join(hit, "id", "left")
    thin_x = F.col("hi_x") - F.col("lo_x") <= F.col("hi_z") - F.col("lo_z")

    def push(a: str) -> Column:
        lo, hi, ext = F.col(f"lo_{a}"), F.col(f"hi_{a}"), F.col(f"ext_{a}")
        cells = F.when(lo <= ext - 1 - hi, hi + 1).otherwise(lo - ext)
        return F.greatest(F.least(cells * F.lit(vs), F.lit(PUSH_M)), F.lit(-PUSH_M))

    return out.withColumns({
        "pos_x": F.col("pos_x") + F.when(F.col("lo_x").isNotNull() & thin_x, push("x")).otherwise(0.0),
        "pos_z": F.col("pos_z") + F.when(F.col("lo_x").isNotNull() & ~thin_x, push("z")).otherwise(0.0),
    }).select(*placed.columns)


def snapped(objects: DataFrame, cells: DataFrame, vs: float, coarse: float | None = None) -> DataFrame:
    """Objects at their height, out of walls, with ``support_id`` where they stand on another object.

    An object's level is one more than the highest level it may stand on; a level is placed at once.
    """
    rows = sized(objects).join(surfaces(objects, cells, vs, coarse), "id", "left")
    keep = ["id", "mount", *[f"pos_{a}" for a in AXES], *[f"half_{a}" for a in AXES], "bottom", "top", "surface"]
    rows = cut(rows.select(*keep).withColumn("support_id", F.lit(None).cast(rows.schema["id"].dataType)))
    pairs = cut(support_candidates(objects))
    walls, bounds = cut(_tiled(cells.where(F.col("label") == STRUCTURE_LABELS[2]))), cut(map_bounds(cells))
    todo, done = rows, None
    while True:
        waiting = pairs if done is None else pairs.join(done.select(F.col("id").alias("on")), "on", "left_anti")
        ready = todo.join(waiting.select("id").distinct(), "id", "left_anti")
        if done is not None:
            hosts = done.select(F.col("id").alias("on"), F.col("pos_x").alias("fx"), F.col("pos_z").alias("fz"), F.col("half_x").alias("hx"),
                                F.col("half_z").alias("hz"), (F.col("pos_y") + F.col("half_y")).alias("f_top"), F.col("bottom").alias("f_bottom"))
            over = (F.abs(F.col("pos_x") - F.col("fx")) <= F.col("hx") + EDGE_M) & (F.abs(F.col("pos_z") - F.col("fz")) <= F.col("hz") + EDGE_M)
            best = (
                ready.select("id", "pos_x", "pos_z").join(pairs, "id").join(hosts, "on").where(over).groupBy("id")
                .agg(F.min(F.struct((-F.col("f_top")).alias("neg"), "f_bottom", "on")).alias("b"))
            )
            ready = ready.join(best.select("id", F.col("b.on").alias("_on"), (-F.col("b.neg")).alias("_top")), "id", "left")
            higher = F.coalesce(F.col("_top") > F.coalesce("surface", F.lit(float("-inf"))), F.lit(False))
            ready = ready.withColumn("support_id", F.when(higher, F.col("_on"))).withColumn(
                "surface", F.when(higher, F.col("_top")).otherwise(F.col("surface"))).drop("_on", "_top")
        height = (F.when(F.col("mount") == "floor", F.col("surface") + F.col("half_y"))
                  .when(F.col("mount") == "ceiling", F.col("surface") - F.col("half_y")))
        ready = cut(_pushed(ready.withColumn("pos_y", F.coalesce(height, F.col("pos_y"))), walls, bounds, vs))
        if ready.isEmpty():
            return done if done is not None else ready
        done = ready if done is None else cut(done.union(ready.select(*done.columns)))
        todo = cut(todo.join(ready.select("id"), "id", "left_anti"))
        if todo.isEmpty():
            return done


def _push_apart(ids: list, supports: list, pos: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sweeps over one contact component, larger objects first: the larger one stays, the smaller one is pushed aside.

    Moves ``pos`` and returns, per object, how far it ever reached (low, high: where it was or was tried).
    """
    at = {v: k for k, v in enumerate(ids)}
    stands = {(k, at[s]) for k, s in enumerate(supports) if s is not None and s in at}
    low, high = pos - half, pos + half

    def free(k: int, spot: np.ndarray) -> bool:
        hit = (half[k] + half - np.abs(spot - pos) > 1e-6).all(axis=1)
        hit[k] = False
        return not hit.any()

    for _ in range(SWEEPS):
        moved = False
        for i in range(len(ids)):
            # Only objects near enough now can overlap when their turn comes, unless pushed here meanwhile: look again after each push.
            j = i + 1
            while j < len(ids):
                over = (half[i] + half[j:] - np.abs(pos[i] - pos[j:]) > 1e-6).all(axis=1)
                hits = np.flatnonzero(over)
                if not len(hits):
                    break
                j += int(hits[0])
                if (i, j) not in stands and (j, i) not in stands:
                    overlap = half[i] + half[j] - np.abs(pos[i] - pos[j])
                    axes = [0, 2] if overlap[0] <= overlap[2] else [2, 0]
                    spots = []
                    for ax in axes:
                        spot = pos[j].copy()
                        spot[ax] += (1.0 if pos[j][ax] >= pos[i][ax] else -1.0) * min(overlap[ax], PUSH_M)
                        spots.append(spot)
                    chosen = next((s for s in spots if free(j, s)), spots[0])
                    for s in spots:
                        low[j], high[j] = np.minimum(low[j], s - half[j]), np.maximum(high[j], s + half[j])
                    pos[j] = chosen
                    moved = True
                j += 1
        if not moved:
            break
    return low, high


def _separate(frame: pd.DataFrame) -> pd.DataFrame:
    """All contact components of ``frame``, each solved alone; an object without a neighbour keeps its place."""
    number = pd.factorize(frame["group"], use_na_sentinel=False)[0]
    order = frame.assign(_g=number, _v=8 * frame["half_x"] * frame["half_y"] * frame["half_z"])
    order = order.sort_values(["_g", "_v", "id"], ascending=[True, False, True], kind="stable")
    pos, half = order[[f"pos_{a}" for a in AXES]].to_numpy(float, copy=True), order[[f"half_{a}" for a in AXES]].to_numpy(float)
    low, high = pos - half, pos + half
    ids, supports = order["id"].tolist(), [on if stands else None for on, stands in zip(order["support_id"].tolist(), order["stands"].tolist())]
    ends = np.flatnonzero(np.diff(order["_g"].to_numpy(), append=-1)) + 1
    for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
        if e - s > 1:
            low[s:e], high[s:e] = _push_apart(ids[s:e], supports[s:e], pos[s:e], half[s:e])
    out = order[["id", "group"]].copy()
    for k, a in enumerate(AXES):
        out[f"pos_{a}"], out[f"min_{a}"], out[f"max_{a}"] = pos[:, k], low[:, k], high[:, k]
    return out


def _separate_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group: whole groups are solved as they end, many a call; only an unfinished one is held."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = frame["group"].iloc[-1]
        if held and last == held[0]["group"].iloc[-1]:  # still the group that was open
            held.append(frame)
            continue
        open_ = (frame["group"] == last).to_numpy()
        whole = [*held, frame[~open_]]
        held = [frame[open_]]
        whole = [w for w in whole if len(w)]
        if whole:
            yield _separate(pd.concat(whole, ignore_index=True))
    if held:
        yield _separate(pd.concat(held, ignore_index=True))


def separated(placed: DataFrame, tile: float = 4.0) -> DataFrame:
    """Objects pushed apart pairwise, ``support_id`` pairs excepted, larger ones first, at most SWEEPS times over all pairs."""
    boxes = placed.select("id", *[(F.col(f"pos_{a}") - F.col(f"half_{a}")).alias(f"min_{a}") for a in AXES],
                          *[(F.col(f"pos_{a}") + F.col(f"half_{a}")).alias(f"max_{a}") for a in AXES])
    links = cut(box_links(boxes, "id", [], PUSH_M, tile))
    kind = placed.schema["id"].dataType.simpleString()
    schema = f"id {kind}, group {kind}, " + ", ".join(f"pos_{a} double, min_{a} double, max_{a} double" for a in AXES)
    while True:
        groups = with_component(placed.select("id"), links, "id", out="group")
        # ids with a null among them would come as floats
        rows = placed.withColumns({"stands": F.col("support_id").isNotNull(), "support_id": F.coalesce("support_id", "id")}).join(groups, "id")
        solved = cut(spread(rows, "group").sortWithinPartitions("group").mapInPandas(_separate_sorted, schema))
        # Objects of two groups that came into each other's reach belong together after all.
        met = box_links(solved.select("id", *[f"{s}_{a}" for s in ("min", "max") for a in AXES]), "id", [], 0.0, tile)
        of = solved.select(F.col("id").alias("src"), F.col("group").alias("g_src"))
        to = solved.select(F.col("id").alias("dst"), F.col("group").alias("g_dst"))
        new = cut(met.join(of, "src").join(to, "dst").where("g_src <> g_dst").select("src", "dst"))
        if new.isEmpty():
            moved = solved.select("id", *[F.col(f"pos_{a}").alias(f"_{a}") for a in AXES])
            return placed.join(moved, "id").withColumns({f"pos_{a}": F.col(f"_{a}") for a in AXES}).select(*placed.columns)
        links = cut(links.union(new))


def resolve_placements(objects: DataFrame, cells: DataFrame, vs: float, coarse: float | None = None) -> DataFrame:
    """The objects' columns with final pos_* and support_id: snapped, pushed out of walls, separated."""
    done = separated(cut(snapped(objects, cells, vs, coarse))).select("id", *[F.col(f"pos_{a}").alias(f"_{a}") for a in AXES], "support_id")
    rest = objects.drop("support_id").join(done, "id")
    return rest.withColumns({f"pos_{a}": F.col(f"_{a}") for a in AXES}).drop(*[f"_{a}" for a in AXES])
