"""Placement against a one-by-one evaluation of the same rules."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from voxhive.operators import placement as pl

SCHEMA = "id bigint, pos_x double, pos_y double, pos_z double, dim_x double, dim_y double, dim_z double, mount string, model_x double, model_y double, model_z double"


def one_by_one(objects, cells, vs, coarse=None):
    """Snap, push and separate in sequence; objects are dicts, cells maps (x, y, z) to a label."""
    lo, hi = np.min(list(cells), axis=0), np.max(list(cells), axis=0)
    margin, depth = round(pl.REACH_M / vs), round(pl.DEPTH_M / vs)

    def half(o):
        return np.array([o["model"][k] if o["model"] else o["dim"][k] for k in range(3)]) / 2

    def foot(pos, h, k, wide):
        c = math.floor(pos[k] / vs)
        return range(max(math.floor(c - h[k] / vs) - wide, lo[k]), min(math.floor(c + h[k] / vs) + 1 + wide, hi[k] + 1))

    def surface(o):
        h, cy = half(o), min(max(math.floor(o["pos"][1] / vs), lo[1]), hi[1])
        xs, zs = foot(o["pos"], h, 0, margin), foot(o["pos"], h, 2, margin)
        inside = [(x, y, z, v) for (x, y, z), v in cells.items() if x in xs and z in zs]
        if o["mount"] == "ceiling":
            ys = [y for _, y, _, v in inside if v == 4 and cy <= y < cy + depth]
            return None if not ys else math.floor(min(ys) * vs / coarse) * coarse if coarse else min(ys) * vs
        ys = [y for _, y, _, v in inside if v == 3 and cy - depth <= y <= cy + 1]
        if ys:
            top = (max(ys) + 1) * vs
        else:
            tops = {}
            for x, y, z, _ in inside:
                if y <= cy:
                    tops[x, z] = max(tops.get((x, z), y), y)
            if not tops:
                return None
            top = (math.floor(np.median(list(tops.values()))) + 1) * vs
        return math.ceil(top / coarse - 1e-9) * coarse if coarse else top

    placed = []
    for o in sorted(objects, key=lambda o: (o["pos"][1] - o["dim"][1] / 2, o["id"])):
        pos, h = np.array(o["pos"]), half(o)
        new = {**o, "half": h, "top": o["pos"][1] + o["dim"][1] / 2, "support": None, "at": pos}
        placed.append(new)
        if o["mount"] == "wall":
            continue
        level = surface(o)
        if o["mount"] == "ceiling":
            if level is not None:
                pos[1] = level - h[1]
        else:
            for f in placed[:-1]:
                gap = o["pos"][1] - o["dim"][1] / 2 - f["top"]
                near = abs(pos[0] - f["at"][0]) <= f["half"][0] + 0.05 and abs(pos[2] - f["at"][2]) <= f["half"][2] + 0.05
                if f["mount"] != "wall" and near and -0.35 <= gap <= 0.75:
                    top = f["at"][1] + f["half"][1]
                    if level is None or top > level:
                        level, new["support"] = top, f["id"]
            if level is not None:
                pos[1] = level + h[1]
        cy = math.floor(pos[1] / vs)
        ys = range(max(math.floor(cy - h[1] / vs) + 1, lo[1]), min(math.floor(cy + h[1] / vs), hi[1] + 1))
        xs, zs = foot(pos, h, 0, 0), foot(pos, h, 2, 0)
        wall = [(x - xs[0], z - zs[0]) for (x, y, z), v in cells.items() if v == 19 and x in xs and y in ys and z in zs]
        if wall:
            ax = np.array([w[0] for w in wall]), np.array([w[1] for w in wall])
            k = 0 if np.ptp(ax[0]) <= np.ptp(ax[1]) else 1
            first, last, ext = ax[k].min(), ax[k].max(), len((xs, zs)[k])
            push = last + 1 if first <= ext - 1 - last else -(ext - first)
            pos[2 * k] += min(max(push * vs, -0.5), 0.5)
    order = sorted(placed, key=lambda o: (-8 * o["half"].prod(), o["id"]))
    over = lambda a, b, at: bool((a["half"] + b["half"] - abs(at - b["at"]) > 1e-6).all())
    for _ in range(3):
        moved = False
        for i, a in enumerate(order):
            for b in order[i + 1:]:
                if a["support"] == b["id"] or b["support"] == a["id"] or not over(b, a, b["at"]):
                    continue
                deep = a["half"] + b["half"] - abs(a["at"] - b["at"])
                spots = []
                for k in ([0, 2] if deep[0] <= deep[2] else [2, 0]):
                    spot = b["at"].copy()
                    spot[k] += (1 if b["at"][k] >= a["at"][k] else -1) * min(deep[k], 0.5)
                    spots.append(spot)
                fits = [s for s in spots if not any(m is not b and over(b, m, s) for m in order)]
                b["at"], moved = (fits or spots)[0], True
        if not moved:
            break
    return {o["id"]: (*np.round(o["at"], 9), o["support"]) for o in placed}


def scene(seed, n):
    rng = random.Random(seed)
    cells = {}
    for x in range(40):
        for z in range(40):
            if rng.random() < 0.8:
                cells[x, rng.choice([0, 0, 0, 1]), z] = 3 if rng.random() < 0.7 else 7
            if rng.random() < 0.5:
                cells[x, 22, z] = 4
    for y in range(1, 20):
        for k in range(40):
            cells[12, y, k] = 19
            if k > 20:
                cells[k, y, 30] = 19
    objects = []
    for i in range(n):
        model = [rng.choice([0.25, 0.5, 1.0]) for _ in range(3)] if rng.random() < 0.3 else None
        objects.append({
            "id": i, "pos": [rng.randrange(4, 76) / 8, rng.randrange(2, 40) / 16, rng.randrange(4, 76) / 8],
            "dim": [rng.choice([0.25, 0.5, 0.75, 1.0]) for _ in range(3)],
            "mount": rng.choice(["floor"] * 6 + ["wall", "ceiling"]), "model": model})
    return objects, cells


@pytest.mark.parametrize("seed,n,coarse", [(1, 40, None), (2, 90, 0.5), (3, 12, None)])
def test_equals_one_by_one(spark, seed, n, coarse):
    objects, cells = scene(seed, n)
    rows = [(o["id"], *map(float, o["pos"]), *map(float, o["dim"]), o["mount"], *(o["model"] or [None] * 3)) for o in objects]
    table = spark.createDataFrame(rows, SCHEMA)
    grid = spark.createDataFrame([(*k, v) for k, v in cells.items()], "x bigint, y bigint, z bigint, label bigint")
    got = {r["id"]: (round(r["pos_x"], 9), round(r["pos_y"], 9), round(r["pos_z"], 9), r["support_id"])
           for r in pl.resolve_placements(table, grid, 0.25, coarse).collect()}
    want = one_by_one(objects, cells, 0.25, coarse)
    assert got == want
    if n > 30:
        assert any(w[3] is not None for w in want.values())
        assert any(abs(want[o["id"]][0] - o["pos"][0]) > 0 for o in objects)


def test_a_push_into_another_group(spark):
    """A row of boxes: the first pushes the second into the reach of a third that stood clear."""
    rows = [(i, x, 0.5, 0.5, 1.0, 1.0, 1.0, "floor", None, None, None) for i, x in enumerate([0.0, 0.55, 1.7, 2.9, 9.0])]
    table = pl.sized(spark.createDataFrame(rows, SCHEMA)).selectExpr("*", "cast(null as bigint) as support_id")
    got = {r["id"]: r["pos_x"] for r in pl.separated(table).collect()}
    assert got[0] == 0.0 and got[4] == 9.0 and len(got) == 5
    assert all(got[k + 1] - got[k] > 0.9 for k in range(3))


def test_empty_tables(spark):
    objects = spark.createDataFrame([], SCHEMA)
    cells = spark.createDataFrame([], "x bigint, y bigint, z bigint, label bigint")
    assert pl.resolve_placements(objects, cells, 0.25).collect() == []
    one = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, 1.0, 1.0, "floor", None, None, None)], SCHEMA)
    assert [r["pos_y"] for r in pl.resolve_placements(one, cells, 0.25).collect()] == [1.0]


def test_groups_share_a_call_and_stay_apart():
    """Groups cut by batches are solved once and whole; many groups leave in one frame."""
    rng = random.Random(4)
    rows = []
    for g in range(300):
        for k in range(rng.choice([1, 1, 2, 7])):
            rows.append([g * 100 + k, g, k >= 2, g * 100 + k if k < 2 else g * 100, *[rng.randrange(8) / 8 for _ in range(3)], *[rng.randrange(1, 5) / 8 for _ in range(3)]])
    table = pd.DataFrame(rows, columns=["id", "group", "stands", "support_id", *[f"pos_{a}" for a in "xyz"], *[f"half_{a}" for a in "xyz"]])
    alone = pd.concat([pl._separate(part) for _, part in table.groupby("group")]).sort_values("id").reset_index(drop=True)
    for size in (3, 100):
        frames = list(pl._separate_sorted(iter([table[k:k + size] for k in range(0, len(table), size)])))
        pd.testing.assert_frame_equal(pd.concat(frames).sort_values("id").reset_index(drop=True), alone)
    assert len(frames) <= len(table) // 100 + 2
    assert (alone["pos_x"].to_numpy() != table["pos_x"].to_numpy()).any()


def test_repeated_ids_are_still_pushed_apart():
    """Two objects of one id do not stand on each other."""
    frame = pd.DataFrame([[1, 1, False, 1, x, 0.5, 0.5, 0.5, 0.5, 0.5] for x in (0.0, 0.25)],
                         columns=["id", "group", "stands", "support_id", *[f"pos_{a}" for a in "xyz"], *[f"half_{a}" for a in "xyz"]])
    assert pl._separate(frame)["pos_x"].tolist() != [0.0, 0.25]
