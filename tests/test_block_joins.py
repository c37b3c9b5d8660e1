"""Cell tables meet in blocks or by sorting: nothing that grows with the map goes through the driver."""

import contextlib
import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxhive.operators import cluster, components, field as fd, graph as gr, thinning, voxels as vx
from voxhive.operators.cluster import FACE, label_components
from voxhive.plans.exports import overlay_boxes

CELL = "x bigint, y bigint, z bigint"


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def _cells(spark, n=60, seed=3, span=40):
    at = np.unique(np.random.default_rng(seed).integers(-5, span, (n, 3)), axis=0)
    return at, spark.createDataFrame([tuple(map(int, c)) for c in at], CELL)


def test_free_space_and_its_components_are_not_broadcast(spark):
    _, solid = _cells(spark, 30, span=8)
    free = fd.free_space(solid)
    assert "BroadcastHashJoin" not in _plan(free)
    assert "BroadcastHashJoin" not in _plan(label_components(free, FACE))


def test_rays_do_not_broadcast_the_map(spark):
    _, cells = _cells(spark)
    rays = spark.createDataFrame([(1, 0.0, 0.0, -9.0, 0.0, 0.0, 1.0)], "ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double")
    out = vx.march_rays(rays, cells.union(spark.createDataFrame([(0, 0, 0)], CELL)), 1.0, 20.0)
    assert "BroadcastHashJoin" not in _plan(out)
    assert [(r.hit_z, r.prev_z) for r in out.collect()] == [(0, -1)]


def test_box_tiles_are_not_broadcast(spark):
    voxels = spark.createDataFrame([(0.5, 0.5, 0.5), (9.5, 0.5, 0.5)], "x double, y double, z double")
    fields = ["cx", "cy", "cz", "hx", "hy", "hz", "qx", "qy", "qz", "qw"]
    boxes = spark.createDataFrame([(1, *[1.0] * 6, 0.0, 0.0, 0.0, 1.0, 7)], "seq bigint, " + ", ".join(f"{c} double" for c in fields) + ", material int")
    out = overlay_boxes(voxels, boxes)
    assert "BroadcastHashJoin" not in _plan(out)
    assert [tuple(r) for r in out.collect()] == [(0.5, 0.5, 0.5, 7)]


def test_fronts_meet_in_blocks(spark):
    """Against all pairs, over block borders; cells without a parent meet nothing; no row is tripled for a join."""
    at, cells = _cells(spark, 6000, span=36)
    rng = np.random.default_rng(5)
    parent, dist = rng.integers(0, 6, at.shape), rng.integers(0, 5, len(at)).astype(float)
    rows = [(*map(int, c), float(d), *map(int, p)) for c, d, p in zip(at, dist, parent)] + [(90, 0, 0, 9.0, None, None, None), (91, 0, 0, 9.0, 0, 0, 0)]
    field = spark.createDataFrame(rows, CELL + ", dist_m double, px bigint, py bigint, pz bigint")
    index, want = {tuple(c): i for i, c in enumerate(at.tolist())}, set()
    for (x, y, z), i in index.items():
        for step in ((x + 1, y, z), (x, y + 1, z), (x, y, z + 1)):
            j = index.get(step)
            if j is not None and ((parent[i] - parent[j]) ** 2).sum() >= 16:
                want |= {(*at[k].tolist(), dist[k]) for k in (i, j) if dist[k] >= 2}
    out = fd.voronoi_cells(field, 1.0, 2.0, 4.0)
    assert "Join" not in _plan(out) and "Generate explode(array(" not in _plan(out)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_coarse_cells_touch_in_blocks(spark):
    at, cells = _cells(spark, 3000, span=36)
    skeleton = cells.withColumn("dist_m", F.lit(1.0))
    nodes, edges = gr.compress_skeleton(skeleton, 1.0, 4.0)
    have = {tuple(c) for c in at.tolist()}
    want = set()
    for c in have:
        for off in gr.NEIGHBOURS_26:
            o = tuple(p + q for p, q in zip(c, off))
            a, b = tuple(int((p + 0.5) // 4) for p in c), tuple(int((p + 0.5) // 4) for p in o)
            if o in have and a < b:
                want.add((a, b))
    got = [(tuple(r.a), tuple(r.b)) for r in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Generate explode(array(" not in _plan(edges) and "FlatMapGroupsInPandas" in _plan(edges)
    assert sum(r.members for r in nodes.collect()) == len(have)


def test_thinning_judges_a_neighbourhood_without_arrays(monkeypatch):
    """One array pass a sweep at most, however many neighbourhoods there are; single ones agree with it."""
    at = np.unique(np.random.default_rng(8).integers(0, 24, (9000, 3)), axis=0)
    calls, real = [], thinning._one_piece
    monkeypatch.setattr(thinning, "_one_piece", lambda bits: calls.append(len(bits)) or real(bits))
    thinning._thin_whole(pd.DataFrame(at, columns=list("xyz")))
    assert len(calls) < 100
    masks = np.random.default_rng(9).integers(0, 1 << 26, 3000) & np.random.default_rng(10).integers(0, 1 << 26, 3000)
    assert [thinning._in_one_piece(int(m)) for m in masks] == real(masks).tolist()
    assert thinning._in_one_piece(0)


def test_star_rounds_run_on_numbers(spark, monkeypatch):
    """Struct nodes (a null inside too) become numbers for the rounds; components keep their first node."""
    kinds, real = set(), components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: kinds.add(edges.schema["hi"].dataType.typeName()) or real(edges))
    rows = [((1, k), (1, k + 1)) for k in range(9)] + [((2, 5), (2, 3)), ((2, 3), (None, 7)), ((3, 1), (3, 1))]
    edges = spark.createDataFrame(rows, "src struct<a:bigint,b:bigint>, dst struct<a:bigint,b:bigint>")
    out = {tuple(r.node): tuple(r.component) for r in components.connected_components(edges, tail_edges=0).collect()}
    want = {(1, k): (1, 0) for k in range(10)} | {(2, 5): (None, 7), (2, 3): (None, 7), (None, 7): (None, 7)}
    assert out == want and kinds == {"long"}


def test_small_blocks_share_a_kernel_call(spark, monkeypatch):
    """Blocks of four cells cost no call each; labels do not depend on the block's size."""
    _, cells = _cells(spark, 9000, span=35)
    sides, real = [], cluster.with_halo
    monkeypatch.setattr(cluster, "with_halo", lambda df, block, halo: sides.append(block) or real(df, block, halo))
    small, large = (cluster.label_components(cells, FACE, block=b) for b in (4, 32))
    assert sides == [32, 32]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
