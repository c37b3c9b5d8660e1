import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import triples
from voxhive.functions.morton import morton_key
from voxhive.operators import field as fd, thinning, voxels as vx
from voxhive.operators.cluster import CORNER, FACE, cluster_cells, label_components, number_groups
from voxhive.operators.components import connected_components
from voxhive.operators.thinning import thin


def numpy_dbscan(pts, eps, min_samples):
    pts = np.array(sorted(pts))
    near = ((pts[:, None] - pts[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_samples
    label, k = np.full(len(pts), -1), 0
    for i in range(len(pts)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = k
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core):
                if label[j] < 0:
                    label[j] = k
                    stack.append(j)
        k += 1
    for i in np.flatnonzero(~core):
        hits = label[near[i] & core]
        label[i] = hits.min() if len(hits) else -1
    return {tuple(p): l for p, l in zip(pts.tolist(), label)}


@pytest.mark.parametrize("eps, min_samples, block", [(1.0, 1, 8), (2.0, 4, 8), (3.0, 9, 16)])
def test_clusters_match_brute_force(spark, cells, eps, min_samples, block):
    rng = np.random.default_rng(int(eps * 10 + min_samples))
    pts = {tuple(int(v) for v in p) for p in rng.integers(-12, 13, (500, 3))}
    want = numpy_dbscan(pts, eps, min_samples)
    out = cluster_cells(cells(pts), eps, min_samples, block=block).collect()
    order = {c: i for i, c in enumerate(sorted({r["cluster"] for r in out if r["cluster"] is not None}))}
    assert {(r["x"], r["y"], r["z"]): order.get(r["cluster"], -1) for r in out} == want


def test_small_cluster_cases(spark, cells):
    pts = [(0, 0, 0), (1, 0, 0), (3, 0, 0), (9, 9, 9), (9, 9, 10)]
    out = cluster_cells(cells(pts), 2.0, 2)
    assert out.select("cluster").distinct().count() == 2
    assert out.where("cluster IS NULL").count() == 0


def test_star_rounds_equal_single_task(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 400, (380, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint")
    small = {tuple(r) for r in connected_components(edges).collect()}
    rounds = {tuple(r) for r in connected_components(edges, tail_edges=0).collect()}
    assert small == rounds
    assert (1040, 1000) in small


def test_grouped_components(spark, cells):
    rows = [(0, 0, 0, 1), (1, 0, 0, 2), (2, 0, 0, 1), (3, 0, 0, 1)]
    out = label_components(cells(rows, "label int"), FACE, ("label",))
    assert out.groupBy("label", "component").count().count() == 3


def test_denoise_keeps_the_cube(spark, cells):
    cube = [(i, j, k) for i in range(10) for j in range(10) for k in range(10)]
    kept = vx.drop_small_components(cells(cube + [(40, 40, 40)]), 50, CORNER)
    assert triples(kept) == set(cube)


def test_flood_stays_in_the_box(spark, cells):
    n = 9
    shell = [(i, j, k) for i in range(n) for j in range(n) for k in range(n) if {i, j, k} & {0, n - 1}]
    free = fd.free_space(cells(shell))
    inner = vx.flood(free, (4, 4, 4))
    assert inner.count() == (n - 2) ** 3
    with pytest.raises(ValueError):
        vx.flood(free, (0, 0, 0))


@pytest.mark.parametrize("block, reach", [(16, 4), (32, 8)])
def test_nearest_obstacle_is_exact(spark, cells, block, reach):
    rng = np.random.default_rng(1)
    solid = {tuple(int(v) for v in p) for p in rng.integers(-10, 40, (40, 3))}
    free = {tuple(int(v) for v in p) for p in rng.integers(-10, 40, (200, 3))}
    out = fd.nearest_obstacle(cells(free), cells(solid), block, reach).collect()
    for r in out:
        want = min((sum((a - b) ** 2 for a, b in zip(r[:3], s)), *s) for s in solid)
        assert tuple(r)[3:] == want
    assert len(out) == len(free)


def test_voronoi_plane_between_two_points(spark, cells):
    box = [(i, j, k) for i in range(21) for j in range(21) for k in range(21)]
    solid = {(2, 10, 10), (18, 10, 10)}
    field = fd.distance_field(cells(set(box) - solid), cells(solid), 1.0)
    ridge = triples(fd.voronoi_cells(field, 1.0, 1.0, 2.0))
    assert any(c[0] == 10 for c in ridge) and (4, 10, 10) not in ridge


def test_thin_keeps_topology(spark, cells):
    ring = [(x, y, z) for x in range(12) for y in range(12) for z in range(3) if not (4 <= x <= 7 and 4 <= y <= 7)]
    out = triples(thin(cells(ring)))
    assert out < set(ring) and 8 <= len(out) <= 40
    parts = label_components(cells(out), CORNER)
    assert parts.select("component").distinct().count() == 1


def test_thin_in_rounds_equals_whole(spark, cells):
    bar = [(x, y, z) for x in range(9) for y in range(4) for z in range(3)]
    assert triples(thin(cells(bar), task_cells=5, block=4)) == triples(thin(cells(bar)))


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_settle_their_whole_course_in_few_rounds(spark, cells, seed, monkeypatch):
    """Each of the six directions of each pass took two shuffles of all cells and more."""
    rng = np.random.default_rng(seed)
    spots = {(x, y, z) for x in range(40) for y in range(17) for z in range(6) if rng.random() < 0.9}
    spots |= {(x, 8, 20 + x // 9) for x in range(40)} | {(5, y, 3) for y in range(17, 30)}
    rounds, plain = [], thinning.cut
    monkeypatch.setattr(thinning, "cut", lambda df: rounds.append(1) or plain(df))
    got = triples(thin(cells(sorted(spots)), task_cells=5, block=8))
    assert len(rounds) < 25
    assert got == triples(thin(cells(sorted(spots)))) and 0 < len(got) < len(spots)


def test_coarsen_alignment_and_majority(spark, cells):
    rows = [(-3, 0, 0, 5), (-4, 0, 0, 7), (-4, 1, 0, 7), (0, 0, 0, 0)]
    got = {(r["x"], r["y"], r["z"]): r["label"] for r in vx.coarsen(cells(rows, "label int"), 2).collect()}
    assert got == {(-2, 0, 0): 7, (0, 0, 0): 0}


def test_close_holes_inherits_label(spark, cells):
    slab = [(x, y, z, 3) for x in range(5) for y in range(5) for z in range(5) if (x, y, z) != (2, 2, 2)]
    out = vx.close_holes(cells(slab, "label int"), 1).where("filled").collect()
    assert [(r["x"], r["y"], r["z"], r["label"]) for r in out] == [(2, 2, 2, 3)]


@pytest.mark.parametrize("steps", [1, 2])
def test_close_holes_equals_the_stencil_steps(spark, cells, steps, capsys):
    """Holes over block borders, at the rim of the map and far from any cell, by one shuffle of the cells."""
    rng = np.random.default_rng(steps)
    spots = {tuple(p) for p in rng.integers([-4, 20, 60], [9, 40, 70], (1500, 3)).tolist()} | {(300, 30, 65), (302, 30, 65)}
    table = cells([(*p, int(rng.integers(3, 9))) for p in sorted(spots)], "label int")
    out = vx.close_holes(table, steps)
    closed = vx.closing(table, steps, vx.FACES, vx.bounds(table)).join(table.select("x", "y", "z"), ["x", "y", "z"], "left_anti")
    want = {tuple(r) for r in vx.nearest_value(closed, table, "label", steps).select("x", "y", "z", "label").collect()}
    got = [tuple(r) for r in out.where("filled").select("x", "y", "z", "label").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert triples(out.where("NOT filled")) == spots
    out.explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_free_space_shuffles_lines_not_cells(spark, cells, capsys):
    """The dense box went through a shuffle, twice in a distance field."""
    solid = {(0, 0, 0), (3, 2, 5), (3, 2, 4), (-1, 4, 0)}
    free = fd.free_space(cells([*sorted(solid), (0, 0, 0)]))
    got = [tuple(r) for r in free.collect()]
    want = {(x, y, z) for x in range(-2, 5) for y in range(-1, 6) for z in range(-1, 7)} - solid
    assert len(got) == len(want) and set(got) == want
    assert fd.free_space(cells([]).where("x > 0")).isEmpty()
    free.explain()
    plan = capsys.readouterr().out
    plan = plan[plan.index("isFinalPlan"):]
    assert plan.index("Generate explode") < plan.index("Exchange")


def test_planar_holes_send_each_cell_to_its_own_layer_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    foot = {(g, x, y) for g in (1, 2) for x in range(50) for y in range(40) if rng.random() < 0.6}
    rows = spark.createDataFrame(sorted(foot), "g int, u int, v int")
    want = set()
    for g in (1, 2):
        mine = {f[1:] for f in foot if f[0] == g}
        (x0, y0), (x1, y1) = np.min(list(mine), axis=0), np.max(list(mine), axis=0)
        empty = {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} - mine
        todo = [c for c in empty if c[0] in (x0, x1) or c[1] in (y0, y1)]
        seen = set(todo)
        while todo:
            x, y = todo.pop()
            new = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & empty - seen
            seen |= new
            todo += new
        want |= {(g, *c) for c in empty - seen}
    planes, plain = [], vx.label_components
    monkeypatch.setattr(vx, "label_components", lambda c, *a, **k: planes.append({r["z"] % 32 for r in c.select("z").distinct().collect()}) or plain(c, *a, **k))
    got = [tuple(r) for r in vx.fill_holes_2d(rows, ("g",), "u", "v").select("g", "u", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert planes and all(0 < z < 31 for z in set.union(*planes))


def test_morton_order(spark):
    import random
    rng = random.Random(1)
    pts = [(rng.randint(-2**31, 2**31 - 1), rng.randint(-5, 5), rng.randint(-2**20, 2**20)) for _ in range(100)]

    def interleaved(c):
        return sum((((v + (1 << 31)) >> i) & 1) << (3 * i + k) for k, v in enumerate(c) for i in range(32))

    got = spark.createDataFrame(pts, "cx int, cy int, cz int").orderBy(morton_key()).collect()
    assert [tuple(r) for r in got] == sorted(pts, key=interleaved)


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    out = number_groups(df, ["v"], "n").collect()
    assert all(r["v"] == r["n"] for r in out) and len(out) == 1000


def test_cells_far_from_the_origin(spark, cells):
    far = [(1 << 41, -(1 << 41), z) for z in range(5)] + [((1 << 41) + 40, 0, 1 << 45)]
    got = label_components(cells(far), FACE).collect()
    assert {tuple(r["component"]) for r in got} == {far[0], far[5]} and len(got) == 6


def test_runs_and_counts_use_every_partition(spark, capsys, cells):
    """Merged partitions gave four tasks two gigabytes each; an explicit count is kept."""
    rng = np.random.default_rng(3)
    spots = {tuple(int(v) for v in rng.integers(-9, 9, 3)) for _ in range(900)}
    values = {c: int(rng.integers(0, 3)) for c in spots}
    df = cells([(*c, v) for c, v in values.items()], "value int")
    runs = vx.rle_runs(df, 8)
    got = {}
    for r in runs.collect():
        for i in range(r["length"]):
            got[r["cx"], r["cy"], r["cz"], r["start"] + i] = r["value"]
    assert all(1 <= r["length"] <= 255 for r in runs.collect())
    kept = {(x // 8, y // 8, z // 8) for (x, y, z), v in values.items() if v}
    assert got == {(*k, p): values.get((k[0] * 8 + p // 64, k[1] * 8 + p // 8 % 8, k[2] * 8 + p % 8), 0) for k in kept for p in range(512)}
    counts = vx.neighbour_counts(df)
    near = {}
    for x, y, z in spots:
        for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
            spot = (x + d[0], y + d[1], z + d[2])
            near[spot] = near.get(spot, 0) + 1
    assert {tuple(r) for r in counts.collect()} == {(*c, near.get(c, 0), int(c in spots)) for c in spots | set(near)}
    for df in (runs, counts):
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_small_groups_share_a_kernel_call(spark, monkeypatch):
    """A call per group and block took most of the time of many small planes."""
    from voxhive.operators import cluster

    rng = np.random.default_rng(4)
    rows = [(None if g == 7 else g, f"n{g % 3}", *(int(v) for v in rng.integers(-20, 20, 3))) for g in range(150) for _ in range(60)]
    df = spark.createDataFrame(sorted(set(rows), key=str), "g bigint, name string, x bigint, y bigint, z bigint")
    calls = spark.sparkContext.accumulator(0)
    plain = cluster.min_label

    def counted(n, left, right):
        calls.add(1)
        return plain(n, left, right)

    monkeypatch.setattr(cluster, "min_label", counted)
    got = {}
    for r in label_components(df, CORNER, ("g", "name")).collect():
        got.setdefault((r["g"], r["name"]), {})[r["x"], r["y"], r["z"]] = tuple(r["component"])
    assert calls.value < 150
    for key, cells_of in got.items():
        rest, want = set(cells_of), {}
        while rest:
            first = min(rest)
            part, todo = {first}, [first]
            while todo:
                x, y, z = todo.pop()
                near = {c for c in rest if max(abs(c[0] - x), abs(c[1] - y), abs(c[2] - z)) <= 1} - part
                part |= near
                todo += near
            rest -= part
            want |= dict.fromkeys(part, first)
        assert cells_of == want, key
    assert sum(map(len, got.values())) == len(set(rows))


def test_distance_pass_needs_one_grid():
    """One key of distance and site a cell; two grids and masks took a quarter more time."""
    rng = np.random.default_rng(8)
    sites = np.unique(rng.integers(0, 12, (9, 3)), axis=0)
    key = np.full((12,) * 3, fd._TOP * 12**3, dtype=np.int64)
    key[tuple(sites.T)] = (sites[:, 0] * 12 + sites[:, 1]) * 12 + sites[:, 2]
    for axis in (2, 1, 0):
        key = fd._squared_pass(key, axis, 11, slice(0, 12), 12**3)
    for cell in np.ndindex(12, 12, 12):
        d2 = ((sites - np.array(cell)) ** 2).sum(axis=1)
        x, y, z = sites[d2.argmin()]
        assert divmod(int(key[cell]), 12**3) == (d2.min(), (x * 12 + y) * 12 + z)
