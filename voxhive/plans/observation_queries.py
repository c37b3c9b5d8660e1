"""Queries over the observation map, sensor poses and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxhive.operators import observation as ob, poses as ps, surface as sf, voxels as vx
from voxhive.operators.objects import nearest_node
from voxhive.plans.bindings import POINTS_SQL, SENSOR_SQL, VOXELS_SQL, labelled_points, sensor_points, table, voxel_map
from voxhive.plans.registry import query
from voxhive.session import cut

XYZ = vx.XYZ
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
OBS_COLS = [*XYZ, "round(cast(logodds as double), 5) as logodds", "sem_label", "sem_count", "r", "g", "b", "rgb_count"]


def observation_map(spark, d):
    return ob.integrate_frames(sensor_points(spark, d), 1.0)


@query("integrate_frames", f"""WITH {SENSOR_SQL}
SELECT x, y, z, round(logodds::DOUBLE, 5) AS logodds, sem_label, sem_count, r, g, b, rgb_count FROM obs""")
def _integrate(spark, d):
    return observation_map(spark, d).selectExpr(*OBS_COLS)


@query("integrate_resumed", f"""WITH {SENSOR_SQL}
SELECT x, y, z, round(logodds::DOUBLE, 5) AS logodds, sem_label, sem_count, r, g, b, rgb_count FROM obs""")
def _resumed(spark, d):
    pts = sensor_points(spark, d)
    first = cut(ob.integrate_frames(pts.where("frame_seq < 80"), 1.0))
    return ob.integrate_frames(pts.where("frame_seq >= 80"), 1.0, prior=first, segment=8).selectExpr(*OBS_COLS)


@query("carve_free", f"WITH {SENSOR_SQL} SELECT DISTINCT x, y, z FROM crossed")
def _carve(spark, d):
    return ob.carve_free(sensor_points(spark, d), 1.0)


@query("tri_state", f"""WITH {SENSOR_SQL}
SELECT CASE WHEN logodds >= 0.85::FLOAT THEN 'occupied' WHEN logodds <= (-0.4)::FLOAT THEN 'free' ELSE 'unknown' END AS state, count(*) AS cells
FROM obs GROUP BY 1""")
def _tri(spark, d):
    return ob.tri_state_counts(observation_map(spark, d))


@query("dirty_box", f"""WITH {SENSOR_SQL}
SELECT min(x) AS x_min, min(y) AS y_min, min(z) AS z_min, max(x) + 1 AS x_max, max(y) + 1 AS y_max, max(z) + 1 AS z_max FROM touch WHERE f >= 100""")
def _dirty(spark, d):
    return ob.dirty_box(ob.frame_evidence(sensor_points(spark, d).where("frame_seq >= 100"), 1.0))


@query("decouple_labels", f"""WITH {SENSOR_SQL}
SELECT x, y, z, sem_label FROM obs WHERE NOT (logodds >= 0.85::FLOAT AND sem_label IN (5, 16))""")
def _decouple(spark, d):
    return ob.decouple(observation_map(spark, d), labels=(5, 16)).select(*XYZ, "sem_label")


@query("clamped_fold_hot_key", """
SELECT user_id, round(list_reduce(list((CASE event_type WHEN 'click' THEN 0.85 WHEN 'purchase' THEN 0.85 ELSE -0.4 END)::FLOAT ORDER BY ts, event_id),
  lambda a, e: least(3.5::FLOAT, greatest((-2)::FLOAT, a + e)), 0::FLOAT)::DOUBLE, 5) AS logodds FROM events GROUP BY user_id""")
def _hot_fold(spark, d):
    ev = table(spark, d, "events")
    hit = F.col("event_type").isin("click", "purchase").cast("int")
    evidence = ev.select(
        F.col("event_id").alias("frame_seq"), F.col("user_id").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("z"),
        (1 - hit).alias("miss"), hit.alias("hit"), *[F.lit(None).cast("double").alias(c) for c in "rgb"])
    return ob.fold_evidence(evidence, segment=512).select(F.col("x").alias("user_id"), F.round(F.col("logodds").cast("double"), 5).alias("logodds"))


@query("streaming_majority", """
WITH v AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS label FROM events),
r AS (SELECT user_id, list_reduce(list({'l': label, 'c': 0} ORDER BY event_id),
  lambda a, e: CASE WHEN a.l = e.l THEN {'l': a.l, 'c': least(65535, a.c + 1)} WHEN a.c = 0 THEN {'l': e.l, 'c': 1} ELSE {'l': a.l, 'c': a.c - 1} END,
  {'l': 0, 'c': 0}) AS s FROM v GROUP BY user_id)
SELECT user_id, s.l AS sem_label, s.c AS sem_count FROM r""")
def _majority(spark, d):
    label = F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END")
    evidence = table(spark, d, "events").select(
        F.col("event_id").alias("frame_seq"), F.col("user_id").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("z"),
        F.lit(0).alias("miss"), F.lit(1).alias("hit"), *[F.lit(None).cast("double").alias(c) for c in "rgb"], label.alias("label"))
    votes = evidence.select("frame_seq", F.col("frame_seq").alias("row_seq"), *XYZ, "label")
    return ob.fold_evidence(evidence.drop("label"), votes).select(F.col("x").alias("user_id"), "sem_label", "sem_count")


# ---------------------------------------------------------------- poses
POSE_SQL = """pose AS MATERIALIZED (SELECT epoch_us(ts) / 1000000.0::DOUBLE AS t, event_id, value AS px, user_id + 0.0::DOUBLE AS py, event_id % 7 + 0.0::DOUBLE AS pz,
  event_id % 5 + 1.0::DOUBLE AS a, event_id % 3 + 1.0::DOUBLE AS b FROM events WHERE event_type = 'view'),
posed AS (SELECT *, sqrt(a * a + b * b) AS n FROM pose)"""


def _poses(spark, d):
    e = table(spark, d, "events").withColumn("stamp", F.expr(MICROS) / 1000000.0)
    a, b = F.col("event_id") % 5 + 1.0, F.col("event_id") % 3 + 1.0
    n = F.sqrt(a * a + b * b)
    poses = e.where("event_type = 'view'").select(
        "stamp", F.col("value").alias("px"), (F.col("user_id") + 0.0).alias("py"), (F.col("event_id") % 7 + 0.0).alias("pz"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), (a / n).alias("qz"), (b / n).alias("qw"))
    return e, poses


@query("interpolate_poses", f"""WITH {POSE_SQL},
q AS (SELECT event_id AS qid, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events WHERE event_type <> 'view'),
lo AS (SELECT q.qid, q.t AS qt, p.* FROM q ASOF LEFT JOIN posed p ON q.t >= p.t),
hi AS (SELECT q.qid, p.* FROM q ASOF LEFT JOIN posed p ON q.t < p.t),
j AS (SELECT lo.qid, qt, (qt - lo.t) / (hi.t - lo.t) AS u, lo.px AS px0, hi.px AS px1, lo.py AS py0, hi.py AS py1,
             lo.a / lo.n AS z0, lo.b / lo.n AS w0, hi.a / hi.n AS z1, hi.b / hi.n AS w1 FROM lo JOIN hi USING (qid)),
k AS (SELECT *, z0 * z1 + w0 * w1 AS dot FROM j),
m AS (SELECT *, acos(least(1, greatest(-1, dot))) AS th FROM k)
SELECT qid, round((1 - u) * px0 + u * px1, 5) AS px, round((1 - u) * py0 + u * py1, 5) AS py,
  round(CASE WHEN dot > 0.9995 THEN (w0 + u * (w1 - w0)) / sqrt((w0 + u * (w1 - w0)) ** 2 + (z0 + u * (z1 - z0)) ** 2)
       ELSE sin((1 - u) * th) / sin(th) * w0 + sin(u * th) / sin(th) * w1 END, 5) AS qw FROM m""")
def _interpolate(spark, d):
    e, poses = _poses(spark, d)
    out = ps.interpolate_poses(e.where("event_type <> 'view'").select("stamp", F.col("event_id").alias("qid")), poses)
    return out.select("qid", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"), F.round("qw", 5).alias("qw"))


@query("synchronise_topics", """
WITH l AS (SELECT event_id AS l_id, epoch_us(ts) / 1000000.0::DOUBLE AS l_t FROM events WHERE event_type = 'click'),
r AS (SELECT event_id AS r_id, epoch_us(ts) / 1000000.0::DOUBLE AS r_t FROM events WHERE event_type = 'purchase')
SELECT l_id, arg_min(r_id, (abs(l_t - r_t), r_t, r_id)) AS r_id FROM l, r WHERE abs(l_t - r_t) <= 300 GROUP BY l_id""")
def _sync(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.expr(MICROS) / 1000000.0).alias("stamp"), "event_type")
    pairs = ps.nearest_in_time(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), 300.0, "id")
    return pairs.select("l_id", "r_id")


@query("chain_transforms", """
WITH RECURSIVE edge AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c, n_nationkey + 0.0::DOUBLE AS t FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey / 8.0::DOUBLE FROM customer),
two_way AS MATERIALIZED (SELECT p, c, t FROM edge UNION ALL SELECT c, p, -t FROM edge),
walk AS (SELECT 'r' || r_regionkey AS s, 'r' || r_regionkey AS f, 0.0::DOUBLE AS t, 0 AS hops FROM region
  UNION ALL SELECT w.s, b.c, w.t + b.t, w.hops + 1 FROM walk w JOIN two_way b ON b.p = w.f WHERE w.hops < 2)
SELECT s AS parent, f AS child, round(t, 6) AS tx, hops FROM walk WHERE hops = 2 AND f LIKE 'c%'""")
def _chain(spark, d):
    def shift(t):
        return F.array(*[t if i == 3 else F.lit(float(i % 5 == 0)) for i in range(16)])
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    edges = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), shift(F.col("n_nationkey") + 0.0).alias("m"))
    edges = edges.union(customer.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"), shift(F.col("c_custkey") / 8.0)))
    home = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    pairs = home.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    out = ps.chain_transforms(edges, pairs, 4)
    return out.select("parent", "child", F.round(F.get("m", F.lit(3)), 6).alias("tx"), "hops")


@query("nearest_place", """
WITH p AS (SELECT s_suppkey AS id, s_suppkey % 40 * 3.0::DOUBLE AS x, s_nationkey * 2.0::DOUBLE AS y FROM supplier),
q AS (SELECT c_custkey AS qid, c_custkey % 120 + 0.25::DOUBLE AS x, c_nationkey * 2 + 0.75::DOUBLE AS y FROM customer)
SELECT qid, arg_min(id, ((q.x - p.x) ** 2 + (q.y - p.y) ** 2, id)) AS id, min((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d2 FROM q, p GROUP BY qid""")
def _nearest(spark, d):
    places = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40 * 3.0).alias("x"), (F.col("s_nationkey") * 2.0).alias("y"))
    queries = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") % 120 + 0.25).alias("x"), (F.col("c_nationkey") * 2 + 0.75).alias("y"))
    return nearest_node(queries, places, ("x", "y"), 2.0)


# ---------------------------------------------------------------- floor
@query("occupancy_grid", f"""WITH {POINTS_SQL},
g AS (SELECT CAST(floor(x / 2.5::DOUBLE) AS BIGINT) AS gx, CAST(floor(y / 2.5::DOUBLE) AS BIGINT) AS gy, CAST(sum((label = 3)::INT) AS BIGINT) AS surf,
             CAST(sum((label <> 3)::INT) AS BIGINT) AS obst FROM pts WHERE label <> 5 GROUP BY 1, 2)
SELECT gx, gy, surf, obst, CASE WHEN obst >= 2 THEN 100 WHEN surf >= 1 THEN 0 ELSE -1 END AS cost FROM g""")
def _grid(spark, d):
    pts = labelled_points(spark, d).select(F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), "label")
    return sf.hit_grid(pts, 2.5, (3,), (5,))


@query("surface_tiles", f"""WITH {SENSOR_SQL}, f AS (SELECT CAST(floor(quantile_cont(y, 0.03)) AS BIGINT) AS yf FROM obs WHERE logodds >= 0.85::FLOAT),
band AS (SELECT x, z, yf FROM obs, f WHERE logodds <= (-0.4)::FLOAT AND y > yf AND y <= yf + 4 GROUP BY x, z, yf HAVING count(*) = 4)
SELECT (x + 0.5::DOUBLE) * 0.5::DOUBLE AS px, (yf + 1.0::DOUBLE) * 0.5::DOUBLE AS py, (z + 0.5::DOUBLE) * 0.5::DOUBLE AS pz FROM band""")
def _tiles(spark, d):
    obs = cut(observation_map(spark, d))
    return sf.surface_tiles(ob.observed_free(obs), ob.occupied(obs), 0.5)


REGION_SQL = f"""{VOXELS_SQL},
walk_cell AS MATERIALIZED (SELECT DISTINCT x AS gx, y AS gy FROM vox WHERE label = 3 AND z < 4),
wall AS MATERIALIZED (SELECT DISTINCT x AS gx, y AS gy FROM vox WHERE label = 19 AND z = 0 AND (x, y) NOT IN (SELECT (gx, gy) FROM walk_cell)),
ring(dx, dy) AS (SELECT a.i, b.i FROM range(-1, 2) a(i), range(-1, 2) b(i) WHERE NOT (a.i = 0 AND b.i = 0)),
cell AS MATERIALIZED (SELECT *, gy * 1048576 + gx AS id FROM walk_cell),
edge AS MATERIALIZED (SELECT a.id AS s, b.id AS t FROM cell a, ring, cell b WHERE b.gx = a.gx + dx AND b.gy = a.gy + dy),
walk(n, c) AS (SELECT id, id FROM cell WHERE id NOT IN (SELECT s FROM edge WHERE t < s) UNION SELECT e.t, w.c FROM walk w JOIN edge e ON e.s = w.n WHERE e.t > w.c),
comp AS MATERIALIZED (SELECT n, min(c) AS c FROM walk GROUP BY n),
big AS (SELECT c, count(*) AS k FROM comp GROUP BY c HAVING count(*) >= 15),
num AS MATERIALIZED (SELECT c, k, row_number() OVER (ORDER BY c) - 1 AS id FROM big),
member AS MATERIALIZED (SELECT num.id, gx, gy FROM comp JOIN num USING (c) JOIN cell ON cell.id = n)"""


def _region_inputs(spark, d):
    vox = cut(voxel_map(spark, d))
    walkable = vox.where("label = 3 AND z < 4").select(F.col("x").alias("gx"), F.col("y").alias("gy")).distinct()
    walls = vox.where("label = 19 AND z = 0").select(F.col("x").alias("gx"), F.col("y").alias("gy")).distinct()
    return walkable, walls.join(walkable, ["gx", "gy"], "left_anti")


@query("surface_regions", f"""WITH RECURSIVE {REGION_SQL}
SELECT id, round((avg(gx) + 0.5::DOUBLE) * 0.5::DOUBLE, 6) AS cx, round((avg(gy) + 0.5::DOUBLE) * 0.5::DOUBLE, 6) AS cy, round(count(*) * 0.25::DOUBLE, 6) AS area_m2, count(*) AS cell_count
FROM member GROUP BY id""")
def _regions(spark, d):
    regions, _ = sf.surface_places(*_region_inputs(spark, d)[:1], 0.5, 15, 0.9)
    return regions.select("id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "area_m2")], "cell_count")


@query("surface_doors", f"""WITH RECURSIVE {REGION_SQL},
box AS (SELECT min(gx) AS x0, max(gx) AS x1, min(gy) AS y0, max(gy) AS y1 FROM (SELECT gx, gy FROM walk_cell UNION ALL SELECT gx, gy FROM wall)),
g1 AS MATERIALIZED (SELECT DISTINCT id, gx + dx AS gx, gy + dy AS gy FROM member, ring, box WHERE gx + dx BETWEEN x0 AND x1 AND gy + dy BETWEEN y0 AND y1
       AND (gx + dx, gy + dy) NOT IN (SELECT (gx, gy) FROM wall)),
g2 AS (SELECT DISTINCT id, gx + dx AS gx, gy + dy AS gy FROM g1, ring, box WHERE gx + dx BETWEEN x0 AND x1 AND gy + dy BETWEEN y0 AND y1
       AND (gx + dx, gy + dy) NOT IN (SELECT (gx, gy) FROM wall)),
reach AS (SELECT * FROM member UNION SELECT * FROM g1 UNION SELECT * FROM g2)
SELECT DISTINCT r.id AS a, m.id AS b FROM reach r JOIN member m USING (gx, gy) WHERE r.id < m.id""")
def _doors(spark, d):
    walkable, walls = _region_inputs(spark, d)
    return sf.surface_places(walkable, 0.5, 15, 0.9, walls)[1]


@query("floor_levels", """
WITH z AS (SELECT l_tax * 40 + 0.0::DOUBLE AS pz, l_partkey / 8.0::DOUBLE AS px, l_quantity AS py, l_returnflag = 'A' AS s FROM lineitem),
lv(level, rep_z) AS (VALUES (0, 0.0::DOUBLE), (1, 0.4::DOUBLE), (2, 0.8::DOUBLE), (3, 1.2::DOUBLE)),
near AS (SELECT z.*, (SELECT arg_min(level, (abs(pz - rep_z), level)) FROM lv) AS level, (SELECT min(abs(pz - rep_z)) FROM lv) AS d FROM z WHERE s),
a AS (SELECT level, CAST(floor(px / 4) AS BIGINT) AS gx, CAST(floor(py / 4) AS BIGINT) AS gy, 1 AS sh, 0 AS oh, pz FROM near WHERE d <= 0.3::DOUBLE),
b AS (SELECT level, CAST(floor(px / 4) AS BIGINT) AS gx, CAST(floor(py / 4) AS BIGINT) AS gy, 0 AS sh, 1 AS oh, NULL AS pz FROM z, lv WHERE NOT s AND pz > rep_z + 0.1::DOUBLE AND pz < rep_z + 0.9::DOUBLE)
SELECT level, gx, gy, CAST(sum(sh) AS BIGINT) AS surf, CAST(sum(oh) AS BIGINT) AS obst, round(min(pz), 6) AS floor_z,
  CASE WHEN sum(oh) >= 2 THEN 100 WHEN sum(sh) >= 1 THEN 0 ELSE -1 END AS cost FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY level, gx, gy""")
def _levels(spark, d):
    pts = table(spark, d, "lineitem").select(
        (F.col("l_partkey") / 8.0).alias("px"), F.col("l_quantity").alias("py"), (F.col("l_tax") * 40 + 0.0).alias("pz"), (F.col("l_returnflag") == "A").alias("is_surface"))
    levels = sf.assign_levels(pts.where("is_surface"), 0.3, 50, 4)
    out = sf.level_hits(pts, levels, 4.0, 0.3, 0.1, 0.9)
    return out.withColumn("floor_z", F.round("floor_z", 6))
