"""Queries over distance fields, skeletons, place graphs and object instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxhive.operators import field as fd, graph as gr, objects as obj, voxels as vx
from voxhive.operators.thinning import thin
from voxhive.plans.bindings import VOXELS_SQL, table, voxel_map
from voxhive.plans.registry import query
from voxhive.session import cut

XYZ = vx.XYZ

# Obstacles: wall cells seen twice; free space: every other cell of the padded box.
SPACE_SQL = f"""{VOXELS_SQL},
solid AS MATERIALIZED (SELECT x, y, z FROM vox WHERE total >= 2),
b AS (SELECT min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1, min(z) - 1 AS z0, max(z) + 1 AS z1 FROM solid),
space AS MATERIALIZED (SELECT x, y, z FROM b, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y), LATERAL (SELECT unnest(range(z0, z1 + 1)) AS z)),
free AS MATERIALIZED (SELECT * FROM space ANTI JOIN solid USING (x, y, z)),
ball AS MATERIALIZED (SELECT a.i AS dx, c.i AS dy, e.i AS dz, a.i * a.i + c.i * c.i + e.i * e.i AS d2 FROM range(-3, 4) a(i), range(-3, 4) c(i), range(-3, 4) e(i) WHERE a.i * a.i + c.i * c.i + e.i * e.i <= 9),
near AS MATERIALIZED (SELECT f.x, f.y, f.z, min({{'d2': d2, 'px': s.x, 'py': s.y, 'pz': s.z}}) AS m FROM free f, ball, solid s WHERE s.x = f.x + dx AND s.y = f.y + dy AND s.z = f.z + dz GROUP BY f.x, f.y, f.z),
far AS MATERIALIZED (SELECT * FROM free ANTI JOIN near USING (x, y, z)),
wide AS MATERIALIZED (SELECT f.x, f.y, f.z, min({{'d2': (f.x - s.x) ** 2 + (f.y - s.y) ** 2 + (f.z - s.z) ** 2, 'px': s.x, 'py': s.y, 'pz': s.z}}) AS m
   FROM far f JOIN solid s ON s.x // 16 BETWEEN f.x // 16 - 1 AND f.x // 16 + 1 GROUP BY f.x, f.y, f.z),
field AS MATERIALIZED (SELECT x, y, z, CAST(m.d2 AS BIGINT) AS d2, m.px, m.py, m.pz, sqrt(m.d2::DOUBLE) AS dist FROM near
   UNION ALL SELECT x, y, z, CAST(m.d2 AS BIGINT), m.px, m.py, m.pz, sqrt(m.d2::DOUBLE) FROM wide)"""

PAIR_SQL = """up(dx, dy, dz) AS (VALUES (1,0,0),(0,1,0),(0,0,1)),
pair AS (SELECT a.*, c.x AS hx, c.y AS hy, c.z AS hz, c.dist AS hdist FROM field a, up, field c WHERE c.x = a.x + dx AND c.y = a.y + dy AND c.z = a.z + dz
   AND (a.px - c.px) ** 2 + (a.py - c.py) ** 2 + (a.pz - c.pz) ** 2 >= 16),
gvd AS MATERIALIZED (SELECT x, y, z, dist FROM pair WHERE dist >= 2 UNION SELECT hx, hy, hz, hdist FROM pair WHERE hdist >= 2)"""


def _space(spark, d):
    solid = cut(voxel_map(spark, d).where("total >= 2").select(*XYZ))
    return solid, fd.free_space(solid)


def _field(spark, d):
    solid, free = _space(spark, d)
    return fd.distance_field(free, solid, 1.0)


def _gvd(spark, d):
    return fd.voronoi_cells(_field(spark, d), 1.0, d_min=2.0, theta_sep=4.0)


@query("free_space", f"WITH {SPACE_SQL} SELECT x, y, z FROM free")
def _free(spark, d):
    return _space(spark, d)[1]


@query("distance_field", f"WITH {SPACE_SQL} SELECT x, y, z, d2, px, py, pz FROM field")
def _edt(spark, d):
    return _field(spark, d).select(*XYZ, "d2", "px", "py", "pz")


@query("shell_band", f"WITH {SPACE_SQL} SELECT d2, count(*) AS n FROM field WHERE dist <= 3 GROUP BY d2")
def _band(spark, d):
    return _field(spark, d).where("dist_m <= 3").groupBy("d2").agg(F.count(F.lit(1)).alias("n"))


@query("deepest_cell", f"WITH {SPACE_SQL} SELECT x, y, z FROM field ORDER BY d2 DESC, x, y, z LIMIT 1")
def _deep(spark, d):
    return fd.deepest_cell(_field(spark, d))


@query("flood_free_space", f"""WITH RECURSIVE {SPACE_SQL}, seed AS (SELECT x, y, z FROM field ORDER BY d2 DESC, x, y, z LIMIT 1),
inside AS (SELECT x, y, z FROM seed UNION SELECT f.x, f.y, f.z FROM inside i, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) s(dx, dy, dz), free f
   WHERE f.x = i.x + dx AND f.y = i.y + dy AND f.z = i.z + dz)
SELECT x, y, z FROM inside""")
def _flood(spark, d):
    solid, free = _space(spark, d)
    seed = fd.resolve_seed(solid, 1.0)
    return vx.flood(free, seed)


@query("voronoi_cells", f"WITH {SPACE_SQL}, {PAIR_SQL} SELECT x, y, z, round(dist, 6) AS dist_m FROM gvd")
def _voronoi(spark, d):
    return _gvd(spark, d).withColumn("dist_m", F.round("dist_m", 6))


@query("voronoi_cells_local", f"WITH {SPACE_SQL}, {PAIR_SQL} SELECT x, y, z, round(dist, 6) AS dist_m FROM gvd WHERE x >= 100 AND x < 300 AND y >= 10 AND y < 40 AND z >= 0 AND z < 9")
def _local(spark, d):
    solid, free = _space(spark, d)
    out = fd.voronoi_cells_local(solid, free, 1.0, (100, 10, 0), (300, 40, 9), 12, 2.0, 4.0)
    return out.withColumn("dist_m", F.round("dist_m", 6))


@query("compress_skeleton", f"""WITH {SPACE_SQL}, {PAIR_SQL},
c AS MATERIALIZED (SELECT *, CAST(floor((x + 0.5::DOUBLE) / 4) AS BIGINT) AS cx, CAST(floor((y + 0.5::DOUBLE) / 4) AS BIGINT) AS cy, CAST(floor((z + 0.5::DOUBLE) / 4) AS BIGINT) AS cz FROM gvd),
n AS MATERIALIZED (SELECT cx, cy, cz, min({{'d': -dist, 'x': x, 'y': y, 'z': z}}) AS w FROM c GROUP BY ALL),
off AS MATERIALIZED (SELECT i.i AS dx, j.i AS dy, k.i AS dz FROM range(-1, 2) i(i), range(-1, 2) j(i), range(-1, 2) k(i)),
moved AS MATERIALIZED (SELECT x + dx AS x, y + dy AS y, z + dz AS z, cx AS ax, cy AS ay, cz AS az FROM c, off),
e AS MATERIALIZED (SELECT DISTINCT ax, ay, az, cx AS bx, cy AS bby, cz AS bz FROM moved JOIN c USING (x, y, z) WHERE (ax, ay, az) < (cx, cy, cz))
SELECT ax, ay, az, bx, bby, bz, round(sqrt((p.w.x - q.w.x) ** 2 + (p.w.y - q.w.y) ** 2 + (p.w.z - q.w.z) ** 2), 6) AS length_m
FROM e JOIN n p ON p.cx = ax AND p.cy = ay AND p.cz = az JOIN n q ON q.cx = bx AND q.cy = bby AND q.cz = bz""")
def _compress(spark, d):
    _, edges = gr.compress_skeleton(cut(_gvd(spark, d)), 1.0, 4.0)
    return edges.select(
        F.col("a.cx").alias("ax"), F.col("a.cy").alias("ay"), F.col("a.cz").alias("az"),
        F.col("b.cx").alias("bx"), F.col("b.cy").alias("bby"), F.col("b.cz").alias("bz"), F.round("length_m", 6).alias("length_m"))


@query("thin_skeleton")
def _thin(spark, d):
    return thin(_gvd(spark, d))


def places_graph(spark, d):
    gvd = cut(_gvd(spark, d))
    skeleton = thin(gvd).join(gvd, XYZ)
    return gr.skeleton_to_graph(cut(skeleton), 1.0)


@query("places_graph")
def _places(spark, d):
    nodes, edges = places_graph(spark, d)
    nodes, edges = gr.drop_small_graph_parts(*gr.merge_close(*gr.prune_spurs(nodes, edges, 3.0), 2.0, 1.0), 2)
    rooms = gr.rooms_by_clearance(nodes, edges, 2.5, 3)
    return nodes.join(rooms, "id")


# ---------------------------------------------------------------- abstract graphs
# Customers are nodes; consecutive orders of the book link two customers.
GRAPH_SQL = """seq AS (SELECT o_custkey AS c, lead(o_custkey) OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) AS n, 1 + o_orderkey % 9 AS w FROM orders),
edge AS MATERIALIZED (SELECT least(c, n) AS a, greatest(c, n) AS b, CAST(min(w) AS DOUBLE) AS length_m FROM seq WHERE n IS NOT NULL AND c <> n GROUP BY 1, 2)"""


def customer_graph(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    nxt = F.lead("o_custkey").over(Window.partitionBy(F.expr("o_orderkey div 64")).orderBy("o_orderkey"))
    pairs = o.select(F.col("o_custkey").alias("c"), nxt.alias("n"), (1 + F.col("o_orderkey") % 9).alias("w"))
    pairs = pairs.where("n IS NOT NULL AND c <> n")
    edges = pairs.groupBy(F.least("c", "n").alias("a"), F.greatest("c", "n").alias("b")).agg(F.min("w").cast("double").alias("length_m"))
    nodes = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") * 3).alias("i"), F.lit(0).cast("bigint").alias("j"), F.col("c_nationkey").cast("bigint").alias("k"),
        (F.col("c_acctbal") / 1000.0).alias("clearance_m"))
    return gr.with_degree(nodes, edges), edges


@query("graph_degrees", f"""WITH {GRAPH_SQL}, deg AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM edge UNION ALL SELECT b FROM edge) GROUP BY id)
SELECT c_custkey AS id, CAST(coalesce(n, 0) AS INTEGER) AS degree, CASE WHEN n >= 3 THEN 'junction' WHEN n = 2 THEN 'passthrough' WHEN n = 1 THEN 'endpoint' ELSE 'isolated' END AS type
FROM customer LEFT JOIN deg ON id = c_custkey""")
def _degrees(spark, d):
    return customer_graph(spark, d)[0].select("id", "degree", "type")


GRAPH_COMPONENT_SQL = """two_way AS MATERIALIZED (SELECT a AS s, b AS t FROM edge UNION ALL SELECT b, a FROM edge),
walk(n, c) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT e.t, w.c FROM walk w JOIN two_way e ON e.s = w.n WHERE e.t > w.c),
comp AS MATERIALIZED (SELECT n, min(c) AS c FROM walk GROUP BY n)"""


@query("graph_components", f"WITH RECURSIVE {GRAPH_SQL}, {GRAPH_COMPONENT_SQL} SELECT n AS id, c AS component FROM comp")
def _graph_components(spark, d):
    return gr.graph_components(*customer_graph(spark, d))


@query("drop_small_graph_parts", f"""WITH RECURSIVE {GRAPH_SQL}, {GRAPH_COMPONENT_SQL},
kept AS (SELECT n FROM comp WHERE c IN (SELECT c FROM comp GROUP BY c HAVING count(*) >= 5)),
num AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n) - 1 AS id FROM kept)
SELECT p.id AS a, q.id AS b, length_m FROM edge JOIN num p ON p.n = a JOIN num q ON q.n = b""")
def _drop_parts(spark, d):
    return gr.drop_small_graph_parts(*customer_graph(spark, d), 5)[1]


@query("prune_spurs")
def _prune(spark, d):
    return gr.prune_spurs(*customer_graph(spark, d), 9.0)[0].select("id", "degree", "type")


@query("merge_close", f"""WITH RECURSIVE {GRAPH_SQL},
node AS MATERIALIZED (SELECT c_custkey AS id, c_custkey * 3 AS i, CAST(c_nationkey AS BIGINT) AS k, c_acctbal / 1000.0::DOUBLE AS cl FROM customer),
close AS MATERIALIZED (SELECT p.id AS s, q.id AS t FROM node p JOIN node q ON q.id BETWEEN p.id - 2 AND p.id + 2 AND p.id <> q.id AND (p.i - q.i) ** 2 + (p.k - q.k) ** 2 <= 25),
walk(n, c) AS (SELECT id, id FROM node UNION SELECT e.t, w.c FROM walk w JOIN close e ON e.s = w.n WHERE e.t > w.c),
comp AS MATERIALIZED (SELECT n, min(c) AS c FROM walk GROUP BY n),
num AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT DISTINCT c FROM comp)),
best AS (SELECT c, arg_max(n, (cl, -n)) AS n FROM comp JOIN node ON node.id = n GROUP BY c)
SELECT num.id, node.i, node.k, round(node.cl, 6) AS clearance_m FROM best JOIN num USING (c) JOIN node ON node.id = best.n""")
def _merge(spark, d):
    nodes, _ = gr.merge_close(*customer_graph(spark, d), 5.0, 1.0)
    return nodes.select("id", "i", "k", F.round("clearance_m", 6).alias("clearance_m"))


@query("rooms_by_clearance")
def _rooms(spark, d):
    return gr.rooms_by_clearance(*customer_graph(spark, d), 2.0, 4)


@query("rooms_by_modularity")
def _modularity(spark, d):
    return gr.rooms_by_modularity(*customer_graph(spark, d))


@query("merge_nested_rooms")
def _nested(spark, d):
    nodes, _ = customer_graph(spark, d)
    return gr.merge_nested_rooms(nodes.withColumn("room", F.expr("id div 10")), 0.1).select("id", "room")


# ---------------------------------------------------------------- objects
@query("extract_objects")
def _objects(spark, d):
    return obj.extract_objects(voxel_map(spark, d), 0.1, structure=(3, 19), min_voxels=8, eps=1.5, min_samples=4)


@query("shape_moments", f"""WITH {VOXELS_SQL}
SELECT label, x // 20 AS g, count(*) AS voxel_count, round(covar_pop(x, x), 6) AS cxx, round(covar_pop(x, y), 6) AS cxy, round(covar_pop(y, z), 6) AS cyz, round(covar_pop(z, z), 6) AS czz
FROM vox GROUP BY 1, 2""")
def _moments(spark, d):
    g = voxel_map(spark, d).groupBy("label", F.expr("x div 20").alias("g")).agg(F.count(F.lit(1)).alias("voxel_count"), *obj._moments())
    return g.select("label", "g", "voxel_count", *[F.round(c, 6).alias(c) for c in ("cxx", "cxy", "cyz", "czz")])


@query("shape_features")
def _shapes(spark, d):
    g = voxel_map(spark, d).groupBy("label", F.expr("x div 20").alias("g")).agg(F.count(F.lit(1)).alias("voxel_count"), *obj._moments())
    return obj.shape_columns(g, 0.1)


@query("entities")
def _entities(spark, d):
    return obj.extract_entities(voxel_map(spark, d), 0.1, labels=(5, 16), eps=1.0, min_samples=3)[0]


@query("object_models")
def _models(spark, d):
    return obj.object_models(voxel_map(spark, d), 0.1, min_voxels=12, labels=(5, 16), max_extent_m=40.0)[0]


@query("merge_boxes", """
WITH RECURSIVE b AS MATERIALIZED (SELECT p_partkey AS id, p_size % 5 AS g, p_partkey * 2 AS x0, p_partkey * 2 + 6 AS x1, p_size * 3 AS y0, p_size * 3 + 4 AS y1 FROM part),
edge AS MATERIALIZED (SELECT p.id AS s, q.id AS t FROM b p JOIN b q ON p.g = q.g AND p.id <> q.id AND p.x0 <= q.x1 + 3 AND q.x0 <= p.x1 + 3 AND p.y0 <= q.y1 + 3 AND q.y0 <= p.y1 + 3),
walk(n, c) AS (SELECT id, id FROM b UNION SELECT e.t, w.c FROM walk w JOIN edge e ON e.s = w.n WHERE e.t > w.c)
SELECT n AS id, min(c) AS merged FROM walk GROUP BY n""")
def _merge_boxes(spark, d):
    p = table(spark, d, "part")
    boxes = p.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("g"), (F.col("p_partkey") * 2).alias("min_x"), (F.col("p_partkey") * 2 + 6).alias("max_x"),
        (F.col("p_size") * 3).cast("bigint").alias("min_y"), (F.col("p_size") * 3 + 4).cast("bigint").alias("max_y"), F.lit(0).cast("bigint").alias("min_z"), F.lit(2).cast("bigint").alias("max_z"))
    return obj.merge_boxes_once(boxes, "id", ["g"], 2)


@query("small_objects")
def _small(spark, d):
    li = table(spark, d, "lineitem")
    pts = li.select(
        (F.expr("l_partkey div 16") * 0.2 + (F.col("l_quantity") % 5) * 0.012).alias("px"), ((F.col("l_suppkey") % 4) * 0.012).alias("py"), (F.rint(F.col("l_tax") * 100) % 4 * 0.012).alias("pz"),
        F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 6).otherwise(5).alias("label"),
        (F.col("l_suppkey") % 256).cast("int").alias("r"), (F.col("l_orderkey") % 256).cast("int").alias("g"), (F.col("l_partkey") % 256).cast("int").alias("b"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return obj.small_object_instances(pts)


@query("snap_to_support", """
WITH f AS (SELECT p_partkey * 0.25::DOUBLE AS fx, (p_size % 7) * 0.1::DOUBLE AS fy, 0.3::DOUBLE AS hx, 0.2::DOUBLE AS hy FROM part),
s AS (SELECT o_orderkey AS id, o_custkey * 0.3::DOUBLE AS px, o_totalprice / 200000.0::DOUBLE AS py, 0.1::DOUBLE AS dy FROM orders),
m AS (SELECT s.id, max(fy - hy - 0.02::DOUBLE < py AND py < fy + hy + 0.02::DOUBLE) AS inside, max(CASE WHEN fy + hy <= py - dy / 2 + 0.05::DOUBLE THEN fy + hy END) AS top
  FROM s JOIN f ON abs(px - fx) <= hx GROUP BY s.id)
SELECT s.id, CASE WHEN NOT inside AND top IS NOT NULL AND py - dy / 2 - top <= 1.5::DOUBLE THEN top + dy / 2 ELSE py END AS pos_y,
  CASE WHEN NOT inside AND top IS NOT NULL AND py - dy / 2 - top <= 1.5::DOUBLE THEN 'furniture' END AS support FROM s LEFT JOIN m USING (id)""")
def _snap(spark, d):
    furn = table(spark, d, "part").select(
        (F.col("p_partkey") * 0.25).alias("pos_x"), ((F.col("p_size") % 7) * 0.1).alias("pos_y"), F.lit(0.0).alias("pos_z"),
        F.lit(0.6).alias("dim_x"), F.lit(0.4).alias("dim_y"), F.lit(1.0).alias("dim_z"))
    small = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 0.3).alias("pos_x"), (F.col("o_totalprice") / 200000.0).alias("pos_y"), F.lit(0.0).alias("pos_z"),
        F.lit(0.1).alias("dim_x"), F.lit(0.1).alias("dim_y"), F.lit(0.1).alias("dim_z"))
    return obj.snap_small_to_support(small, furn).select("id", "pos_y", "support")
