"""The named scene questions and scene graph maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxhive.operators import edits as ed, objects as obj, scene as sg
from voxhive.operators.features import extract_features, histogram_feature
from voxhive.plans.bindings import LABEL_SQL, SCENE_SQL, scene_nodes, table
from voxhive.plans.registry import query
from voxhive.session import cut

XYZ = sg.XYZ


@query("room_of_node", f"WITH RECURSIVE {SCENE_SQL} SELECT id, room FROM roomed")
def _room_of(spark, d):
    return sg.room_of(scene_nodes(spark, d))


@query("list_rooms", f"""WITH RECURSIVE {SCENE_SQL},
o AS (SELECT r.room, count(*) AS object_count, string_agg(DISTINCT label, ',' ORDER BY label) AS kinds FROM node n JOIN roomed r USING (id) WHERE layer = 'object' GROUP BY r.room),
p AS (SELECT parent, count(*) AS place_count FROM node WHERE layer = 'place' GROUP BY parent)
SELECT id AS room_id, x, y, z, coalesce(place_count, 0) AS place_count, coalesce(object_count, 0) AS object_count, coalesce(kinds, '') AS object_kinds
FROM node LEFT JOIN p ON p.parent = id LEFT JOIN o ON o.room = id WHERE layer = 'room'""")
def _list_rooms(spark, d):
    return sg.list_rooms(scene_nodes(spark, d))


@query("room_contents", f"""WITH RECURSIVE {SCENE_SQL}
SELECT id, label AS name, x, y, z, voxel_count, seen_count, CASE WHEN parent LIKE 'object%' THEN parent END AS on_top_of
FROM node JOIN roomed USING (id) WHERE layer = 'object' AND room = 'room:7'""")
def _contents(spark, d):
    return sg.room_contents(scene_nodes(spark, d), "room:7")


@query("find_object", f"""WITH RECURSIVE {SCENE_SQL}
SELECT id, label AS name, x, y, z, room, voxel_count, seen_count FROM node JOIN roomed USING (id) WHERE layer = 'object' AND contains(lower(label), 'urgent')""")
def _find(spark, d):
    return sg.find_object(scene_nodes(spark, d), "URGENT")


@query("get_object", f"""WITH RECURSIVE {SCENE_SQL}
SELECT n.id, n.label AS name, n.class, n.x, n.y, n.z, n.voxel_count, n.seen_count, n.misses, r.room, n.parent, p.layer AS parent_layer,
       coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM node WHERE parent = 'object:42'), '') AS children
FROM node n JOIN roomed r USING (id) LEFT JOIN node p ON p.id = n.parent WHERE n.id = 'object:42'""")
def _get(spark, d):
    return sg.get_object(scene_nodes(spark, d), "object:42")


@query("get_relations", f"""WITH RECURSIVE {SCENE_SQL},
up2 AS (SELECT parent, 1 AS depth FROM node WHERE id = 'object:42' UNION ALL SELECT n.parent, depth + 1 FROM up2 JOIN node n ON n.id = up2.parent)
SELECT 'ancestor' AS role, depth, n.id, n.layer FROM up2 JOIN node n ON n.id = up2.parent
UNION ALL SELECT 'child', 1, id, layer FROM node WHERE parent = 'object:42'""")
def _relations(spark, d):
    return sg.get_relations(scene_nodes(spark, d), "object:42")


@query("scene_summary", f"WITH {SCENE_SQL.split('up AS (')[0].rstrip().rstrip(',')} SELECT layer, count(*) AS nodes FROM node GROUP BY layer")
def _summary(spark, d):
    return sg.scene_summary(scene_nodes(spark, d))


@query("stacked_objects", f"""WITH {SCENE_SQL.split('up AS (')[0].rstrip().rstrip(',')}
SELECT n.id, n.label AS name, n.parent AS on_top_of, p.label AS support_name FROM node n JOIN node p ON p.id = n.parent WHERE n.layer = 'object' AND n.parent LIKE 'object%'""")
def _stacked(spark, d):
    return sg.stacked_objects(scene_nodes(spark, d))


@query("ancestors", f"""WITH RECURSIVE {SCENE_SQL}, lv AS (
  SELECT id, parent, 1 AS depth FROM node WHERE layer = 'object' UNION ALL SELECT lv.id, n.parent, depth + 1 FROM lv JOIN node n ON n.id = lv.parent)
SELECT lv.id, depth, n.id AS ancestor, n.layer FROM lv JOIN node n ON n.id = lv.parent""")
def _ancestors(spark, d):
    nodes = scene_nodes(spark, d)
    return sg.ancestors(nodes, nodes.where("layer = 'object'").select("id"))


@query("descendants", f"""WITH RECURSIVE {SCENE_SQL}, down AS (
  SELECT id, layer, parent, 1 AS depth FROM node WHERE parent = 'building:1' UNION ALL SELECT n.id, n.layer, n.parent, depth + 1 FROM down JOIN node n ON n.parent = down.id)
SELECT id, layer, parent, depth FROM down""")
def _descendants(spark, d):
    return sg.descendants(scene_nodes(spark, d), "building:1")


POSE_SQL = """robot AS (SELECT arg_max(event_id, ts) AS e, max(ts) AS t FROM events),
pose AS (SELECT epoch_us(ts) / 1000000.0::DOUBLE AS stamp, event_id % 100 + 0.25::DOUBLE AS x, user_id / 10.0::DOUBLE AS y, value AS z FROM events JOIN robot ON event_id = e)"""


def _robot(spark, d):
    from voxhive.plans.observation_queries import MICROS
    e = table(spark, d, "events")
    return sg.robot_pose(e.select((F.expr(MICROS) / 1000000.0).alias("stamp"), (F.col("event_id") % 100 + 0.25).alias("x"),
                                  (F.col("user_id") / 10.0).alias("y"), F.col("value").alias("z")))


@query("robot_pose", f"WITH {POSE_SQL} SELECT stamp, x, y, z FROM pose")
def _pose(spark, d):
    return _robot(spark, d)


@query("robot_room", f"""WITH RECURSIVE {SCENE_SQL}, {POSE_SQL},
near AS (SELECT n.id, sqrt((n.x - p.x) ** 2 + (n.y - p.y) ** 2) AS d FROM node n, pose p WHERE layer = 'place' ORDER BY (n.x - p.x) ** 2 + (n.y - p.y) ** 2, n.seq LIMIT 1),
here AS (SELECT room, near.id AS via_place, d FROM near JOIN roomed USING (id))
SELECT here.room AS room_id, via_place, round(d, 6) AS distance_m, count(*) AS object_count, string_agg(DISTINCT n.label, ',' ORDER BY n.label) AS objects
FROM here JOIN roomed r ON r.room = here.room JOIN node n ON n.id = r.id WHERE n.layer = 'object' GROUP BY ALL""")
def _robot_room(spark, d):
    return sg.robot_room(scene_nodes(spark, d), _robot(spark, d)).withColumn("distance_m", F.round("distance_m", 6))


@query("remove_nodes", f"""WITH RECURSIVE {SCENE_SQL},
gone AS (SELECT id, parent FROM node WHERE layer = 'object' AND seq % 5 = 0),
heir AS (SELECT id, parent AS h FROM gone UNION ALL SELECT heir.id, g.parent FROM heir JOIN gone g ON g.id = heir.h),
final AS (SELECT id, h FROM heir WHERE h NOT IN (SELECT id FROM gone))
SELECT n.id, coalesce(f.h, n.parent) AS parent FROM node n LEFT JOIN final f ON f.id = n.parent WHERE n.id NOT IN (SELECT id FROM gone)""")
def _remove(spark, d):
    nodes = scene_nodes(spark, d)
    return sg.remove_nodes(nodes, nodes.where("layer = 'object' AND seq % 5 = 0").select("id")).select("id", "parent")


@query("update_nodes", f"""WITH {SCENE_SQL.split('up AS (')[0].rstrip().rstrip(',')}
SELECT id, CASE WHEN layer = 'object' AND seq % 3 = 0 THEN 'renamed' ELSE label END AS label FROM node""")
def _update(spark, d):
    nodes = scene_nodes(spark, d)
    change = nodes.where("layer = 'object' AND seq % 3 = 0").select("id", F.lit("renamed").alias("label"))
    return sg.update_nodes(nodes, change).select("id", "label")


# ---------------------------------------------------------------- boxes from orders
BOXES_SQL = """box AS MATERIALIZED (SELECT o_orderkey AS seq, 'o' || o_orderkey AS id, o_custkey % 25 AS class,
  o_custkey * 1.0::DOUBLE * 0.1::DOUBLE AS min_x, o_custkey * 1.0::DOUBLE * 0.1::DOUBLE + 0.5::DOUBLE AS max_x,
  CAST(floor(o_totalprice / 50000) AS BIGINT) * 0.5::DOUBLE AS min_y, CAST(floor(o_totalprice / 50000) AS BIGINT) * 0.5::DOUBLE + 0.4::DOUBLE AS max_y,
  date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) * 0.01::DOUBLE AS min_z, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) * 0.01::DOUBLE + 0.5::DOUBLE AS max_z,
  CAST(floor(o_totalprice) AS BIGINT) AS voxel_count, 1 + o_orderkey % 4 AS seen_count FROM orders)"""


def order_boxes(spark, d):
    o = table(spark, d, "orders")
    x = F.col("o_custkey") * 1.0 * 0.1
    y = F.floor(F.col("o_totalprice") / 50000).cast("bigint") * F.lit(0.5)
    z = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) * F.lit(0.01)
    return o.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("o"), "o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("class"),
        x.alias("min_x"), (x + 0.5).alias("max_x"), y.alias("min_y"), (y + 0.4).alias("max_y"), z.alias("min_z"), (z + 0.5).alias("max_z"),
        F.floor("o_totalprice").cast("bigint").alias("voxel_count"), (1 + F.col("o_orderkey") % 4).alias("seen_count"))


@query("support_of", f"""WITH {BOXES_SQL}
SELECT b.id, arg_max(k.id, (k.max_y, -k.seq)) AS support FROM box b JOIN box k ON k.id <> b.id
 AND k.max_x >= b.min_x AND k.min_x <= b.max_x AND k.max_z >= b.min_z AND k.min_z <= b.max_z
 AND k.max_y <= b.min_y AND b.min_y <= k.max_y + 0.2::DOUBLE GROUP BY b.id""")
def _support(spark, d):
    return sg.support_of(order_boxes(spark, d))


@query("entity_order", f"""WITH {BOXES_SQL}
SELECT id, row_number() OVER (ORDER BY min_y, seq) - 1 AS by_bottom,
 row_number() OVER (ORDER BY -(1.0::DOUBLE * (max_x - min_x) * (max_y - min_y) * (max_z - min_z)), seq) - 1 AS by_volume FROM box""")
def _entity_order(spark, d):
    return obj.entity_order(order_boxes(spark, d)).select("id", "by_bottom", "by_volume")


@query("box_links", f"""WITH {BOXES_SQL}
SELECT CASE WHEN a.id < b.id THEN a.id ELSE b.id END AS src, CASE WHEN a.id < b.id THEN b.id ELSE a.id END AS dst FROM box a JOIN box b ON a.class = b.class AND a.seq < b.seq
 AND a.min_x <= b.max_x + 0.15::DOUBLE AND b.min_x <= a.max_x + 0.15::DOUBLE AND a.min_y <= b.max_y + 0.15::DOUBLE AND b.min_y <= a.max_y + 0.15::DOUBLE
 AND a.min_z <= b.max_z + 0.15::DOUBLE AND b.min_z <= a.max_z + 0.15::DOUBLE""")
def _links(spark, d):
    return obj.box_links(order_boxes(spark, d), "id", ["class"], 0.15, 2.0)


@query("consolidate_fragments", f"""WITH RECURSIVE {BOXES_SQL}, s AS MATERIALIZED (SELECT * FROM box WHERE seen_count >= 2),
edge AS MATERIALIZED (SELECT a.seq AS s, b.seq AS t FROM s a JOIN s b ON a.class = b.class AND a.seq <> b.seq
 AND a.min_x <= b.max_x + 0.15::DOUBLE AND b.min_x <= a.max_x + 0.15::DOUBLE AND a.min_y <= b.max_y + 0.15::DOUBLE AND b.min_y <= a.max_y + 0.15::DOUBLE
 AND a.min_z <= b.max_z + 0.15::DOUBLE AND b.min_z <= a.max_z + 0.15::DOUBLE),
walk(n, c) AS (SELECT seq, seq FROM s UNION SELECT e.t, w.c FROM walk w JOIN edge e ON e.s = w.n WHERE e.t > w.c),
comp AS (SELECT n, min(c) AS c FROM walk GROUP BY n),
f AS (SELECT c, arg_max(id, (voxel_count, -seq)) AS id, count(*) AS k, CAST(sum(voxel_count) AS BIGINT) AS voxel_count, max(seen_count) AS seen_count,
      min(min_x) AS min_x, max(max_y) AS max_y FROM comp JOIN s ON seq = n GROUP BY c),
lost AS (SELECT s.id FROM comp JOIN s ON seq = n JOIN f USING (c) WHERE s.id <> f.id)
SELECT b.id, coalesce(f.voxel_count, b.voxel_count) AS voxel_count, coalesce(f.seen_count, b.seen_count) AS seen_count,
       round(coalesce(f.min_x, b.min_x), 6) AS min_x, round(coalesce(f.max_y, b.max_y), 6) AS max_y
FROM box b LEFT JOIN f USING (id) WHERE b.id NOT IN (SELECT id FROM lost)""")
def _consolidate(spark, d):
    boxes = order_boxes(spark, d)
    nodes = boxes.withColumns({
        "layer": F.lit("object"), "parent": F.lit("room:0"), "x": (F.col("min_x") + F.col("max_x")) / 2,
        "y": (F.col("min_y") + F.col("max_y")) / 2, "z": (F.col("min_z") + F.col("max_z")) / 2})
    out = sg.consolidate_fragments(nodes)
    return out.select("id", "voxel_count", "seen_count", F.round("min_x", 6).alias("min_x"), F.round("max_y", 6).alias("max_y"))


@query("merge_observation", """
WITH e AS (SELECT o_custkey AS class, min(o_orderkey) AS seq, arg_min(o_totalprice, o_orderkey) / 100000.0::DOUBLE AS x, arg_min(o_orderkey % 4, o_orderkey) AS misses FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
f AS (SELECT o_custkey AS class, min(o_orderkey) AS seq, arg_min(o_totalprice, o_orderkey) / 100000.0::DOUBLE AS x FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
m AS (SELECT e.class FROM e JOIN f USING (class) WHERE abs(e.x - f.x) <= 0.5::DOUBLE)
SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM f WHERE class NOT IN (SELECT class FROM m)) AS added,
  (SELECT count(*) FROM e WHERE class NOT IN (SELECT class FROM m) AND misses + 1 > 3) AS removed,
  (SELECT count(*) FROM e WHERE class NOT IN (SELECT class FROM m) AND misses + 1 <= 3) AS carried,
  (SELECT count(*) FROM f) + (SELECT count(*) FROM e WHERE class NOT IN (SELECT class FROM m) AND misses + 1 <= 3) AS objects_total""")
def _merge(spark, d):
    o = table(spark, d, "orders")
    shape = {f"shape_{i}": F.lit(0.0) for i in range(3)}
    def side(status):
        first = F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey")
        g = o.where((F.col("o_orderstatus") == "F") == (status == "F")).groupBy(F.col("o_custkey").alias("class")).agg(first.alias("f"))
        return g.select("class", F.col("f.o_orderkey").alias("seq"), (F.col("f.o_totalprice") / 100000.0).alias("x"),
                        F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).withColumns(shape)
    old = side("F").withColumns({"id": F.concat(F.lit("object:"), "seq"), "misses": F.col("seq") % 4, "seen_count": F.lit(1).cast("bigint")})
    new = side("O").withColumn("fresh_id", F.col("seq").cast("string"))
    return sg.merge_stats(sg.merge_objects(old, new))


@query("match_objects")
def _match(spark, d):
    o = table(spark, d, "orders").withColumns({f"shape_{i}": F.lit(0.0) for i in range(3)})
    o = o.select((F.col("o_custkey") % 100).alias("class"), F.col("o_orderkey").alias("seq"), "o_orderstatus", "shape_0", "shape_1", "shape_2",
                 (F.col("o_totalprice") / 10000.0).alias("x"), (F.col("o_orderkey") % 37 + 0.0).alias("y"), F.lit(0.0).alias("z"))
    old = o.where("o_orderstatus = 'F'").withColumn("id", F.col("seq").cast("string"))
    new = o.where("o_orderstatus <> 'F'").withColumn("fresh_id", F.col("seq").cast("string"))
    return sg.match_objects(old, new, 2.0)


@query("feature_match", f"""
WITH old AS (SELECT o_custkey AS class, o_orderkey AS seq, o_totalprice / 100000.0::DOUBLE AS x FROM orders WHERE o_orderstatus = 'F'
  QUALIFY 1 IN (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC))),
new AS (SELECT o_custkey AS class, min(o_orderkey) AS seq, arg_min(o_totalprice, o_orderkey) / 100000.0::DOUBLE AS x FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
cell AS (SELECT l_orderkey AS seq, {LABEL_SQL} AS label FROM lineitem),
h AS (SELECT seq, count(*) AS n, count(*) FILTER (label = 3) AS a, count(*) FILTER (label = 5) AS b, count(*) FILTER (label = 16) AS c, count(*) FILTER (label = 19) AS d FROM cell GROUP BY seq),
pair AS (SELECT class, new.seq AS fresh, old.seq AS seq, abs(old.x - new.x) AS dist, CASE WHEN o.n IS NULL OR f.n IS NULL THEN 0
    ELSE 1 - (sqrt(o.a / o.n * (f.a / f.n)) + sqrt(o.b / o.n * (f.b / f.n)) + sqrt(o.c / o.n * (f.c / f.n)) + sqrt(o.d / o.n * (f.d / f.n))) END AS mix
  FROM new JOIN old USING (class) LEFT JOIN h o ON o.seq = old.seq LEFT JOIN h f ON f.seq = new.seq),
best AS (SELECT fresh, arg_min(seq, (dist, seq)) AS p, min(dist) AS pd, arg_min(seq, (dist + 3 * mix, seq)) AS q, arg_min(dist, (dist + 3 * mix, seq)) AS qd FROM pair GROUP BY fresh)
SELECT CAST(fresh AS VARCHAR) AS fresh_id, CAST(CASE WHEN pd <= 2 THEN p END AS VARCHAR) AS by_place, CAST(CASE WHEN qd <= 2 THEN q END AS VARCHAR) AS by_mixture FROM best""")
def _feature_match(spark, d):
    """Each customer's first open order against the first and last finished one: by place alone, and with the mixture of its line items."""
    kinds = F.when(F.col("label") == 3, 0).when(F.col("label") == 5, 1).when(F.col("label") == 16, 2).otherwise(3)
    mixture = histogram_feature("mixture", kinds, 4, 3.0)
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.expr(LABEL_SQL).alias("label"))
    found = extract_features(cells, ["seq"], [mixture])
    o = table(spark, d, "orders")

    def side(which, *picks):
        part = o.where(F.col("o_orderstatus") == which).groupBy(F.col("o_custkey").alias("class"))
        rows = part.agg(F.array_distinct(F.array(*[p(F.struct("o_orderkey", "o_totalprice")) for p in picks])).alias("r"))
        rows = rows.select("class", F.inline("r")).join(found.withColumnRenamed("seq", "o_orderkey"), "o_orderkey", "left")
        none = {c: F.lit(0.0) for c in sg.MATCH_COLS}
        return rows.withColumns({**none, "x": F.col("o_totalprice") / 100000.0, "seq": F.col("o_orderkey")})

    old = cut(side("F", F.min, F.max).withColumn("id", F.col("seq").cast("string")))
    new = cut(side("O", F.min).withColumn("fresh_id", F.col("seq").cast("string")))
    one = sg.match_objects(old, new, 2.0).select("fresh_id", F.col("id").alias("by_place"))
    two = sg.match_objects(old, new, 2.0, features=(mixture,)).select("fresh_id", F.col("id").alias("by_mixture"))
    known = new.join(old.select("class"), "class", "left_semi").select("fresh_id")
    return known.distinct().join(one, "fresh_id", "left").join(two, "fresh_id", "left")


@query("build_scene_graph", """
WITH place AS (SELECT c_custkey AS id, c_custkey % 300 AS i, 0 AS j, c_custkey // 300 AS k, c_nationkey AS room FROM customer),
pos AS (SELECT id, room, i * 0.1::DOUBLE AS x, j * 0.1::DOUBLE AS y, k * 0.1::DOUBLE AS z FROM place),
room AS (SELECT room, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pos GROUP BY room),
b AS (SELECT p_partkey AS seq, p_partkey % 200 AS x0, p_partkey % 200 + 8 AS x1, p_size * 5 AS y0, p_size * 5 + 4 AS y1, p_partkey // 200 * 4 AS z0, p_partkey // 200 * 4 + 6 AS z1 FROM part),
m AS MATERIALIZED (SELECT seq, x0 * 0.1::DOUBLE AS x0, x1 * 0.1::DOUBLE AS x1, y0 * 0.1::DOUBLE AS y0, y1 * 0.1::DOUBLE AS y1, z0 * 0.1::DOUBLE AS z0, z1 * 0.1::DOUBLE AS z1 FROM b),
sup AS (SELECT a.seq, arg_max(k.seq, (k.y1, -k.seq)) AS s FROM m a JOIN m k ON k.seq <> a.seq AND k.x1 >= a.x0 AND k.x0 <= a.x1 AND k.z1 >= a.z0 AND k.z0 <= a.z1
   AND k.y1 <= a.y0 AND a.y0 <= k.y1 + 0.2::DOUBLE GROUP BY a.seq)
SELECT 'building:0' AS id, 'building' AS layer, NULL AS parent, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z
UNION ALL SELECT 'room:' || room, 'room', 'building:0', x, y, z FROM room
UNION ALL SELECT 'place:' || id, 'place', 'room:' || room, round(x, 6), round(y, 6), round(z, 6) FROM pos
UNION ALL SELECT 'object:' || p_partkey, 'object', coalesce('object:' || s, 'room:' || room), round((p_partkey % 200 + 4) * 0.1::DOUBLE, 6), round((p_size * 5 + 2) * 0.1::DOUBLE, 6),
   round((p_partkey // 200 * 4 + 3) * 0.1::DOUBLE, 6) FROM part LEFT JOIN sup ON sup.seq = p_partkey JOIN pos ON pos.id = p_partkey % (SELECT count(*) FROM customer)""")
def _build(spark, d):
    cust = table(spark, d, "customer")
    places = cust.select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 300).alias("i"), F.lit(0).cast("bigint").alias("j"), F.expr("c_custkey div 300").alias("k"),
        F.col("c_nationkey").alias("room"), F.lit(1.0).alias("clearance_m"), F.lit(2).alias("degree"))
    n = cust.agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, d, "part").crossJoin(F.broadcast(n))
    x, y, z = F.col("p_partkey") % 200, F.col("p_size") * 5, F.expr("p_partkey div 200") * 4
    objects = p.select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("object:"), "p_partkey").alias("oid"), F.col("p_name").alias("label_name"), F.lit(1).alias("class"),
        (x + 4).alias("i"), (y + 2).alias("j"), (z + 3).alias("k"), x.alias("min_x"), (x + 8).alias("max_x"), y.alias("min_y"), (y + 4).alias("max_y"),
        z.alias("min_z"), (z + 6).alias("max_z"), F.lit(1).cast("bigint").alias("voxel_count"), (F.col("p_partkey") % F.col("n")).alias("place_id"),
        *[F.lit(0.0).alias(f"shape_{i}") for i in range(3)])
    graph = sg.build_scene_graph(places, objects, 0.1)
    return graph.select("id", "layer", "parent", *[F.round(a, 6).alias(a) for a in XYZ])


@query("voxel_in_box", """
WITH v AS MATERIALIZED (SELECT DISTINCT l_partkey // 4 + 0.5::DOUBLE AS x, l_quantity + 0.5::DOUBLE AS y, round(l_tax * 100) + 0.5::DOUBLE AS z FROM lineitem),
b AS (SELECT p_partkey AS seq, p_partkey // 4 + 2.0::DOUBLE AS cx, p_size + 0.0::DOUBLE AS cy, 4.0::DOUBLE AS cz, 3.0::DOUBLE AS hx, 2.0::DOUBLE AS hy, 2.5::DOUBLE AS hz, p_size % 10 + 1 AS mat FROM part)
SELECT x, y, z, arg_max(mat, seq) AS material FROM v JOIN b ON abs((x - cx) * 0.28::DOUBLE + (z - cz) * -0.96::DOUBLE) <= hx AND abs(y - cy) <= hy AND abs((x - cx) * 0.96::DOUBLE + (z - cz) * 0.28::DOUBLE) <= hz GROUP BY x, y, z""")
def _in_box(spark, d):
    from voxhive.plans.exports import overlay_boxes
    v = table(spark, d, "lineitem").select((F.expr("l_partkey div 4") + 0.5).alias("x"), (F.col("l_quantity") + 0.5).alias("y"), (F.rint(F.col("l_tax") * 100) + 0.5).alias("z")).distinct()
    b = table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), (F.expr("p_partkey div 4") + 2.0).alias("cx"), (F.col("p_size") + 0.0).alias("cy"), F.lit(4.0).alias("cz"),
        F.lit(3.0).alias("hx"), F.lit(2.0).alias("hy"), F.lit(2.5).alias("hz"), F.lit(0.0).alias("qx"), F.lit(0.6).alias("qy"), F.lit(0.0).alias("qz"), F.lit(0.8).alias("qw"),
        (F.col("p_size") % 10 + 1).alias("material"))
    return overlay_boxes(v, b, tile=8.0)


@query("entity_edits", """WITH log AS (
  SELECT l_suppkey AS session, ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey AS seq, l_orderkey AS id, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p, l_discount::DOUBLE AS t, l_returnflag AS f,
    CASE l_partkey % 8 WHEN 0 THEN 'undo' WHEN 1 THEN 'undo' WHEN 2 THEN 'spawn' WHEN 3 THEN 'delete' WHEN 6 THEN 'rotate' WHEN 7 THEN 'state' ELSE 'move' END AS op FROM lineitem),
stack AS (SELECT session, unnest(list_reduce(
    list({'st': [seq], 'hit': []::STRUCT(u BIGINT, d BIGINT)[], 'undo': op = 'undo'} ORDER BY seq),
    lambda a, e: CASE WHEN NOT e.undo THEN {'st': list_append(a.st, e.st[1])[-50:], 'hit': a.hit, 'undo': false}
                      WHEN len(a.st) = 0 THEN a
                      ELSE {'st': a.st[1:len(a.st) - 1], 'hit': list_append(a.hit, {'u': e.st[1], 'd': a.st[len(a.st)]}), 'undo': false} END,
    {'st': []::BIGINT[], 'hit': []::STRUCT(u BIGINT, d BIGINT)[], 'undo': false}).hit) AS h FROM log WHERE op <> 'state' GROUP BY session),
rec AS (
  SELECT o_orderkey AS id, -1 AS seq, 'spawn' AS op, o_totalprice::DOUBLE AS x, 0.0::DOUBLE AS yaw, NULL::VARCHAR AS state, o_orderstatus AS label FROM orders
  UNION ALL SELECT id, seq, op, CASE WHEN op = 'spawn' THEN q ELSE p END, CASE WHEN op = 'spawn' THEN q ELSE p END,
    CASE op WHEN 'spawn' THEN 'off' ELSE 'on' END, f FROM log WHERE op <> 'undo'
  UNION ALL SELECT id, h.u, CASE op WHEN 'spawn' THEN 'remove' WHEN 'delete' THEN 'restore' ELSE op END,
    CASE WHEN op = 'delete' THEN q ELSE t END, CASE WHEN op = 'delete' THEN q ELSE t END, 'off', f FROM stack JOIN log ON seq = h.d)
SELECT id, (arg_max({'v': x}, seq) FILTER (op IN ('spawn', 'restore', 'move'))).v AS x, (arg_max({'v': yaw}, seq) FILTER (op IN ('spawn', 'restore', 'rotate'))).v AS yaw,
  (arg_max({'v': state}, seq) FILTER (op IN ('spawn', 'restore', 'state'))).v AS state, (arg_max({'v': label}, seq) FILTER (op IN ('spawn', 'restore'))).v AS label
FROM rec GROUP BY id HAVING arg_max(op, seq) FILTER (op IN ('spawn', 'restore', 'delete', 'remove')) IN ('spawn', 'restore')""")
def _edits(spark, d):
    """Line items as edits of their order, made in one session per supplier."""
    kind = F.expr("CASE l_partkey % 8 WHEN 0 THEN 'undo' WHEN 1 THEN 'undo' WHEN 2 THEN 'spawn' WHEN 3 THEN 'delete' WHEN 6 THEN 'rotate' WHEN 7 THEN 'state' ELSE 'move' END")
    number = lambda c: F.array(F.col(c).cast("double"))
    entity = F.struct(number("l_quantity").alias("position"), number("l_quantity").alias("rotation"), F.lit("off").alias("state"), F.col("l_returnflag").alias("label"))
    log = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias("session"), F.expr("((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey").alias("seq"), kind.alias("op"),
        F.col("l_orderkey").cast("string").alias("id"), entity.alias("entity"), number("l_discount").alias("before"), number("l_extendedprice").alias("after"),
        F.lit("on").alias("state"))
    known = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), number("o_totalprice").alias("position"), F.array(F.lit(0.0)).alias("rotation"),
        F.lit(None).cast("string").alias("state"), F.col("o_orderstatus").alias("label"))
    done = ed.fold_entities(known, log)
    return done.select(F.col("id").cast("bigint").alias("id"), F.col("position")[0].alias("x"), F.col("rotation")[0].alias("yaw"), "state", "label")
