"""Queries over the labelled voxel map."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxhive.functions import geometry as geo, labels as lab
from voxhive.functions.cells import rounded_index
from voxhive.functions.morton import morton_key
from voxhive.operators import voxels as vx
from voxhive.operators.cluster import CORNER, FACE, cluster_cells, label_components, number_groups
from voxhive.plans.bindings import LABEL_SQL, POINTS_SQL, VOXELS_SQL, labelled_points, table, voxel_map
from voxhive.plans.registry import query

XYZ = vx.XYZ
FACES_SQL = "faces(dx, dy, dz) AS (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1))"


@query("voxelize", """
SELECT DISTINCT CAST(floor(l_extendedprice / 100.0::DOUBLE / 0.5::DOUBLE) AS BIGINT) AS x,
       CAST(floor(l_quantity / 0.5::DOUBLE) AS BIGINT) AS y, CAST(floor(l_suppkey / 0.5::DOUBLE) AS BIGINT) AS z FROM lineitem""")
def _voxelize(spark, d):
    pts = table(spark, d, "lineitem").select(
        (F.col("l_extendedprice") / 100.0).alias("x"), F.col("l_quantity").alias("y"), F.col("l_suppkey").alias("z"))
    return vx.voxelize(pts, 0.5)


@query("mesh_index", """
SELECT CAST(floor(l_extendedprice * (1.0::DOUBLE / 0.4::DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS x, count(*) AS n
FROM lineitem GROUP BY 1""")
def _mesh_index(spark, d):
    li = table(spark, d, "lineitem")
    return vx.histogram(li.select(rounded_index("l_extendedprice", 0.4).alias("x")), "x")


@query("frame_change", """
SELECT l_orderkey, l_linenumber, -l_quantity AS wx, l_tax AS wy, -l_extendedprice AS wz FROM lineitem""")
def _frame_change(spark, d):
    wx, wy, wz = geo.zup_to_yup("l_extendedprice", "l_quantity", "l_tax")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", wx.alias("wx"), wy.alias("wy"), wz.alias("wz"))


@query("unproject_depth", """
SELECT l_orderkey, l_linenumber, round((l_orderkey % 640 - 320.0::DOUBLE) * depth / 400.0::DOUBLE, 6) AS cx,
       round((l_partkey % 480 - 240.0::DOUBLE) * depth / 400.0::DOUBLE, 6) AS cy, round(depth, 6) AS cz
FROM (SELECT *, l_quantity / 2.5::DOUBLE AS depth FROM lineitem) WHERE depth > 0.5::DOUBLE AND depth < 16.0::DOUBLE""")
def _unproject(spark, d):
    px = table(spark, d, "lineitem").withColumn("depth", F.col("l_quantity") / 2.5)
    px = px.where(geo.depth_valid("depth", 0.5, 16.0))
    cx, cy, cz = geo.unproject(F.col("l_orderkey") % 640, F.col("l_partkey") % 480, "depth", 400.0, 400.0, 320.0, 240.0)
    return px.select("l_orderkey", "l_linenumber", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), F.round(cz, 6).alias("cz"))


@query("pixel_stride", """
SELECT l_returnflag, count(*) AS n FROM lineitem
WHERE l_orderkey % 4 = 0 AND l_partkey % 4 = 0 AND l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1""")
def _stride(spark, d):
    li = table(spark, d, "lineitem").where("l_orderkey % 4 = 0 AND l_partkey % 4 = 0 AND l_shipdate >= '1996-01-01'")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("chunk_table", f"""WITH {VOXELS_SQL}
SELECT CAST(x // 16 AS BIGINT) AS cx, CAST(y // 16 AS BIGINT) AS cy, CAST(z // 16 AS BIGINT) AS cz, count(*) AS cells,
       CAST(sum(((x % 16) * 16 + y % 16) * 16 + z % 16) AS BIGINT) AS positions FROM vox GROUP BY 1, 2, 3""")
def _chunks(spark, d):
    placed = vx.add_chunk(voxel_map(spark, d), 16)
    return placed.groupBy(*vx.CHUNK).agg(
        F.count(F.lit(1)).alias("cells"), F.sum((F.col("lx") * 16 + F.col("ly")) * 16 + F.col("lz")).alias("positions"))


@query("chunk_bounds", f"""WITH {VOXELS_SQL}
SELECT min(x // 16) AS cx_min, min(y // 16) AS cy_min, min(z // 16) AS cz_min,
       max(x // 16) + 1 AS cx_max, max(y // 16) + 1 AS cy_max, max(z // 16) + 1 AS cz_max FROM vox""")
def _bounds(spark, d):
    return vx.chunk_bounds(voxel_map(spark, d), 16)


@query("chunk_index_order", f"""WITH RECURSIVE {VOXELS_SQL},
chunk AS (SELECT DISTINCT x // 4 AS cx, y // 4 AS cy, z // 4 AS cz FROM vox),
bits AS (SELECT cx, cy, cz, CAST(sum(
    (((cx >> b) & 1)::HUGEINT << (3 * b)) + (((cy >> b) & 1)::HUGEINT << (3 * b + 1)) + (((cz >> b) & 1)::HUGEINT << (3 * b + 2))
  ) AS HUGEINT) AS m FROM chunk, range(0, 24) t(b) GROUP BY ALL)
SELECT cx, cy, cz, row_number() OVER (ORDER BY m) - 1 AS position FROM bits""")
def _index_order(spark, d):
    chunks = vx.add_chunk(voxel_map(spark, d), 4).select(*vx.CHUNK).distinct()
    keyed = chunks.withColumn("k", morton_key()).select("*", "k.hi", "k.lo").drop("k")
    return number_groups(keyed, ["hi", "lo"], "position").select(*vx.CHUNK, "position")


@query("majority_vote", f"WITH {VOXELS_SQL} SELECT x, y, z, label, total FROM vox")
def _majority(spark, d):
    return voxel_map(spark, d)


@query("denoise_by_count", f"WITH {VOXELS_SQL} SELECT x, y, z, label, total FROM vox WHERE label <> 0 AND total >= 2")
def _denoise(spark, d):
    return vx.drop_unseen(voxel_map(spark, d), 2)


@query("label_histogram", f"WITH {VOXELS_SQL} SELECT label, count(*) AS n FROM vox GROUP BY label")
def _histogram(spark, d):
    return vx.histogram(voxel_map(spark, d), "label")


@query("mean_per_cell", """
SELECT CAST(floor(l_partkey / 8.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(l_quantity / 8.0::DOUBLE) AS BIGINT) AS cy,
       CAST(floor(l_suppkey / 8.0::DOUBLE) AS BIGINT) AS cz, round(avg(l_partkey), 6) AS mx, round(avg(l_quantity), 6) AS my,
       round(avg(l_suppkey), 6) AS mz, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def _mean_cell(spark, d):
    pts = table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(a) for a, c in zip(XYZ, ("l_partkey", "l_quantity", "l_suppkey"))])
    out = vx.mean_per_cell(pts, 8.0)
    return out.select("cx", "cy", "cz", *[F.round(f"m{a}", 6).alias(f"m{a}") for a in XYZ], "n")


@query("coarsen", f"""WITH {VOXELS_SQL},
t AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, label, count(*) AS n FROM vox GROUP BY ALL)
SELECT x, y, z, CAST(sum(n) AS BIGINT) AS fine, arg_max(label, (n, -label)) AS label FROM t GROUP BY x, y, z HAVING sum(n) >= 2""")
def _coarsen(spark, d):
    return vx.coarsen(voxel_map(spark, d), 2, 2)


@query("lod_cells", f"""WITH {VOXELS_SQL},
k AS (SELECT min(i) AS f FROM range(1, 17) t(i), (SELECT count(*) AS n FROM vox) WHERE n <= 10000 * i * i * i)
SELECT x // f AS cx, y // f AS cy, z // f AS cz, arg_min(label, (x, y, z)) AS label FROM vox, k GROUP BY 1, 2, 3""")
def _lod(spark, d):
    vox = voxel_map(spark, d)
    return vx.lod_cells(vox, vx.lod_factor(vox, 10000), "label", F.struct(*XYZ))


@query("group_extent", f"""WITH {VOXELS_SQL}
SELECT label, x // 32 AS cx, count(*) AS voxel_count, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z,
       min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM vox GROUP BY 1, 2""")
def _extent(spark, d):
    out = vx.group_extent(vx.add_chunk(voxel_map(spark, d), 32), "label", "cx")
    return out.withColumns({f"mean_{a}": F.round(f"mean_{a}", 6) for a in XYZ})


@query("tight_crop", f"""WITH {VOXELS_SQL}, s AS (SELECT * FROM vox WHERE label = 3),
b AS (SELECT min(x)-1 AS x0, max(x)+1 AS x1, min(y)-1 AS y0, max(y)+1 AS y1, min(z)-1 AS z0, max(z)+1 AS z1 FROM s WHERE total >= 3)
SELECT x, y, z, label FROM vox, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1""")
def _crop(spark, d):
    vox = voxel_map(spark, d)
    return vx.clip(vox.select(*XYZ, "label"), vx.bounds(vox.where("label = 3 AND total >= 3"), 1))


@query("replace_region", f"""WITH {VOXELS_SQL}
SELECT x, y, z, label FROM vox WHERE NOT (x >= 10 AND x < 60 AND y >= 5 AND y < 30 AND z >= 0 AND z < 6)
UNION ALL SELECT x, y, z, label + 100 FROM vox WHERE x >= 10 AND x < 60 AND y >= 5 AND y < 30 AND z >= 0 AND z < 6 AND total > 1""")
def _replace(spark, d):
    vox = voxel_map(spark, d)
    fresh = vox.where("total > 1").select(*XYZ, (F.col("label") + 100).alias("label"))
    return vx.box_difference(vox.select(*XYZ, "label"), (10, 5, 0), (60, 30, 6), fresh)


@query("neighbour_counts", f"""WITH {VOXELS_SQL}, {FACES_SQL},
e AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z, 1 AS n, 0 AS own FROM vox, faces UNION ALL SELECT x, y, z, 0, 1 FROM vox)
SELECT x, y, z, CAST(sum(n) AS BIGINT) AS neighbours, max(own) AS occupied FROM e GROUP BY x, y, z""")
def _neighbours(spark, d):
    return vx.neighbour_counts(voxel_map(spark, d))


@query("exposed_faces", f"""WITH {VOXELS_SQL}, {FACES_SQL}
SELECT v.x, v.y, v.z, dx, dy, dz FROM vox v, faces f
WHERE NOT EXISTS (SELECT 1 FROM vox o WHERE o.x = v.x + f.dx AND o.y = v.y + f.dy AND o.z = v.z + f.dz)""")
def _faces(spark, d):
    return vx.exposed_faces(voxel_map(spark, d))


@query("close_holes", f"""WITH {VOXELS_SQL}, {FACES_SQL},
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM vox),
star AS (SELECT dx, dy, dz FROM faces UNION ALL SELECT 0, 0, 0),
grown AS (SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM vox, star, b
          WHERE x + dx BETWEEN x0 AND x1 AND y + dy BETWEEN y0 AND y1 AND z + dz BETWEEN z0 AND z1),
closed AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z FROM grown, star GROUP BY 1, 2, 3 HAVING count(*) = 7),
fresh AS (SELECT * FROM closed c WHERE NOT EXISTS (SELECT 1 FROM vox v WHERE v.x = c.x AND v.y = c.y AND v.z = c.z))
SELECT x, y, z, label, false AS filled FROM vox
UNION ALL SELECT f.x, f.y, f.z, arg_min(v.label, (v.x, v.y, v.z)), true FROM fresh f, faces o, vox v
WHERE v.x = f.x + dx AND v.y = f.y + dy AND v.z = f.z + dz GROUP BY f.x, f.y, f.z""")
def _close(spark, d):
    return vx.close_holes(voxel_map(spark, d), 1)


def _dangle_sql(src: str, dst: str) -> str:
    return f"""{dst} AS (SELECT v.x, v.y, v.z, v.label FROM {src} v, faces f, {src} o
      WHERE o.x = v.x + dx AND o.y = v.y + dy AND o.z = v.z + dz GROUP BY v.x, v.y, v.z, v.label HAVING count(*) > 1)"""


@query("prune_dangles", f"""WITH {VOXELS_SQL}, {FACES_SQL}, {_dangle_sql('vox', 'once')}, {_dangle_sql('once', 'twice')}
SELECT x, y, z, label FROM twice""")
def _dangles(spark, d):
    return vx.prune_dangles(voxel_map(spark, d), 2)


COMPONENT_SQL = """edge AS MATERIALIZED (SELECT a.id AS s, b.id AS t FROM cell a, faces f, cell b
   WHERE b.g = a.g AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
low AS MATERIALIZED (SELECT id FROM cell WHERE id NOT IN (SELECT s FROM edge WHERE t < s)),
walk(n, c) AS (SELECT id, id FROM low UNION SELECT e.t, w.c FROM walk w JOIN edge e ON e.s = w.n WHERE e.t > w.c),
comp AS MATERIALIZED (SELECT n, min(c) AS c FROM walk GROUP BY n)"""
COARSE_SQL = """coarse AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, label, count(*) AS n FROM vox GROUP BY ALL),
solid AS MATERIALIZED (SELECT x, y, z, arg_max(label, (n, -label)) AS label FROM coarse GROUP BY x, y, z HAVING sum(n) >= 3),
cell AS MATERIALIZED (SELECT *, 0 AS g, (x * 1024 + y) * 1024 + z AS id FROM solid)"""
CELL_SQL = "cell AS MATERIALIZED (SELECT *, 0 AS g, (x * 1024 + y) * 1024 + z AS id FROM vox)"


COMPONENTS_6_SQL = f"""WITH RECURSIVE {VOXELS_SQL}, {FACES_SQL}, {CELL_SQL}, {COMPONENT_SQL}
SELECT x, y, z, c // 1048576 AS first_x, (c // 1024) % 1024 AS first_y, c % 1024 AS first_z FROM cell JOIN comp ON n = id"""


@query("components_6", COMPONENTS_6_SQL)
def _components(spark, d):
    parts = label_components(voxel_map(spark, d), FACE)
    return parts.select(*XYZ, *[F.col(f"component.{a}").alias(f"first_{a}") for a in XYZ])


@query("components_6_star", COMPONENTS_6_SQL)
def _components_star(spark, d):
    """Small blocks and no closing task: every link goes through the distributed rounds."""
    parts = label_components(voxel_map(spark, d), FACE, block=4, tail_edges=0)
    return parts.select(*XYZ, *[F.col(f"component.{a}").alias(f"first_{a}") for a in XYZ])


FAR_SQL = COMPONENTS_6_SQL[:COMPONENTS_6_SQL.rindex("SELECT")] + """SELECT x + 1099511627776 AS x, y - 1099511627776 AS y, z + 4398046511104 AS z,
  c // 1048576 + 1099511627776 AS first_x, (c // 1024) % 1024 - 1099511627776 AS first_y, c % 1024 + 4398046511104 AS first_z FROM cell JOIN comp ON n = id"""


@query("components_6_far", FAR_SQL)
def _components_far(spark, d):
    """The same map 2**40 cells and more from the origin."""
    move = {"x": 1 << 40, "y": -(1 << 40), "z": 1 << 42}
    cells = voxel_map(spark, d).select(*[(F.col(a) + F.lit(n)).alias(a) for a, n in move.items()])
    parts = label_components(cells, FACE)
    return parts.select(*XYZ, *[F.col(f"component.{a}").alias(f"first_{a}") for a in XYZ])


@query("components_by_label", f"""WITH RECURSIVE {VOXELS_SQL},
faces(dx, dy, dz) AS (SELECT a.i, b.i, c.i FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i) WHERE NOT (a.i = 0 AND b.i = 0 AND c.i = 0)),
cell AS (SELECT *, label AS g, (x * 1024 + y) * 1024 + z AS id FROM vox WHERE total >= 2), {COMPONENT_SQL}
SELECT label, c // 1048576 AS first_x, (c // 1024) % 1024 AS first_y, c % 1024 AS first_z, count(*) AS n FROM cell JOIN comp ON n = id GROUP BY ALL""")
def _components_label(spark, d):
    parts = label_components(voxel_map(spark, d).where("total >= 2"), CORNER, ("label",))
    return parts.groupBy("label", *[F.col(f"component.{a}").alias(f"first_{a}") for a in XYZ]).agg(F.count(F.lit(1)).alias("n"))


@query("drop_small_components", f"""WITH RECURSIVE {VOXELS_SQL}, {FACES_SQL}, {COARSE_SQL}, {COMPONENT_SQL},
big AS (SELECT c FROM comp GROUP BY c HAVING count(*) >= 10)
SELECT x, y, z, label FROM cell JOIN comp ON n = id WHERE c IN (SELECT c FROM big)""")
def _drop_small(spark, d):
    coarse = vx.coarsen(voxel_map(spark, d), 2, 3).select(*XYZ, "label")
    return vx.drop_small_components(coarse, 10, FACE)


@query("keep_largest_component", f"""WITH RECURSIVE {VOXELS_SQL}, {FACES_SQL}, {COARSE_SQL}, {COMPONENT_SQL},
best AS (SELECT arg_max(c, (n, -c)) AS c FROM (SELECT c, count(*) AS n FROM comp GROUP BY c))
SELECT x, y, z, label FROM cell JOIN comp ON n = id JOIN best USING (c)""")
def _largest(spark, d):
    return vx.keep_largest_component(vx.coarsen(voxel_map(spark, d), 2, 3).select(*XYZ, "label"))


@query("clean_coarse", f"""WITH RECURSIVE {VOXELS_SQL}, {FACES_SQL},
coarse AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, label, count(*) AS n FROM vox GROUP BY ALL),
base AS (SELECT x, y, z, arg_max(label, (n, -label)) AS label FROM coarse GROUP BY x, y, z HAVING sum(n) >= 3),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM base),
star AS (SELECT dx, dy, dz FROM faces UNION ALL SELECT 0, 0, 0),
grown AS (SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM base, star, b
          WHERE x + dx BETWEEN x0 AND x1 AND y + dy BETWEEN y0 AND y1 AND z + dz BETWEEN z0 AND z1),
closed AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z FROM grown, star GROUP BY 1, 2, 3 HAVING count(*) = 7),
fresh AS (SELECT c.x, c.y, c.z, arg_min(v.label, (v.x, v.y, v.z)) AS label FROM closed c, faces o, base v
          WHERE v.x = c.x + dx AND v.y = c.y + dy AND v.z = c.z + dz
            AND NOT EXISTS (SELECT 1 FROM base q WHERE q.x = c.x AND q.y = c.y AND q.z = c.z) GROUP BY c.x, c.y, c.z),
vox2 AS (SELECT base.* FROM base WHERE (SELECT count(*) FROM fresh) = 0 OR (x, y, z) IN (SELECT (x, y, z) FROM closed)
         UNION ALL SELECT * FROM fresh),
cell AS (SELECT *, 0 AS g, (x * 1024 + y) * 1024 + z AS id FROM vox2), {COMPONENT_SQL},
big AS (SELECT c FROM comp GROUP BY c HAVING count(*) >= 4)
SELECT x, y, z, label FROM cell JOIN comp ON n = id WHERE c IN (SELECT c FROM big)""")
def _clean(spark, d):
    return vx.clean_coarse(vx.coarsen(voxel_map(spark, d), 2, 3), 4, 1)


@query("dbscan", f"""WITH RECURSIVE {VOXELS_SQL},
faces(dx, dy, dz) AS (SELECT a.i, b.i, c.i FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i)
   WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 4 AND NOT (a.i = 0 AND b.i = 0 AND c.i = 0)),
pt AS (SELECT *, (x * 1024 + y) * 1024 + z AS id FROM vox WHERE total >= 2),
pair AS MATERIALIZED (SELECT a.id AS s, b.id AS t FROM pt a, faces, pt b
   WHERE b.label = a.label AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
core AS MATERIALIZED (SELECT p.id FROM pt p LEFT JOIN pair ON s = p.id GROUP BY p.id HAVING count(t) + 1 >= 3),
edge AS MATERIALIZED (SELECT s, t FROM pair WHERE s IN (SELECT id FROM core) AND t IN (SELECT id FROM core)),
low AS MATERIALIZED (SELECT id FROM core WHERE id NOT IN (SELECT s FROM edge WHERE t < s)),
walk(n, c) AS (SELECT id, id FROM low UNION SELECT e.t, w.c FROM walk w JOIN edge e ON e.s = w.n WHERE e.t > w.c),
comp AS MATERIALIZED (SELECT n, min(c) AS c FROM walk GROUP BY n),
fringe AS (SELECT s AS n, min(c) AS c FROM pair JOIN comp ON comp.n = t WHERE s NOT IN (SELECT id FROM core) GROUP BY s),
found AS (SELECT * FROM comp UNION ALL SELECT * FROM fringe)
SELECT label, x, y, z, coalesce((c // 1048576), -1) AS first_x, coalesce((c // 1024) % 1024, -1) AS first_y FROM pt LEFT JOIN found ON n = id""")
def _dbscan(spark, d):
    out = cluster_cells(voxel_map(spark, d).where("total >= 2"), 2.0, 3, ("label",))
    return out.select("label", *XYZ, *[F.coalesce(F.col(f"cluster.{a}"), F.lit(-1)).alias(f"first_{a}") for a in ("x", "y")])


@query("rle_runs", f"""WITH {VOXELS_SQL},
grid AS (SELECT c.cx, c.cy, c.cz, p.i AS pos FROM (SELECT DISTINCT x // 16 AS cx, y // 16 AS cy, z // 16 AS cz FROM vox) c, range(0, 4096) p(i)),
solid AS (SELECT x // 16 AS cx, y // 16 AS cy, z // 16 AS cz, ((x % 16) * 16 + y % 16) * 16 + z % 16 AS pos, label FROM vox),
full_chunk AS (SELECT g.*, coalesce(s.label, 0) AS v FROM grid g LEFT JOIN solid s USING (cx, cy, cz, pos)),
mark AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM full_chunk WINDOW w AS (PARTITION BY cx, cy, cz ORDER BY pos)),
run AS (SELECT *, sum(new) OVER (PARTITION BY cx, cy, cz ORDER BY pos) AS r FROM mark),
piece AS (SELECT *, (pos - min(pos) OVER (PARTITION BY cx, cy, cz, r)) // 255 AS k FROM run)
SELECT cx, cy, cz, min(pos) AS start, CAST(count(*) AS INTEGER) AS length, any_value(v) AS value FROM piece GROUP BY cx, cy, cz, r, k""")
def _rle(spark, d):
    return vx.rle_runs(voxel_map(spark, d).select(*XYZ, F.col("label").alias("value")), 16)


@query("march_rays", f"""WITH {VOXELS_SQL},
ray AS (SELECT p_partkey AS ray_id, p_partkey // 4 + 0.0::DOUBLE AS ox, -3.0::DOUBLE AS oy, p_size % 9 + 0.0::DOUBLE AS oz,
               (p_size % 3 - 1) * 0.25::DOUBLE AS dx, 1.0::DOUBLE AS dy, 0.125::DOUBLE AS dz FROM part),
unit AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len FROM ray),
path AS (SELECT ray_id, s, CAST(round(ox + dx / len * (s * 0.5::DOUBLE)) AS BIGINT) AS x, CAST(round(oy + dy / len * (s * 0.5::DOUBLE)) AS BIGINT) AS y,
                CAST(round(oz + dz / len * (s * 0.5::DOUBLE)) AS BIGINT) AS z FROM unit, range(0, 121) t(s)),
seen AS (SELECT ray_id, x, y, z, min(s) AS s FROM path GROUP BY ALL),
hit AS (SELECT ray_id, min(s) AS hs FROM seen JOIN vox USING (x, y, z) GROUP BY ray_id),
upto AS (SELECT seen.*, hs FROM seen JOIN hit USING (ray_id) WHERE s <= hs),
h AS (SELECT ray_id, x AS hit_x, y AS hit_y, z AS hit_z FROM upto WHERE s = hs),
p AS (SELECT ray_id, arg_max(x, s) AS px, arg_max(y, s) AS py, arg_max(z, s) AS pz FROM upto WHERE s < hs GROUP BY ray_id)
SELECT ray_id, hit_x, hit_y, hit_z, coalesce(px, hit_x) AS prev_x, coalesce(py, hit_y) AS prev_y, coalesce(pz, hit_z) AS prev_z FROM h LEFT JOIN p USING (ray_id)""")
def _march(spark, d):
    rays = table(spark, d, "part").select(
        F.col("p_partkey").alias("ray_id"), (F.expr("p_partkey div 4") + F.lit(0.0)).alias("ox"), F.lit(-3.0).alias("oy"),
        (F.col("p_size") % 9 + F.lit(0.0)).alias("oz"), ((F.col("p_size") % 3 - 1) * 0.25).alias("dx"), F.lit(1.0).alias("dy"), F.lit(0.125).alias("dz"))
    return vx.march_rays(rays, voxel_map(spark, d), 1.0, 60.0)


@query("stamp_markers", f"""WITH {VOXELS_SQL},
node AS (SELECT DISTINCT p_partkey // 4 AS x, p_size AS y, 4 AS z FROM part),
cube AS (SELECT DISTINCT x + a.i AS x, y + b.i AS y, z + c.i AS z FROM node, range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i))
SELECT x, y, z, label FROM vox WHERE (x, y, z) NOT IN (SELECT (x, y, z) FROM cube) UNION ALL SELECT x, y, z, 255 FROM cube""")
def _stamp(spark, d):
    part = table(spark, d, "part")
    nodes = part.select(F.expr("p_partkey div 4").alias("x"), F.col("p_size").cast("bigint").alias("y"), F.lit(4).cast("bigint").alias("z")).distinct()
    marks = vx.marker_cells(nodes, 1).withColumn("label", F.lit(255))
    return vx.stamp(voxel_map(spark, d).select(*XYZ, "label"), marks)


EDITS_SQL = """edits AS (SELECT l_orderkey * 8 + l_linenumber AS seq, x, y, z,
   CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 + l_suppkey % 20 END AS m, l_suppkey FROM (
   SELECT *, l_partkey // 4 AS x, CAST(l_quantity AS BIGINT) AS y, CAST(round(l_tax * 100) AS BIGINT) AS z FROM lineitem))"""


def _edits(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.struct(F.col("l_orderkey") * 8 + F.col("l_linenumber"), "l_suppkey").alias("seq"), F.expr("l_partkey div 4").alias("x"),
        F.col("l_quantity").cast("bigint").alias("y"), F.rint(F.col("l_tax") * 100).cast("bigint").alias("z"),
        F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(1 + F.col("l_suppkey") % 20).cast("int").alias("label"))


@query("apply_edits", f"""WITH {VOXELS_SQL}, {EDITS_SQL},
final AS (SELECT x, y, z, CAST(arg_max(m, (seq, l_suppkey)) AS INTEGER) AS label FROM edits GROUP BY x, y, z)
SELECT x, y, z, label FROM vox WHERE (x, y, z) NOT IN (SELECT (x, y, z) FROM final) UNION ALL SELECT * FROM final WHERE label <> 0""")
def _apply_edits(spark, d):
    return vx.apply_edits(voxel_map(spark, d), _edits(spark, d), ["label"])


@query("undo_edits", """
SELECT l_orderkey * 8 + l_linenumber + 1000000000 AS seq, l_partkey // 4 AS x, CAST(l_quantity AS BIGINT) AS y, CAST(round(l_tax * 100) AS BIGINT) AS z,
       CAST(CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS material_id, CAST(0 AS SMALLINT) AS semantic_id FROM lineitem""")
def _undo(spark, d):
    li = table(spark, d, "lineitem").withColumn("seq", F.monotonically_increasing_id())
    log = li.select("seq", F.expr("l_partkey div 4").alias("x"), F.col("l_quantity").cast("bigint").alias("y"),
                    F.rint(F.col("l_tax") * 100).cast("bigint").alias("z"),
                    F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(5).alias("material_id"),
                    (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("stamp"))
    from voxhive.session import cut
    log = cut(log)
    undone = log.select("seq", (F.col("stamp") + 1000000000).alias("undo_seq"))
    return vx.undo_edits(log, undone)


@query("dirty_chunks", f"WITH {EDITS_SQL} SELECT DISTINCT x // 16 AS cx, y // 16 AS cy, z // 16 AS cz FROM edits")
def _dirty(spark, d):
    return vx.dirty_chunks(_edits(spark, d), 16)


@query("spawn_hint", f"""WITH {VOXELS_SQL}, fl AS (SELECT x, y, z FROM vox WHERE label = 3),
m AS (SELECT avg(x) AS mx, avg(z) AS mz FROM fl),
room AS (SELECT * FROM fl WHERE NOT EXISTS (SELECT 1 FROM vox v WHERE v.x = fl.x AND v.z = fl.z AND v.y > fl.y AND v.y <= fl.y + 5)),
best AS (SELECT * FROM room, m ORDER BY (x - mx) * (x - mx) + (z - mz) * (z - mz), x, y, z LIMIT 1)
SELECT round((x + 0.5::DOUBLE) * 0.5::DOUBLE, 3) AS spawn_x, round((y + 1) * 0.5::DOUBLE + 1.0::DOUBLE, 3) AS spawn_y,
       round((z + 0.5::DOUBLE) * 0.5::DOUBLE, 3) AS spawn_z,
       round(degrees(atan2(mx * 0.5::DOUBLE - (x + 0.5::DOUBLE) * 0.5::DOUBLE, -(mz * 0.5::DOUBLE - (z + 0.5::DOUBLE) * 0.5::DOUBLE))), 1) AS yaw_deg FROM best""")
def _spawn(spark, d):
    return vx.spawn_hint(voxel_map(spark, d), 0.5)


@query("standable_spot", f"""WITH {VOXELS_SQL}, m AS (SELECT round(avg(x)) AS mx, round(avg(z)) AS mz FROM vox),
room AS (SELECT * FROM vox o WHERE NOT EXISTS (SELECT 1 FROM vox v WHERE v.x = o.x AND v.z = o.z AND v.y > o.y AND v.y <= o.y + 4))
SELECT x, y, z FROM room, m ORDER BY (x - mx) * (x - mx) + (z - mz) * (z - mz), x, z, y LIMIT 1""")
def _stand(spark, d):
    return vx.standable_spot(voxel_map(spark, d), 0.5)


@query("fill_holes_2d", f"""WITH RECURSIVE {VOXELS_SQL}, foot AS (SELECT DISTINCT z, x, y FROM vox WHERE label IN (3, 16) OR total > 1),
b AS (SELECT z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM foot GROUP BY z),
area AS (SELECT z, x, y, x0, x1, y0, y1 FROM b, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)),
gap AS MATERIALIZED (SELECT * FROM area a WHERE NOT EXISTS (SELECT 1 FROM foot f WHERE f.z = a.z AND f.x = a.x AND f.y = a.y)),
outer_gap AS (SELECT z, x, y FROM gap WHERE x = x0 OR x = x1 OR y = y0 OR y = y1
   UNION SELECT g.z, g.x, g.y FROM outer_gap o, (VALUES (1,0),(-1,0),(0,1),(0,-1)) s(dx, dy), gap g WHERE g.z = o.z AND g.x = o.x + dx AND g.y = o.y + dy)
SELECT z, x, y FROM gap WHERE (z, x, y) NOT IN (SELECT (z, x, y) FROM outer_gap)""")
def _holes(spark, d):
    foot = voxel_map(spark, d).where("label IN (3, 16) OR total > 1").select("z", "x", "y")
    return vx.fill_holes_2d(foot, ("z",), "x", "y")


# ---------------------------------------------------------------- dimension lookups
@query("material_lookup", """
SELECT l_orderkey, l_linenumber, coalesce(n.n_name, 'stone') AS material FROM lineitem
LEFT JOIN nation n ON n.n_nationkey = l_suppkey % 30""")
def _material(spark, d):
    dim = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    li = table(spark, d, "lineitem").withColumn("k", (F.col("l_suppkey") % 30).cast("int"))
    return li.join(F.broadcast(dim), "k", "left").select("l_orderkey", "l_linenumber", F.coalesce("n_name", F.lit("stone")).alias("material"))


@query("colour_to_label", """WITH lut AS (SELECT (n_nationkey * 65536) + (n_regionkey * 256) + n_nationkey AS k, n_nationkey + 1 AS label FROM nation)
SELECT l_orderkey, l_linenumber, coalesce(label, 0) AS label FROM (
  SELECT *, (l_suppkey % 26) * 65536 + (l_partkey % 5) * 256 + l_suppkey % 26 AS k FROM lineitem) LEFT JOIN lut USING (k)""")
def _colour(spark, d):
    lut = table(spark, d, "nation").select(lab.packed_rgb("n_nationkey", "n_regionkey", "n_nationkey").alias("k"), (F.col("n_nationkey") + 1).alias("label"))
    li = table(spark, d, "lineitem").withColumn("k", lab.packed_rgb(F.col("l_suppkey") % 26, F.col("l_partkey") % 5, F.col("l_suppkey") % 26))
    return li.join(F.broadcast(lut), "k", "left").select("l_orderkey", "l_linenumber", F.coalesce("label", F.lit(0)).alias("label"))


@query("structure_names", """
SELECT p_name, regexp_matches(lower(p_name), 'wall|ceiling|roof|building|floor|ground|carpet|rug|pillar|column|beam|stair|sky') AS structure,
       count(*) AS n FROM part GROUP BY 1, 2""")
def _structure(spark, d):
    return table(spark, d, "part").select("p_name", lab.is_structure_name("p_name").alias("structure")).groupBy("p_name", "structure").agg(F.count(F.lit(1)).alias("n"))


@query("label_colour", """WITH h AS (SELECT p_partkey, md5('sem_label_' || p_partkey) AS m FROM part)
SELECT p_partkey, CAST(60 + ('0x' || m[1:2])::INTEGER % 170 AS INTEGER) AS r, CAST(60 + ('0x' || m[3:4])::INTEGER % 170 AS INTEGER) AS g,
       CAST(60 + ('0x' || m[5:6])::INTEGER % 170 AS INTEGER) AS b FROM h""")
def _label_colour(spark, d):
    c = lab.label_colour("p_partkey")
    return table(spark, d, "part").select("p_partkey", *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate("rgb")])


@query("stable_ids", """WITH h AS (SELECT p_partkey, md5('small-' || p_size || '-' || p_partkey) AS m FROM part)
SELECT p_partkey, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS id FROM h""")
def _ids(spark, d):
    return table(spark, d, "part").select("p_partkey", lab.uuid_from(F.concat_ws("-", F.lit("small"), "p_size", "p_partkey")).alias("id"))


@query("cluster_material", """
SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 2 + least(p_partkey, 253) END AS SMALLINT) AS material_id FROM part""")
def _cluster_material(spark, d):
    label = F.when(F.col("p_partkey") % 7 == 0, F.lit(-1)).otherwise(F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", lab.cluster_material(label, True).alias("material_id"))


@query("block_names", """
SELECT regexp_replace(regexp_replace('minecraft:' || replace(p_name, ' ', '_') || '[size=' || p_size || ']', '^minecraft:', ''), '\\[.*$', '') AS block, count(*) AS n
FROM part GROUP BY 1""")
def _blocks(spark, d):
    raw = F.concat(F.lit("minecraft:"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("[size="), "p_size", F.lit("]"))
    return table(spark, d, "part").select(lab.block_name(raw).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query("category_material", """WITH kw(word, mat, pri) AS (VALUES ('ring', 4, 0), ('bolt', 5, 1), ('red', 6, 2), ('widget', 7, 3))
SELECT p_partkey, coalesce((SELECT mat FROM kw WHERE contains(lower(p_name), word) ORDER BY pri LIMIT 1), 1) AS material FROM part""")
def _category(spark, d):
    from voxhive.sources.catalogues import category_material
    return table(spark, d, "part").select("p_partkey", category_material(F.col("p_name"), {"ring": 4, "bolt": 5, "red": 6, "widget": 7}).alias("material"))
