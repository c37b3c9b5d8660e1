"""Queries that go through the chunk codec and the JSON readers, and streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxhive.operators.bands import surface_band
from voxhive.operators.voxels import XYZ
from voxhive.plans.bindings import SCENE_SQL, VOXELS_SQL, scene_nodes, table, voxel_map
from voxhive.plans.registry import query
from voxhive.session import cut
from voxhive.sources import exchange as ex, regions as rg
from voxhive.sources import verify as vf, worlds as ws
from voxhive.sources.clouds import mesh_cells


def _world(spark, d):
    from voxhive.plans.exports import world_cells
    return world_cells(voxel_map(spark, d))


@query("chunk_round_trip", f"""WITH {VOXELS_SQL}
SELECT x, y, z, CAST(label AS SMALLINT) AS material_id, CAST(label AS SMALLINT) AS semantic_id, CAST(0 AS SMALLINT) AS state, CAST(0 AS SMALLINT) AS color_palette_idx FROM vox""")
def _round_trip(spark, d):
    return ws.decode_chunks(ws.encode_chunks(_world(spark, d), 16, ws.RLE, ws.GZIP))


@query("chunk_round_trip_dense", f"""WITH {VOXELS_SQL} SELECT x, y, z, CAST(label AS SMALLINT) AS material_id FROM vox""")
def _round_trip_dense(spark, d):
    return ws.decode_chunks(ws.encode_chunks(_world(spark, d), 16, ws.DENSE, ws.ZSTD)).select(*XYZ, "material_id")


@query("chunk_sizes_raw", f"""WITH {VOXELS_SQL},
grid AS (SELECT c.cx, c.cy, c.cz, p.i AS pos FROM (SELECT DISTINCT x // 16 AS cx, y // 16 AS cy, z // 16 AS cz FROM vox) c, range(0, 4096) p(i)),
solid AS (SELECT x // 16 AS cx, y // 16 AS cy, z // 16 AS cz, ((x % 16) * 16 + y % 16) * 16 + z % 16 AS pos, label FROM vox),
f AS (SELECT g.*, coalesce(s.label, 0) AS v FROM grid g LEFT JOIN solid s USING (cx, cy, cz, pos)),
m AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY cx, cy, cz ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY cx, cy, cz ORDER BY pos) AS run FROM m),
n AS (SELECT cx, cy, cz, run, CAST(ceil(count(*) / 255.0) AS BIGINT) AS k FROM r GROUP BY ALL)
SELECT cx, cy, cz, CAST(28 + 4 + 5 * sum(k) + 4 AS BIGINT) AS size_bytes FROM n GROUP BY cx, cy, cz""")
def _sizes(spark, d):
    return ws.encode_chunks(_world(spark, d), 16, ws.RLE, ws.RAW).select("cx", "cy", "cz", "size_bytes")


@query("verify_export", f"""WITH {VOXELS_SQL},
c AS (SELECT x // 16 AS cx, y // 16 AS cy, z // 16 AS cz, count(*) AS n FROM vox GROUP BY ALL),
k AS (SELECT *, (cx * 7 + cy * 3 + cz) % 11 AS fault FROM c)
SELECT cx, cy, cz, CASE fault WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'different' WHEN 4 THEN 'unexpected' ELSE 'ok' END AS status,
  CASE WHEN fault = 4 THEN 0 ELSE n END AS cells_expected, CASE WHEN fault < 3 THEN 0 ELSE n END AS cells_found FROM k""")
def _verify(spark, d):
    """Chunks lost, with a broken checksum, cut short, with other classes and without a source are told from sound ones."""
    fault = lambda *c: F.expr("({} * 7 + {} * 3 + {}) % 11".format(*c))
    world = cut(_world(spark, d).withColumn("fault", fault(*[f"floor({a} / 16)" for a in XYZ])))
    drifted = world.withColumn("semantic_id", (F.col("semantic_id") + F.when(F.col("fault") == 3, 1).otherwise(0)).cast("smallint"))
    files = ws.encode_chunks(drifted, 16, ws.RLE, ws.GZIP).withColumn("fault", fault("cx", "cy", "cz")).where("fault <> 0")
    content = F.expr("CASE fault WHEN 1 THEN concat(substring(content, 1, length(content) - 4), X'00000000') "
                     "WHEN 2 THEN substring(content, 1, 20) ELSE content END")
    report = vf.verify_chunks(world.where("fault <> 4").drop("fault"), files.withColumn("content", content), 16)
    return report.drop("error")


@query("surface_band", """
WITH p AS (SELECT l_partkey * 0.25::DOUBLE + l_tax AS px, l_quantity * 0.25::DOUBLE + l_discount AS py, l_extendedprice / 10000.0::DOUBLE AS pz FROM lineitem),
o AS (SELECT a.i, b.j, c.k FROM range(-2, 3) a(i), range(-2, 3) b(j), range(-2, 3) c(k)),
q AS (SELECT CAST(floor(px / 0.5::DOUBLE) AS BIGINT) + i AS x, CAST(floor(py / 0.5::DOUBLE) AS BIGINT) + j AS y, CAST(floor(pz / 0.5::DOUBLE) AS BIGINT) + k AS z, px, py, pz FROM p, o),
d AS (SELECT x, y, z, (x + 0.5::DOUBLE) * 0.5::DOUBLE - px AS dx, (y + 0.5::DOUBLE) * 0.5::DOUBLE - py AS dy, (z + 0.5::DOUBLE) * 0.5::DOUBLE - pz AS dz FROM q)
SELECT DISTINCT x, y, z FROM d WHERE sqrt(dx * dx + dy * dy + dz * dz) <= 0.6::DOUBLE""")
def _band(spark, d):
    l = table(spark, d, "lineitem")
    return surface_band(l.select((F.col("l_partkey") * 0.25 + F.col("l_tax")).alias("px"), (F.col("l_quantity") * 0.25 + F.col("l_discount")).alias("py"),
                                 (F.col("l_extendedprice") / 10000.0).alias("pz")), 0.5, 0.6)


@query("event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("mesh_cells", """
WITH t AS (SELECT p_partkey * 0.5::DOUBLE AS ax, 0.125::DOUBLE AS ay, p_size * 1.0::DOUBLE AS az, p_partkey * 0.5::DOUBLE + 2.0::DOUBLE AS bx, 1.125::DOUBLE AS byy, p_size * 1.0::DOUBLE AS bz,
  p_partkey * 0.5::DOUBLE AS cx, 0.625::DOUBLE AS cy, p_size + 2.0::DOUBLE AS cz FROM part),
n AS (SELECT *, greatest(1, CAST(ceil(greatest(sqrt((ax-bx)**2+(ay-byy)**2+(az-bz)**2), sqrt((bx-cx)**2+(byy-cy)**2+(bz-cz)**2), sqrt((ax-cx)**2+(ay-cy)**2+(az-cz)**2)) / 0.5::DOUBLE) AS BIGINT)) AS n FROM t),
g AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n), h AS (SELECT *, unnest(range(0, n - i + 1)) AS j FROM g),
p AS (SELECT *, i::DOUBLE / n AS u, j::DOUBLE / n AS v FROM h)
SELECT DISTINCT CAST(floor((ax * (1 - u - v) + bx * u + cx * v) / 1.0::DOUBLE) AS BIGINT) AS x, CAST(floor((ay * (1 - u - v) + byy * u + cy * v) / 1.0::DOUBLE) AS BIGINT) AS y,
  CAST(floor((az * (1 - u - v) + bz * u + cz * v) / 1.0::DOUBLE) AS BIGINT) AS z FROM p""")
def _mesh(spark, d):
    p = table(spark, d, "part")
    x, z = F.col("p_partkey") * 0.5, F.col("p_size") * 1.0
    tri = p.select(x.alias("ax"), F.lit(0.125).alias("ay"), z.alias("az"), (x + 2.0).alias("bx"), F.lit(1.125).alias("by"), z.alias("bz"),
                   x.alias("cx"), F.lit(0.625).alias("cy"), (F.col("p_size") + 2.0).alias("cz"))
    return mesh_cells(tri, 1.0)


@query("streaming_fold", """
SELECT user_id, round(list_reduce(list((CASE event_type WHEN 'click' THEN 0.85 WHEN 'purchase' THEN 0.85 ELSE -0.4 END)::FLOAT ORDER BY ts, event_id),
  lambda a, e: least(3.5::FLOAT, greatest((-2)::FLOAT, a + e)), 0::FLOAT)::DOUBLE, 5) AS logodds FROM events GROUP BY user_id""")
def _stream(spark, d):
    from voxhive.operators import observation as ob
    from voxhive.streaming.maps import MapUpdater, run_map_stream, shared_folder

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    hit = F.col("event_type").isin("click", "purchase").cast("int")
    zero = F.lit(0).cast("bigint")
    evidence = stream.select(F.col("event_id").alias("frame_seq"), F.col("user_id").alias("x"), zero.alias("y"), zero.alias("z"),
                             (1 - hit).alias("miss"), hit.alias("hit"), *[F.lit(None).cast("double").alias(c) for c in "rgb"])
    folder = shared_folder(spark, "map")
    updater = MapUpdater(folder, lambda batch, prior: ob.fold_evidence(batch, prior=prior))
    running = run_map_stream(evidence, updater, folder + "/progress")
    running.awaitTermination()
    last = running.lastProgress["batchId"]
    return updater.read(spark, last).select(F.col("x").alias("user_id"), F.round(F.col("logodds").cast("double"), 5).alias("logodds"))


def _named_blocks(spark, d):
    """The voxel map as blocks on both sides of the origin."""
    return voxel_map(spark, d).select(
        (F.col("x") - 64).alias("x"), (F.col("y") - 20).alias("y"), (F.col("z") * 70 - 100).alias("z"),
        F.concat(F.lit("minecraft:b"), F.col("label")).alias("block"))


@query("region_blocks", f"WITH {VOXELS_SQL} SELECT x - 64 AS x, y - 20 AS y, z * 70 - 100 AS z, 'minecraft:b' || label AS block FROM vox")
def _regions(spark, d):
    return rg.decode_regions(cut(rg.encode_regions(_named_blocks(spark, d))))


@query("region_blocks_old_layout", f"WITH {VOXELS_SQL} SELECT x - 64 AS x, y - 20 AS y, z * 70 - 100 AS z, 'minecraft:b' || label AS block FROM vox")
def _regions_old(spark, d):
    return rg.decode_regions(cut(rg.encode_regions(_named_blocks(spark, d), data_version=2200)))


@query("schematic_blocks", f"""WITH {VOXELS_SQL}
SELECT 's' || x // 50 AS path, x % 50 AS x, y, z, 'minecraft:b' || label AS block FROM vox""")
def _schematics(spark, d):
    rows = voxel_map(spark, d).select(
        F.concat(F.lit("s"), F.expr("x div 50")).alias("path"), F.concat(F.lit("r"), F.col("y") % 2).alias("region"),
        (F.col("x") % 50).alias("x"), "y", "z", F.concat(F.lit("minecraft:b"), F.col("label")).alias("block"))
    return rg.schematic_cells(rg.decode_schematics(cut(rg.encode_schematics(rows))))


@query("count_windows", """
WITH e AS (SELECT user_id, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n FROM events)
SELECT user_id, n // 10 AS win, min(us) AS first, max(us) AS last, count(*) AS frames, round(sum(coalesce(value, 0)), 3) AS sum_value
FROM e GROUP BY user_id, n // 10 HAVING count(*) = 10""")
def _count_windows(spark, d):
    """A result after every tenth event of a user, from four files that arrive one a trigger."""
    from voxhive.streaming.maps import shared_folder
    from voxhive.streaming.snapshots import count_windows

    events = table(spark, d, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"), "value")
    low, high = events.agg(F.min("at"), F.max("at")).first()
    feed, found = shared_folder(spark, "events"), shared_folder(spark, "windows")
    part = F.least(F.floor((F.col("at") - low) * 4 / F.lit(high - low + 1)), F.lit(3))
    for k in range(4):
        events.where(part == k).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    windows = count_windows(stream, "user_id", "at", ("value",), 10)
    running = windows.writeStream.format("parquet").option("path", found).option("checkpointLocation", found + "-progress").outputMode("append").trigger(
        availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(windows.schema).parquet(found).select(
        "user_id", F.col("window").alias("win"), "first", "last", "frames", F.round("sum_value", 3).alias("sum_value"))


@query("scene_exchange", f"WITH {SCENE_SQL.split('up AS (')[0].rstrip().rstrip(',')} SELECT id, layer, label, x, y, z, parent, coalesce(class, -1) AS class, coalesce(voxel_count, -1) AS voxel_count, coalesce(misses, -1) AS misses, coalesce(seen_count, -1) AS seen_count, seq FROM node")
def _scene_exchange(spark, d):
    """The scene graph written as exchange documents of one subtree each, and read back."""
    from voxhive.streaming.maps import shared_folder

    folder = shared_folder(spark, "scene")
    ex.write_scene_graph(scene_nodes(spark, d), folder, id_counter=7, per_document=2000)
    counts = [F.coalesce(c, F.lit(-1).cast("bigint")).alias(c) for c in ("class", "voxel_count", "misses", "seen_count")]
    return ex.read_scene_graph(spark, folder).select("id", "layer", "label", *XYZ, "parent", *counts, "seq")


@query("overlay_exchange", """SELECT l_orderkey * 8 + l_linenumber AS seq, l_partkey // 4 AS x, CAST(l_quantity AS BIGINT) AS y, CAST(round(l_tax * 100) AS BIGINT) AS z,
  CASE l_suppkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'replace' END AS op, CAST(l_suppkey % 20 AS INTEGER) AS sem, 'rule ' || l_linenumber AS generator,
  CASE WHEN l_returnflag = 'R' THEN 'independent' ELSE 'persistent' END AS binding FROM lineitem""")
def _overlay_exchange(spark, d):
    """Line items as a change log, written with its names in legends, and read back."""
    from voxhive.streaming.maps import shared_folder

    log = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("seq"), F.expr("l_partkey div 4").alias("x"), F.col("l_quantity").cast("bigint").alias("y"),
        F.rint(F.col("l_tax") * 100).cast("bigint").alias("z"), F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'replace' END").alias("op"),
        (F.col("l_suppkey") % 20).cast("int").alias("sem"), F.concat(F.lit("rule "), "l_linenumber").alias("generator"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'independent' ELSE 'persistent' END").alias("binding"))
    folder = shared_folder(spark, "overlay")
    ex.write_overlay(log, folder)
    return ex.read_overlay(spark, folder)
