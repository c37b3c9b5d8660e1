"""How the mapping tables are read out of the given relational tables.

Each binding exists twice: as a DataFrame and as the SQL fragment that the
cross-check uses. Coordinates grow with the part and customer keys, so the maps
keep their density while their extent follows the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxhive.operators.voxels import count_then_vote


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LABEL_SQL = (
    "CASE l_returnflag WHEN 'A' THEN CASE l_linestatus WHEN 'F' THEN 3 ELSE 5 END "
    "WHEN 'N' THEN 16 ELSE 19 END"
)


def labelled_points(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as labelled lattice points: part, quantity and tax are the axes."""
    return table(spark, folder, "lineitem").select(
        F.expr("l_partkey div 4").alias("x"), F.col("l_quantity").cast("bigint").alias("y"),
        F.rint(F.col("l_tax") * 100).cast("bigint").alias("z"), F.expr(LABEL_SQL).alias("label"),
        F.col("l_orderkey").alias("frame"),
    )


POINTS_SQL = f"""pts AS (
  SELECT l_partkey // 4 AS x, CAST(l_quantity AS BIGINT) AS y, CAST(round(l_tax * 100) AS BIGINT) AS z,
         {LABEL_SQL} AS label, l_orderkey AS frame FROM lineitem)"""


def voxel_map(spark: SparkSession, folder: str) -> DataFrame:
    """Majority label per lattice cell."""
    return count_then_vote(labelled_points(spark, folder), "frame")


VOXELS_SQL = POINTS_SQL + """,
votes AS (SELECT DISTINCT frame, x, y, z, label FROM pts),
tally AS (SELECT x, y, z, label, count(*) AS n FROM votes GROUP BY ALL),
vox AS MATERIALIZED (SELECT x, y, z, arg_max(label, (n, -label)) AS label, CAST(sum(n) AS BIGINT) AS total
        FROM tally GROUP BY x, y, z)"""


def placed_models(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as objects among the lattice points, in cells of half a metre; one in ten hangs on a wall, one from a ceiling."""
    key, size = F.col("p_partkey"), F.col("p_size")
    eighth = lambda c: c / F.lit(8.0)
    return table(spark, folder, "part").select(
        key.alias("id"), eighth(F.expr("p_partkey div 4") * 4 + size % 5).alias("pos_x"), eighth(size * 4 + key % 3).alias("pos_y"),
        eighth((key % 9) * 4 + size % 3).alias("pos_z"), eighth(size % 7 + 2).alias("dim_x"), eighth(key % 6 + 2).alias("dim_y"),
        eighth(key % 5 + 2).alias("dim_z"), F.expr("CASE p_partkey % 10 WHEN 0 THEN 'wall' WHEN 1 THEN 'ceiling' ELSE 'floor' END").alias("mount"),
    )


MODELS_SQL = """model AS (SELECT p_partkey AS id, ((p_partkey // 4) * 4 + p_size % 5) / 8.0::DOUBLE AS pos_x, (p_size * 4 + p_partkey % 3) / 8.0::DOUBLE AS pos_y,
  ((p_partkey % 9) * 4 + p_size % 3) / 8.0::DOUBLE AS pos_z, (p_size % 7 + 2) / 16.0::DOUBLE AS half_x, (p_partkey % 6 + 2) / 16.0::DOUBLE AS half_y,
  (p_partkey % 5 + 2) / 16.0::DOUBLE AS half_z, CASE p_partkey % 10 WHEN 0 THEN 'wall' WHEN 1 THEN 'ceiling' ELSE 'floor' END AS mount FROM part)"""


def sensor_points(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as range measurements: one sensor per 64 parts, one frame per month."""
    block = F.expr("l_partkey div 64")
    return table(spark, folder, "lineitem").select(
        ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("bigint").alias("frame_seq"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003 + F.col("l_suppkey")).alias("row_seq"),
        (block * 16 + F.lit(8.0)).alias("ox"), F.lit(25.5).alias("oy"), F.lit(4.5).alias("oz"),
        (F.expr("l_partkey div 4") + F.lit(0.5)).alias("px"), (F.col("l_quantity") + F.lit(0.5)).alias("py"),
        (F.rint(F.col("l_tax") * 100) + F.lit(0.5)).alias("pz"),
        F.expr(f"CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE {LABEL_SQL} END").alias("label"),
        (F.floor("l_extendedprice").cast("bigint") % 256).cast("int").alias("r"),
        (F.col("l_suppkey") % 256).cast("int").alias("g"), (F.col("l_orderkey") % 256).cast("int").alias("b"),
    )


SENSOR_SQL = """shots AS (
  SELECT (year(l_shipdate) - 1992) * 12 + month(l_shipdate) AS f,
         (l_orderkey * 8 + l_linenumber) * 1000003 + l_suppkey AS q,
         (l_partkey // 64) * 16 + 8.0::DOUBLE AS ox, 25.5::DOUBLE AS oy, 4.5::DOUBLE AS oz,
         (l_partkey // 4) + 0.5::DOUBLE AS px, l_quantity + 0.5::DOUBLE AS py,
         round(l_tax * 100) + 0.5::DOUBLE AS pz,
         CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE @LABEL END AS label,
         CAST(floor(l_extendedprice) AS BIGINT) % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b
  FROM lineitem),
rays AS (SELECT *, sqrt((px-ox)*(px-ox) + (py-oy)*(py-oy) + (pz-oz)*(pz-oz)) AS len FROM shots),
crossed AS (
  SELECT f, CAST(floor(ox + s * 1.0::DOUBLE * ((px-ox)/len)) AS BIGINT) AS x,
         CAST(floor(oy + s * 1.0::DOUBLE * ((py-oy)/len)) AS BIGINT) AS y,
         CAST(floor(oz + s * 1.0::DOUBLE * ((pz-oz)/len)) AS BIGINT) AS z
  FROM (SELECT *, unnest(range(0, CAST(ceil(len - 0.1::DOUBLE) AS BIGINT) + 1)) AS s FROM rays
        WHERE len > 0.1::DOUBLE)
  WHERE s * 1.0::DOUBLE < len - 0.1::DOUBLE),
ends AS (SELECT f, q, CAST(floor(px) AS BIGINT) AS x, CAST(floor(py) AS BIGINT) AS y,
                CAST(floor(pz) AS BIGINT) AS z, label, r, g, b FROM rays WHERE len > 0.1::DOUBLE),
touch AS (
  SELECT f, x, y, z, max(m) AS m, max(h) AS h FROM (
    SELECT f, x, y, z, 1 AS m, 0 AS h FROM crossed UNION ALL SELECT f, x, y, z, 0, 1 FROM ends)
  GROUP BY f, x, y, z),
odds AS (
  SELECT x, y, z, list_reduce(list({'m': m, 'h': h, 'v': 0::FLOAT} ORDER BY f),
    lambda a, e: {'m': 0, 'h': 0, 'v': least(3.5::FLOAT, greatest((-2)::FLOAT,
      (a.v + CASE WHEN e.m = 1 THEN (-0.4)::FLOAT ELSE 0::FLOAT END)
      + CASE WHEN e.h = 1 THEN 0.85::FLOAT ELSE 0::FLOAT END))},
    {'m': 0, 'h': 0, 'v': 0::FLOAT}).v AS logodds
  FROM touch GROUP BY x, y, z),
majority AS (
  SELECT x, y, z, list_reduce(list({'l': label, 'c': 0} ORDER BY f, q, label),
    lambda a, e: CASE WHEN a.l = e.l THEN {'l': a.l, 'c': least(65535, a.c + 1)}
                      WHEN a.c = 0 THEN {'l': e.l, 'c': 1} ELSE {'l': a.l, 'c': a.c - 1} END,
    {'l': 0, 'c': 0}) AS s
  FROM ends WHERE label <> 0 GROUP BY x, y, z),
shade AS (SELECT f, x, y, z, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM ends GROUP BY f, x, y, z),
colour AS (
  SELECT x, y, z, list_reduce(list({'r': r, 'g': g, 'b': b, 'n': 0::DOUBLE} ORDER BY f),
    lambda a, e: {'r': round_even(a.r + (e.r - a.r) / (a.n + 1), 0), 'g': round_even(a.g + (e.g - a.g) / (a.n + 1), 0),
                  'b': round_even(a.b + (e.b - a.b) / (a.n + 1), 0), 'n': least(255, a.n + 1)::DOUBLE},
    {'r': 0::DOUBLE, 'g': 0::DOUBLE, 'b': 0::DOUBLE, 'n': 0::DOUBLE}) AS s
  FROM shade GROUP BY x, y, z),
obs AS (
  SELECT o.x, o.y, o.z, o.logodds, coalesce(m.s.l, 0) AS sem_label, coalesce(m.s.c, 0) AS sem_count,
         CAST(coalesce(c.s.r, 0) AS INTEGER) AS r, CAST(coalesce(c.s.g, 0) AS INTEGER) AS g,
         CAST(coalesce(c.s.b, 0) AS INTEGER) AS b, CAST(coalesce(c.s.n, 0) AS INTEGER) AS rgb_count
  FROM odds o LEFT JOIN majority m USING (x, y, z) LEFT JOIN colour c USING (x, y, z))""".replace("@LABEL", LABEL_SQL)


def scene_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations, customers and orders as building, rooms, places and objects.

    An order with status P rests on the customer's previous order.
    """
    from pyspark.sql import Window

    region = table(spark, folder, "region")
    nation = table(spark, folder, "nation")
    customer = table(spark, folder, "customer")
    orders = table(spark, folder, "orders")
    none = lambda t: F.lit(None).cast(t)
    extra = {"class": none("bigint"), "voxel_count": none("bigint"), "misses": none("bigint"), "seen_count": none("bigint")}
    zero = F.lit(0.0)
    building = region.select(
        F.col("r_regionkey").cast("bigint").alias("seq"), F.concat(F.lit("building:"), "r_regionkey").alias("id"),
        F.lit("building").alias("layer"), F.col("r_name").alias("label"), zero.alias("x"), zero.alias("y"), zero.alias("z"),
        none("string").alias("parent")).withColumns(extra)
    room = nation.select(
        (F.lit(1000) + F.col("n_nationkey")).cast("bigint").alias("seq"), F.concat(F.lit("room:"), "n_nationkey").alias("id"),
        F.lit("room").alias("layer"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("double").alias("x"),
        zero.alias("y"), zero.alias("z"), F.concat(F.lit("building:"), "n_regionkey").alias("parent")).withColumns(extra)
    place = customer.select(
        (F.lit(10000) + F.col("c_custkey")).alias("seq"), F.concat(F.lit("place:"), "c_custkey").alias("id"),
        F.lit("place").alias("layer"), F.col("c_name").alias("label"), (F.col("c_custkey") % 100).cast("double").alias("x"),
        F.expr("c_custkey div 100").cast("double").alias("y"), zero.alias("z"),
        F.concat(F.lit("room:"), "c_nationkey").alias("parent")).withColumns(extra)
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    home = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    thing = orders.withColumn("prev", before).join(home, "o_custkey").select(
        (F.lit(1 << 40) + F.col("o_orderkey")).alias("seq"), F.concat(F.lit("object:"), "o_orderkey").alias("id"),
        F.lit("object").alias("layer"), F.lower("o_orderpriority").alias("label"),
        (F.col("o_custkey") % 100).cast("double").alias("x"), F.expr("o_custkey div 100").cast("double").alias("y"),
        F.floor(F.col("o_totalprice") / 100000.0).cast("double").alias("z"),
        F.when((F.col("o_orderstatus") == "P") & F.col("prev").isNotNull(), F.concat(F.lit("object:"), "prev"))
        .otherwise(F.concat(F.lit("room:"), "c_nationkey")).alias("parent"),
        F.ascii("o_orderpriority").cast("bigint").alias("class"), F.floor("o_totalprice").cast("bigint").alias("voxel_count"),
        F.lit(0).cast("bigint").alias("misses"), (F.lit(1) + F.col("o_orderkey") % 4).alias("seen_count"))
    return building.union(room).union(place).union(thing)


SCENE_SQL = """prev AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
node AS (
  SELECT CAST(r_regionkey AS BIGINT) AS seq, 'building:' || r_regionkey AS id, 'building' AS layer, r_name AS label,
         0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, NULL::VARCHAR AS parent, NULL::BIGINT AS class,
         NULL::BIGINT AS voxel_count, NULL::BIGINT AS misses, NULL::BIGINT AS seen_count FROM region
  UNION ALL SELECT 1000 + n_nationkey, 'room:' || n_nationkey, 'room', n_name, n_nationkey, 0, 0, 'building:' || n_regionkey,
         NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 10000 + c_custkey, 'place:' || c_custkey, 'place', c_name, c_custkey % 100, c_custkey // 100, 0,
         'room:' || c_nationkey, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 1099511627776 + o_orderkey, 'object:' || o_orderkey, 'object', lower(o_orderpriority), o_custkey % 100,
         o_custkey // 100, floor(o_totalprice / 100000.0::DOUBLE),
         CASE WHEN o_orderstatus = 'P' AND before IS NOT NULL THEN 'object:' || before ELSE 'room:' || c_nationkey END,
         ascii(o_orderpriority), CAST(floor(o_totalprice) AS BIGINT), 0, 1 + o_orderkey % 4
  FROM prev JOIN customer ON c_custkey = o_custkey),
up AS (
  SELECT id, id AS spot, layer AS spot_layer, parent AS next FROM node
  UNION ALL SELECT up.id, n.id, n.layer, n.parent FROM up JOIN node n ON n.id = up.next),
roomed AS (SELECT n.id, r.spot AS room FROM node n LEFT JOIN (SELECT id, spot FROM up WHERE spot_layer = 'room') r USING (id))"""
