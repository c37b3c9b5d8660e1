"""Pose lookup, topic synchronisation and transform chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxhive.functions.geometry import lerp, slerp
from voxhive.session import cut

POSE = ["px", "py", "pz", "qx", "qy", "qz", "qw"]


def bracket_poses(queries: DataFrame, poses: DataFrame, stamp: str = "stamp") -> DataFrame:
    """Rows around each query time: columns ``a_*`` (at or before) and ``b_*`` (after).

    Both tables are sorted together by range partitioning. Only the first and the
    last pose of every partition travel further, so there is no global window.
    """
    keep = [c for c in queries.columns if c != stamp]
    pose = F.struct(F.col(stamp).alias("t"), *POSE)
    both = poses.select(
        F.col(stamp).alias("t"), F.lit(0).alias("kind"), pose.alias("pose"),
        *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in keep],
    ).union(queries.select(
        F.col(stamp), F.lit(1), F.lit(None).cast(poses.select(pose.alias("p")).schema["p"].dataType), *keep))
    ranged = cut(both.repartitionByRange("t", "kind").withColumn("pid", F.spark_partition_id()))
    edge = ranged.where("kind = 0").groupBy("pid").agg(
        F.min_by("pose", "t").alias("first"), F.max_by("pose", "t").alias("last"))
    parts = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("_n")).join(edge, "pid", "left")
    # one row per partition
    up = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("pid")).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("pid", F.last("last", True).over(up).alias("carry_a"), F.last("first", True).over(down).alias("carry_b"))
    # the next pose is the last one seen in reverse order: frames that end at the
    # current row stream, frames that start there would rescan the partition
    ahead = Window.partitionBy("pid").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("pid").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("a", F.last("pose", True).over(ahead)).withColumn("b", F.last("pose", True).over(behind))
    found = near.where("kind = 1").join(F.broadcast(carry), "pid")
    return found.select(
        F.col("t").alias(stamp), *keep,
        F.coalesce("a", "carry_a").alias("a"), F.coalesce("b", "carry_b").alias("b"),
    )


def interpolate_poses(queries: DataFrame, poses: DataFrame, stamp: str = "stamp") -> DataFrame:
    """Pose at each query time; NULL outside the trajectory.

    The last pose itself answers a query at exactly the final time.
    """
    near = bracket_poses(queries, poses, stamp)
    a, b = F.col("a"), F.coalesce(F.col("b"), F.when(F.col("a.t") == F.col(stamp), F.col("a")))
    near = near.withColumn("b2", b)
    dt = F.col("b2.t") - F.col("a.t")
    u = F.when(dt <= 0, F.lit(0.0)).otherwise((F.col(stamp) - F.col("a.t")) / dt)
    known = F.col("a").isNotNull() & F.col("b2").isNotNull()
    quats = [[F.col(f"{s}.{q}") for q in POSE[3:]] for s in ("a", "b2")]
    turned = slerp(quats[0], quats[1], u)
    cols = [F.when(known, lerp(F.col(f"a.{p}"), F.col(f"b2.{p}"), u)).alias(p) for p in POSE[:3]]
    cols += [F.when(known, t).alias(q) for t, q in zip(turned, POSE[3:])]
    kept = [c for c in queries.columns]
    return near.select(*kept, *cols)


def synchronise(left: DataFrame, right: DataFrame, slop: float, stamp: str = "stamp") -> DataFrame:
    """Pairs of messages at most ``slop`` seconds apart.

    Time is bucketed by the slop and the right side is repeated into its two
    neighbours, which makes the interval join an equi-join.
    """
    bucket = lambda c: F.floor(c / F.lit(slop)).cast("bigint")
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("bucket", bucket(F.col(f"l_{stamp}")))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.withColumn("bucket", F.explode(F.array(*[bucket(F.col(f"r_{stamp}")) + d for d in (-1, 0, 1)])))
    return l.join(r, "bucket").where(F.abs(F.col(f"l_{stamp}") - F.col(f"r_{stamp}")) <= slop).drop("bucket")


def nearest_in_time(left: DataFrame, right: DataFrame, slop: float, key: str, stamp: str = "stamp") -> DataFrame:
    """One partner per left message: the closest in time, then the earliest."""
    pairs = synchronise(left, right, slop, stamp)
    gap = F.abs(F.col(f"l_{stamp}") - F.col(f"r_{stamp}"))
    best = F.min_by(F.struct(*[c for c in pairs.columns if c.startswith("r_")]), F.struct(gap, f"r_{stamp}", f"r_{key}"))
    return pairs.groupBy(*[c for c in pairs.columns if c.startswith("l_")]).agg(best.alias("r")).select(
        *[c for c in pairs.columns if c.startswith("l_")], "r.*")


# ---------------------------------------------------------------- transform tree
def _matmul(a: Column, b: Column) -> Column:
    """Product of two 4x4 matrices held as 16-element row-major arrays."""
    return F.array(*[
        sum((F.get(a, F.lit(4 * i + k)) * F.get(b, F.lit(4 * k + j)) for k in range(1, 4)),
            F.get(a, F.lit(4 * i)) * F.get(b, F.lit(j)))
        for i in range(4) for j in range(4)
    ])


def rigid_inverse(m: Column) -> Column:
    """Inverse of a rigid transform: transpose the rotation, rotate back the shift."""
    at = lambda i, j: F.get(m, F.lit(4 * i + j))
    rows = []
    for i in range(3):
        rows += [at(j, i) for j in range(3)]
        rows.append(-(at(0, i) * at(0, 3) + at(1, i) * at(1, 3) + at(2, i) * at(2, 3)))
    return F.array(*rows, *[F.lit(float(v)) for v in (0, 0, 0, 1)])


def chain_transforms(edges: DataFrame, pairs: DataFrame, depth: int = 4) -> DataFrame:
    """Compose static transforms from ``parent`` to ``child`` over up to ``depth`` hops.

    ``edges``: parent, child, m (16 doubles). Edges work both ways; a pair takes
    its shortest chain. Each hop is one join of the frontier with the edges, and
    frames already reached for the same start are dropped.
    """
    both = cut(edges.select("parent", "child", "m").union(
        edges.select(F.col("child"), F.col("parent"), rigid_inverse(F.col("m")))))
    eye = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    reached = pairs.select(F.col("parent").alias("start")).distinct().select(
        "start", F.col("start").alias("frame"), eye.alias("m"), F.lit(0).alias("hops"))
    reached = cut(reached)
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.select("start", F.col("frame").alias("parent"), F.col("m").alias("m0")).join(both, "parent")
        fresh = step.groupBy("start", F.col("child").alias("frame")).agg(
            F.min_by(_matmul(F.col("m0"), F.col("m")), "parent").alias("m"))
        frontier = cut(fresh.join(reached.select("start", "frame"), ["start", "frame"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    found = reached.select(F.col("start").alias("parent"), F.col("frame").alias("child"), "m", "hops")
    return pairs.join(found, ["parent", "child"], "left")
