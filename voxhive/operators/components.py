"""Connected components of an edge table (alternating large-star / small-star).

The two star steps follow Kiveris et al., "Connected Components in MapReduce and
Beyond" (2014). Minima are map-side combined, so a hub vertex costs one partial
row per task; the joins back are ordinary equi-joins that adaptive execution can
split when a hub is hot.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxhive.operators.blocks import min_label
from voxhive.session import by_sorting, cut

MAX_ROUNDS = 100
# Once the contracted edge table is this small (two node ids per row), the last
# rounds run as one bounded task; above it the star rounds stay distributed.
TAIL_EDGES = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("hi", "lo").union(edges.select(F.col("lo"), F.col("hi")))
    both = both.toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("mu"), F.least("u", "m").alias("m")
    )
    return (
        both.where("v > u")
        .join(by_sorting(low), F.col("u") == F.col("mu"))
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "mu")
    relinked = (
        edges.join(by_sorting(low), F.col("hi") == F.col("mu"))
        .where("lo > m")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    )
    return relinked.union(low.select(F.col("mu").alias("hi"), F.col("m").alias("lo"))).distinct()


def _measure(edges: DataFrame) -> tuple[int, int]:
    """Edge count and order-free hash: equal twice in a row means converged."""
    hashed = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(hashed).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _finish(edges: DataFrame) -> DataFrame:
    """Solve a size-checked remainder in one task."""
    kind = edges.schema["hi"].dataType
    names = kind.names if kind.typeName() == "struct" else None
    if names:
        flat = edges.select(*[F.col(f"{side}.{n}").alias(f"{side}_{n}") for side in ("hi", "lo") for n in names])
        fields = [f"{n} {kind[n].dataType.simpleString()}" for n in names]
    else:
        names = ["k"]
        flat = edges.select(F.col("hi").alias("hi_k"), F.col("lo").alias("lo_k"))
        fields = [f"k {kind.simpleString()}"]
    schema = ", ".join([f"n_{f}" for f in fields] + [f"c_{f}" for f in fields])

    def solve(batches):
        frames = list(batches)
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True)
        sides = [pdf[[f"{s}_{n}" for n in names]].set_axis(names, axis=1) for s in ("hi", "lo")]
        nodes = pd.concat(sides, ignore_index=True)
        code = nodes.groupby(names, sort=True, dropna=False).ngroup().to_numpy()
        uniq = nodes.assign(_c=code).drop_duplicates("_c").sort_values("_c")[names].reset_index(drop=True)
        half = len(pdf)
        root = min_label(len(uniq), code[:half], code[half:])
        head = uniq.iloc[root].reset_index(drop=True)
        yield pd.concat([uniq.add_prefix("n_"), head.add_prefix("c_")], axis=1)

    out = flat.coalesce(1).mapInPandas(solve, schema=schema)
    if kind.typeName() != "struct":
        return out.select(F.col("n_k").alias("node"), F.col("c_k").alias("component"))
    return out.select(
        F.struct(*[F.col(f"n_{n}").alias(n) for n in names]).alias("node"),
        F.struct(*[F.col(f"c_{n}").alias(n) for n in names]).alias("component"),
    )


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", tail_edges: int = TAIL_EDGES
) -> DataFrame:
    """(node, component) for every node that has an edge; component = smallest node.

    Node columns may be of any orderable type, structs included.
    """
    up = F.col(src) > F.col(dst)
    pairs = edges.where(F.col(src) != F.col(dst)).select(
        F.when(up, F.col(src)).otherwise(F.col(dst)).alias("hi"),
        F.when(up, F.col(dst)).otherwise(F.col(src)).alias("lo"),
    )
    state = cut(pairs.distinct())
    seen = _measure(state)
    if seen[0] > tail_edges and state.schema["hi"].dataType.typeName() != "long":
        return _by_number(state, tail_edges)
    for _ in range(MAX_ROUNDS):
        if seen[0] <= tail_edges:
            return _finish(state)
        state = cut(_small_star(_large_star(state)))
        now = _measure(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("component search did not converge")
    members = state.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = state.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.union(roots)


def _by_number(edges: DataFrame, tail_edges: int) -> DataFrame:
    """The same for nodes of other types: consecutive numbers in node order stand for them in the rounds.

    Numbers are a third of a cell's size, and their minima are taken while hashing, those of structs after a sort.
    """
    from voxhive.operators.cluster import number_groups

    ends = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct()
    names = cut(number_groups(ends, ["node"], "n"))
    end = lambda side: by_sorting(names.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}")))
    numbered = edges.join(end("hi"), "hi").join(end("lo"), "lo").select("n_hi", "n_lo")
    found = connected_components(numbered, "n_hi", "n_lo", tail_edges)
    of = by_sorting(names.select(F.col("n").alias("component"), F.col("node").alias("first")))
    return (
        found.join(of, "component").join(by_sorting(names.select("n", F.col("node").alias("of"))), F.col("node") == F.col("n"))
        .select(F.col("of").alias("node"), F.col("first").alias("component"))
    )


def with_component(
    nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst",
    out: str = "component",
) -> DataFrame:
    """Attach a component to every node; nodes without edges are their own."""
    found = connected_components(edges, src, dst).withColumnRenamed("component", out)
    return (
        nodes.join(found, F.col(node) == F.col("node"), "left")
        .drop("node")
        .withColumn(out, F.coalesce(out, node))
    )
