"""K-d tree sharding in DataFrame operations only.

Documents of equal text form one unit with the metadata of its smallest row; a
unit heavier than a two-hundredth of a shard is dealt into slices.  A node of the
tree is cut at the exact weighted median of its widest metadata dimension, found by
distributed running totals, until the leaves hold the target bytes.

Law ``bytes``: the leaves' sizes are near equal.  Edge cases: a null text weighs 1
byte and differs from an empty one; null metadata counts as 0; ties in a dimension
fall to the text's hash, then the slice; repeated rows take slots of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from voxhive.llm.common import running_total, stage

SLICES_PER_SHARD = 200
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")


def string_code(value: Column) -> Column:
    """Number that orders like the first seven bytes of a string; 0 for null."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(value, 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(0))


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(text).alias("digest"), string_code(F.col("source")).alias("d_source"),
        string_code(F.col("lang")).alias("d_lang"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("d_id"),
    )


def units(rows: DataFrame, heaviest: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their unit key, and one row per unit.

    Only texts heavier than ``heaviest`` in all are sliced; at most total / heaviest
    texts are, so their table may be broadcast.
    """
    key = ["digest", "text_crc32", "size"]
    heavy = rows.groupBy(*key).agg(F.sum("size").alias("weight")).where(F.col("weight") > heaviest).select(
        *[F.col(k).alias(f"h_{k}") for k in key], F.ceil(F.col("weight") / heaviest).alias("slices")
    )
    same = [F.col(k) == F.col(f"h_{k}") for k in key]
    salted = rows.join(F.broadcast(heavy), same, "left").withColumn(
        "slice", F.when(F.col("slices").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("slices"))).cast("long")
    ).drop("slices", *[f"h_{k}" for k in key])
    first = F.min(F.struct("d_id", "d_source", "d_lang")).alias("m")
    grouped = salted.groupBy(*key, "slice").agg(F.sum("size").alias("weight"), first)
    return salted, grouped.select(*key, "slice", "weight", F.col("size").alias("d_size"), "m.*")


def split(nodes: DataFrame, ranges: dict[str, float]) -> DataFrame:
    """Cut every node at the weighted median of its widest dimension; ``node`` becomes 2 * node or 2 * node + 1."""
    spread = [F.lit(0.0) if not ranges[d] else (F.max(d) - F.min(d)) / F.lit(ranges[d]) for d in DIMENSIONS]
    widest = nodes.groupBy("node").agg(F.array(*spread).alias("w"), F.sum("weight").alias("whole")).select(
        F.col("node").alias("of"), F.array_position("w", F.array_max("w")).cast("int").alias("axis"), "whole"
    )
    value = F.element_at(F.array(*DIMENSIONS), F.col("axis"))
    chosen = nodes.join(F.broadcast(widest), F.col("node") == F.col("of")).withColumn("value", value)
    placed = running_total(chosen, "node", ["value", "digest", "text_crc32", "size", "slice"], "weight", "before")
    right = (2 * F.col("before") + F.col("weight") > F.col("whole")).cast("long")
    return placed.withColumn("node", 2 * F.col("node") + right).drop("of", "axis", "whole", "value", "before")


def shards(docs: DataFrame, count: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document.

    Give the number of shards (a power of two) or the bytes a leaf should hold.
    """
    rows = stage(described(docs), "described")
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = target_bytes or max(1, math.ceil(total / count))
    levels = max(0, math.ceil(math.log2(max(1, math.ceil(total / target)))))
    salted, nodes = units(rows, max(1.0, target / SLICES_PER_SHARD))
    nodes = stage(nodes.withColumn("node", F.lit(0).cast("long")), "units")
    seen = nodes.agg(*[(F.max(d).cast("double") - F.min(d)).alias(d) for d in DIMENSIONS]).first().asDict()
    for _ in range(levels):
        nodes = split(nodes, seen)
    key = ["digest", "text_crc32", "size", "slice"]
    leaf = nodes.select(*[F.col(k).alias(f"u_{k}") for k in key], F.col("node").alias("shard"))
    met = salted.join(leaf, [F.col(k) == F.col(f"u_{k}") for k in key]).withColumn("one", F.lit(1))
    placed = running_total(met.select("doc_id", "size", "text_crc32", "digest", "shard", "one"), "shard",
                           ["doc_id", "digest"], "one", "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
