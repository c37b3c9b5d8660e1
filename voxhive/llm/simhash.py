"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint maps to sixteen bit counts, one per 4-bit segment, packed as
nibbles of one long.  The Manhattan distance of two such points never exceeds the
Hamming distance, so a grid range join over the points finds every pair: of two
points at most three apart, one half (eight segments) is at most one apart, hence
a point probes its own grid cell and the cells one step away in either half.
Candidates pass the Manhattan bound, then the exact bit count.

Only distinct fingerprints are joined; copies stay counted rows.

Edge cases: null and empty texts have no words and the fingerprint zero, linked
like any other; texts of one or two words have one shingle; rows with a null id
take no part in grouping (null component) and are kept; repeated ids of a
surviving document keep one row.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from voxhive.llm.common import set_aside, stage
from voxhive.operators.components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 values of all word shingles, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles, total = (b"%b %b %b" % w for w in zip(words, words[1:], words[2:])), len(words) - 2
    votes = np.zeros(64, np.int64)
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in shingles)
    while len(block := np.fromiter(islice(hashes, BLOCK), np.uint64)):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def grid_point(fp: Column) -> Column:
    """Bit counts of the sixteen 4-bit segments, one nibble each."""
    ones = F.lit(0x1111111111111111)
    total = fp.bitwiseAND(ones)
    for shift in (1, 2, 3):
        total = total + F.shiftrightunsigned(fp, shift).bitwiseAND(ones)
    return total


def _manhattan(a: str, b: str) -> Column:
    nibble = lambda c, i: F.shiftrightunsigned(F.col(c), 4 * i).bitwiseAND(15)
    total = F.abs(nibble(a, 0) - nibble(b, 0))
    for i in range(1, 16):
        total = total + F.abs(nibble(a, i) - nibble(b, i))
    return total


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) for every two of the distinct ``fp`` that differ in at most three bits, src < dst."""
    points = fps.select("fp", grid_point(F.col("fp")).alias("point"))
    halves = lambda: points.select(
        "fp", "point", F.posexplode(F.array(
            F.col("point").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("point", 32),
        )).alias("half", "cell"),
    )
    steps = [0] + [s << (4 * i) for i in range(8) for s in (1, -1)]
    probes = halves().select(
        F.col("fp").alias("src"), F.col("point").alias("src_point"), F.col("half").alias("src_half"),
        F.explode(F.array(*[F.col("cell") + F.lit(s) for s in steps])).alias("probe"),
    )
    homes = halves().select(F.col("fp").alias("dst"), F.col("point").alias("dst_point"), "half", "cell")
    return probes.join(
        homes,
        (F.col("probe") == F.col("cell")) & (F.col("src_half") == F.col("half")) & (F.col("src") < F.col("dst"))
        & (_manhattan("src_point", "dst_point") <= DISTANCE)
        & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= DISTANCE),
    ).select("src", "dst")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) per row; component_id is the smallest key reachable over links."""
    rows = stage(docs.select(F.col(key).alias("key"), fingerprint_udf(F.col(text)).alias("fp")), "fingerprints")
    classes = stage(rows.where("key is not null").groupBy("fp").agg(F.min("key").alias("low")), "classes")
    found = stage(connected_components(links(classes), "src", "dst", tail_edges=0), "components")
    grouped = classes.join(found, F.col("fp") == F.col("node"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("lowest"))
    moved = grouped.join(lowest, "component").select(F.col("fp").alias("linked_fp"), "lowest")
    # a table of its own, so that adaptive execution may split the join of a fingerprint that many rows share
    label = stage(classes.join(moved, F.col("fp") == F.col("linked_fp"), "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("lowest", "low").alias("component_id")
    ), "labels")
    return rows.join(label, (F.col("fp") == F.col("class_fp")) & F.col("key").isNotNull(), "left").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns."""
    groups = near_duplicates(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("kept")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rows, columns = set_aside(docs, "doc_id")
    met = rows.join(stage(kept, "kept"), F.col("doc_id") == F.col("kept"))
    once = met.where("n = 1").select(*columns)
    repeated = met.where("n > 1").dropDuplicates(["doc_id"]).select(*columns)
    return once.union(repeated).union(rows.where("doc_id is null").select(*columns))
