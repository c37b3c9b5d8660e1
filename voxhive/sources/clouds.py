"""Point clouds, trajectories, observation maps, meshes and recorded frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxhive.functions.geometry import quat_normalised
from voxhive.operators.observation import OBS_SCHEMA
from voxhive.operators.voxels import XYZ

# PCD scalar types.
_PCD = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4"}


def parse_pcd(raw: bytes) -> np.ndarray:
    """x, y, z of an ASCII or binary point cloud file."""
    head, fields = {}, 0
    while "DATA" not in head:
        end = raw.index(b"\n", fields)
        line = raw[fields:end].decode("ascii", "replace").split()
        fields = end + 1
        if line and not line[0].startswith("#"):
            head[line[0]] = line[1:]
    names, counts = head["FIELDS"], [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    if not {"x", "y", "z"} <= set(names):
        raise ValueError("point cloud needs x, y and z")
    if head["DATA"][0] == "ascii":
        flat = pd.DataFrame([row.split() for row in raw[fields:].decode().splitlines() if row.strip()])
        start = {n: sum(counts[:i]) for i, n in enumerate(names)}
        return np.stack([flat[start[a]].astype(float).to_numpy() for a in XYZ], axis=1)
    if head["DATA"][0] != "binary":
        raise ValueError(f"unsupported point cloud encoding {head['DATA'][0]}")
    kind = [(n, _PCD[t, int(s)], (c,) if c > 1 else ()) for n, t, s, c in zip(names, head["TYPE"], head["SIZE"], counts)]
    table = np.frombuffer(raw, dtype=kind, count=int(head["POINTS"][0]), offset=fields)
    return np.stack([table[a].astype(float) for a in XYZ], axis=1)


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """Points of one or many cloud files, one task per file: file, x, y, z."""

    def run(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                out = pd.DataFrame(parse_pcd(bytes(raw)), columns=XYZ)
                out.insert(0, "file", name)
                yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, schema="file string, x double, y double, z double")


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace text ``stamp tx ty tz qx qy qz qw``; comments and short lines skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#")).select(parts.alias("p")).where(F.size("p") >= 8)
    num = [F.col("p").getItem(i).cast("double").alias(n) for i, n in enumerate(("stamp", "px", "py", "pz", "qx", "qy", "qz", "qw"))]
    raw = rows.select(*num)
    return raw.select("stamp", "px", "py", "pz", *[q.alias(n) for q, n in zip(quat_normalised("qx", "qy", "qz", "qw"), ("qx", "qy", "qz", "qw"))])


def save_observation(obs: DataFrame, path: str) -> None:
    """Keep a map as a table partitioned by region, so box reads skip files."""
    obs.withColumn("region", F.floor(F.col("x") / 256)).write.mode("overwrite").partitionBy("region").parquet(path)


def load_observation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBS_SCHEMA + ", region bigint").parquet(path).drop("region")


def mesh_cells(triangles: DataFrame, voxel_size: float) -> DataFrame:
    """Surface cells of a triangle table (ax..cz), by sampling below half a cell.

    Each triangle is walked on a barycentric lattice fine enough that no crossed
    cell is skipped by more than the sampling step.
    """
    side = lambda p, q: F.sqrt(sum(((F.col(f"{p}{a}") - F.col(f"{q}{a}")) ** 2 for a in "yz"), (F.col(f"{p}x") - F.col(f"{q}x")) ** 2))
    longest = F.greatest(side("a", "b"), side("b", "c"), side("a", "c"))
    n = F.greatest(F.lit(1), F.ceil(longest / F.lit(voxel_size / 2.0))).cast("int")
    rows = triangles.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("i"))))
    u, v = F.col("i") / F.col("n"), F.col("j") / F.col("n")
    at = [F.floor((F.col(f"a{a}") * (1 - u - v) + F.col(f"b{a}") * u + F.col(f"c{a}") * v) / F.lit(voxel_size)).cast("bigint").alias(a) for a in XYZ]
    return rows.select(*at).distinct()
