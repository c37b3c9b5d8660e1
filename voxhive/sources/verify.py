"""Round-trip verification of exported worlds: an order-free fingerprint per chunk, before writing and after reading."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxhive.functions.cells import floor_div
from voxhive.operators.voxels import CHUNK, XYZ
from voxhive.sources.worlds import CELL, VOXELS, WorldCorruptError, WorldFormatError, WorldVersionError, chunk_files, decode_chunk

PRINT = ["cells", "high", "low"]
#: Chunks that an error message names; the report itself is whole.
NAMED = 5


def _print(voxels: DataFrame) -> DataFrame:
    """Rows with the two halves of the hash of a cell and its values; null where the row is no cell."""
    cell = F.xxhash64(*[F.col(a).cast("bigint") for a in XYZ], *[F.col(c).cast("int") for c in CELL])
    hashed = F.when(F.col("x").isNotNull(), cell)
    return voxels.withColumns({"_high": F.shiftrightunsigned(hashed, 32), "_low": hashed.bitwiseAND(F.lit(0xFFFFFFFF))})


def _sums() -> list:
    return [F.count("x").alias("cells"), F.coalesce(F.sum("_high"), F.lit(0)).alias("high"), F.coalesce(F.sum("_low"), F.lit(0)).alias("low")]


def fingerprint(voxels: DataFrame, extent: int = 32) -> DataFrame:
    """cx, cy, cz, cells, high, low: number of solid cells of each chunk and sums of their hashes.

    Sums do not depend on order, add up inside tasks before the shuffle, and change
    when a row is lost, doubled or altered. Air is not stored and does not count.
    """
    solid = voxels.where(F.col("material_id") != 0)
    placed = solid.select(*XYZ, *CELL, *[floor_div(a, extent).alias(c) for a, c in zip(XYZ, CHUNK)])
    return _print(placed).groupBy(*CHUNK).agg(*_sums())


def inspect_chunks(files: DataFrame) -> DataFrame:
    """Cells of chunk files (cx, cy, cz, content), with one more row per file: x null, ``error`` null or what is wrong.

    Unlike ``decode_chunks`` a damaged file does not end the job. A file whose header
    names another chunk than its row is an error.
    """
    columns = [*CHUNK, *XYZ, *CELL]
    kinds = {**{c: "Int64" for c in [*CHUNK, *XYZ]}, **{c: "Int16" for c in CELL}, "error": "object"}

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                at, error, key = np.empty(0, np.int64), None, (row.cx, row.cy, row.cz)
                try:
                    coord, extent, values = decode_chunk(bytes(row.content) if row.content is not None else b"")
                    if tuple(coord) != key:
                        error = f"holds chunk {tuple(coord)}"
                    else:
                        at = np.flatnonzero(values & 0xFF)
                except (WorldFormatError, WorldVersionError, WorldCorruptError, NotImplementedError) as problem:
                    error = str(problem)
                except Exception as problem:  # noqa: BLE001 - a broken compressed stream has many error types
                    error = f"{type(problem).__name__}: {problem}"
                mark = pd.DataFrame({**{c: [k] for c, k in zip(CHUNK, key)}, **{c: [None] for c in [*XYZ, *CELL]}, "error": [error]})
                yield mark.astype(kinds)
                if at.size:
                    v = values[at]
                    data = dict(zip(CHUNK, key))
                    data |= {"x": at // (extent * extent) + key[0] * extent, "y": at // extent % extent + key[1] * extent, "z": at % extent + key[2] * extent}
                    data |= {c: (v >> 8 * i & 0xFF).astype(np.int16) for i, c in enumerate(CELL)}
                    yield pd.DataFrame({**data, "error": None})[[*columns, "error"]]

    schema = "cx bigint, cy bigint, cz bigint, " + VOXELS + ", error string"
    return files.select(*CHUNK, "content").mapInPandas(run, schema=schema)


def verify_chunks(voxels: DataFrame, files: DataFrame, extent: int = 32) -> DataFrame:
    """One row per chunk of either side: status, cells expected and found, and the error of an unreadable file.

    Status is ok, missing (no file), unreadable, different, unexpected (cells in a
    chunk that should have none) or repeated (several files of one chunk). Without
    voxels and files there are no rows; a chunk of air without a file does not appear.
    """
    want = fingerprint(voxels, extent).select(*CHUNK, *[F.col(c).alias(f"want_{c}") for c in PRINT])
    got = _print(inspect_chunks(files)).groupBy(*CHUNK).agg(
        *_sums(), F.max("error").alias("error"), F.count_if(F.col("x").isNull()).alias("files"))
    both = want.join(got, CHUNK, "full_outer")
    same = F.lit(True)
    for c in PRINT:
        same = same & (F.coalesce(f"want_{c}", F.lit(0)) == F.col(c))
    status = (
        F.when(F.col("files").isNull(), "missing").when(F.col("error").isNotNull(), "unreadable").when(F.col("files") > 1, "repeated")
        .when(same, "ok").when(F.col("want_cells").isNull(), "unexpected").otherwise("different"))
    return both.select(*CHUNK, status.alias("status"), F.coalesce("want_cells", F.lit(0)).alias("cells_expected"),
                       F.coalesce("cells", F.lit(0)).alias("cells_found"), "error")


def verify_world(spark: SparkSession, path: str, voxels: DataFrame, extent: int = 32) -> DataFrame:
    """``verify_chunks`` of a world folder. File readers pass over files of no bytes, so such a chunk is missing."""
    return verify_chunks(voxels, chunk_files(spark, path), extent)


def require_verified(report: DataFrame) -> None:
    """Raise ``WorldCorruptError`` that counts the bad chunks and names the first few."""
    bad = report.where("status <> 'ok'")
    first = bad.orderBy(*CHUNK).limit(NAMED).collect()
    if first:
        named = ", ".join(f"({r.cx}, {r.cy}, {r.cz}) {r.status}" for r in first)
        raise WorldCorruptError(f"{bad.count()} chunks differ from what was written: {named}")
