"""Voxel world directories: chunk codec, index, manifest, palette, entities.

A chunk is a bounded unit (``extent``^3 cells), so encoding is one grouped task
per chunk and decoding a map over binary files. Voxels travel as sparse rows;
air is never materialised outside a codec call.
"""

from __future__ import annotations

import gzip
import json
import os
import struct
import tempfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxhive.functions.cells import floor_div
from voxhive.functions.morton import morton_key
from voxhive.operators.voxels import CHUNK, XYZ
from voxhive.session import cut, spread

# Fixed values of the chunk file layout.
CHUNK_MAGIC, INDEX_MAGIC = b"CHNK", b"CIDX"
VERSION = 0x0100
HEADER, ENTRY = "<4sHHiiiBBHI", "<iiiQI"
HEADER_SIZE, ENTRY_SIZE = struct.calcsize(HEADER), struct.calcsize(ENTRY)
DENSE, RLE, SVO = 0, 1, 2
RAW, LZ4, ZSTD, GZIP = 0, 1, 2, 3
CELL = ["material_id", "semantic_id", "state", "color_palette_idx"]
VOXELS = "x bigint, y bigint, z bigint, material_id smallint, semantic_id smallint, state smallint, color_palette_idx smallint"
CHUNKS = "cx bigint, cy bigint, cz bigint, content binary, size_bytes bigint"
INDEX = "cx int, cy int, cz int, file_offset bigint, size_bytes bigint"


class WorldError(Exception):
    """Base of all world errors."""


class WorldFormatError(WorldError):
    """The data violates the layout."""


class WorldCorruptError(WorldError):
    """A checksum does not match."""


class WorldVersionError(WorldError):
    """A layout version this code does not read."""


# ---------------------------------------------------------------- chunk codec
def pack_runs(values: np.ndarray) -> bytes:
    """Runs of at most 255 equal cells: count, then (cell, length) records."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lengths = np.diff(np.append(starts, values.size))
    pieces = -(-lengths // 255)
    cell = np.repeat(values[starts], pieces)
    size = np.full(cell.size, 255)
    size[np.cumsum(pieces) - 1] = lengths - 255 * (pieces - 1)
    record = np.zeros(cell.size, dtype=[("cell", "<u4"), ("n", "u1")])
    record["cell"], record["n"] = cell, size
    return struct.pack("<I", cell.size) + record.tobytes()


def unpack_runs(payload: bytes, total: int) -> np.ndarray:
    count = struct.unpack_from("<I", payload, 0)[0]
    record = np.frombuffer(payload, dtype=[("cell", "<u4"), ("n", "u1")], count=count, offset=4)
    if int(record["n"].sum()) != total:
        raise WorldFormatError(f"runs cover {int(record['n'].sum())} cells, expected {total}")
    return np.repeat(record["cell"], record["n"])


def encode_chunk(coord, values: np.ndarray, extent: int, encoding: int = RLE, compression: int = GZIP) -> bytes:
    """One chunk file from its cells as 32-bit values in scan order."""
    if extent <= 0 or extent & (extent - 1):
        raise WorldFormatError(f"chunk extent must be a power of two, got {extent}")
    if encoding == SVO or compression == LZ4:
        raise NotImplementedError("octree encoding and LZ4 are not part of the layout yet")
    if encoding not in (DENSE, RLE) or compression not in (RAW, ZSTD, GZIP):
        raise WorldFormatError(f"unknown encoding {encoding} or compression {compression}")
    payload = pack_runs(values) if encoding == RLE else values.astype("<u4").tobytes()
    if compression == ZSTD:
        import zstandard
        payload = zstandard.ZstdCompressor().compress(payload)
    elif compression == GZIP:
        payload = gzip.compress(payload, compresslevel=6, mtime=0)
    head = struct.pack(HEADER, CHUNK_MAGIC, VERSION, compression, *coord, encoding, extent.bit_length() - 1, 0, len(payload))
    return head + payload + struct.pack("<I", zlib.crc32(payload))


def decode_chunk(raw: bytes) -> tuple[tuple[int, int, int], int, np.ndarray]:
    """(coord, extent, cells as 32-bit values); typed errors for bad files."""
    if len(raw) < HEADER_SIZE + 4:
        raise WorldFormatError(f"chunk file too small ({len(raw)} bytes)")
    magic, version, compression, cx, cy, cz, encoding, log2, _, size = struct.unpack_from(HEADER, raw)
    if magic != CHUNK_MAGIC:
        raise WorldFormatError(f"bad chunk magic {magic!r}")
    if version != VERSION:
        raise WorldVersionError(f"chunk version {version:#06x} is not supported")
    end = HEADER_SIZE + size
    if len(raw) < end + 4:
        raise WorldFormatError(f"truncated chunk: {len(raw)} of {end + 4} bytes")
    payload = raw[HEADER_SIZE:end]
    if zlib.crc32(payload) != struct.unpack_from("<I", raw, end)[0]:
        raise WorldCorruptError("chunk checksum mismatch")
    if compression == LZ4 or encoding == SVO:
        raise NotImplementedError("octree encoding and LZ4 are not part of the layout yet")
    if compression == ZSTD:
        import zstandard
        payload = zstandard.ZstdDecompressor().decompress(payload)
    elif compression == GZIP:
        payload = gzip.decompress(payload)
    elif compression != RAW:
        raise WorldFormatError(f"unknown compression {compression}")
    extent = 1 << log2
    if encoding == RLE:
        return (cx, cy, cz), extent, unpack_runs(payload, extent**3)
    if encoding == DENSE:
        return (cx, cy, cz), extent, np.frombuffer(payload, dtype="<u4", count=extent**3)
    raise WorldFormatError(f"unknown encoding {encoding}")


def encode_chunks(voxels: DataFrame, extent: int = 32, encoding: int = RLE, compression: int = GZIP) -> DataFrame:
    """Sparse voxels to chunk files, one row each (schema ``CHUNKS``)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        local = pdf[XYZ].to_numpy(dtype=np.int64) - np.array(key, dtype=np.int64) * extent
        at = (local[:, 0] * extent + local[:, 1]) * extent + local[:, 2]
        part = pdf[CELL].to_numpy(dtype=np.uint32)
        values = np.zeros(extent**3, dtype=np.uint32)
        values[at] = part[:, 0] | part[:, 1] << 8 | part[:, 2] << 16 | part[:, 3] << 24
        raw = encode_chunk(tuple(int(k) for k in key), values, extent, encoding, compression)
        return pd.DataFrame({"cx": [key[0]], "cy": [key[1]], "cz": [key[2]], "content": [raw], "size_bytes": [len(raw)]})

    placed = voxels.select(*XYZ, *CELL, *[floor_div(a, extent).alias(c) for a, c in zip(XYZ, CHUNK)])
    return spread(placed, *CHUNK).groupBy(*CHUNK).applyInPandas(run, schema=CHUNKS)


def decode_chunks(files: DataFrame) -> DataFrame:
    """Chunk file contents (column ``content``) to sparse non-air voxels."""

    def run(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                coord, extent, values = decode_chunk(bytes(raw))
                at = np.flatnonzero(values & 0xFF)
                v = values[at]
                base = [c * extent for c in coord]
                yield pd.DataFrame({
                    "x": at // (extent * extent) + base[0], "y": at // extent % extent + base[1], "z": at % extent + base[2],
                    **{c: (v >> 8 * i & 0xFF).astype(np.int16) for i, c in enumerate(CELL)}})

    return files.select("content").mapInPandas(run, schema=VOXELS)


# ---------------------------------------------------------------- sidecars
def check_manifest(doc: dict) -> dict:
    if doc["coord_system"]["convention"] != "right_handed_y_up":
        raise WorldFormatError(f"unsupported convention {doc['coord_system']['convention']!r}")
    ext = doc["voxel"]["chunk_extent_voxels"]
    if len(set(ext)) != 1:
        raise WorldFormatError(f"chunk extent must be cubic, got {ext}")
    if ext[0] <= 0 or ext[0] & (ext[0] - 1):
        raise WorldFormatError(f"chunk extent must be a power of two, got {ext[0]}")
    return doc


def check_palette(doc: dict) -> dict:
    if not doc["materials"] or doc["materials"][0]["id"] != 0 or doc["materials"][0]["name"] != "air":
        raise WorldFormatError("material 0 must be air")
    if len(doc["materials"]) > 256 or len(doc["color_lut"]) > 256:
        raise WorldFormatError("a palette holds at most 256 materials and 256 colours")
    return doc


def make_manifest(world_id: str, voxel_size: float, extent: int, bounds_min, bounds_max, spawn_hint=None, **source) -> dict:
    doc = {
        "format_version": "1.0", "world_id": world_id, "created_at": source.get("created_at", ""),
        "source": {k: source.get(k, "") for k in ("slam_system", "sensor", "raw_data_hash")},
        "coord_system": {"convention": "right_handed_y_up", "world_origin_in_slam_frame": [0.0, 0.0, 0.0],
                         "world_up_axis": [0, 1, 0], "scene_scale_meters_per_unit": 1.0},
        "voxel": {"size_meters": voxel_size, "chunk_extent_voxels": [extent] * 3},
        "bounds_chunks": {"min": list(bounds_min), "max": list(bounds_max)}, "lod_levels": 1,
    }
    if spawn_hint is not None:
        doc["spawn_hint"] = [float(v) for v in spawn_hint]
    return check_manifest(doc)


def concrete_palette() -> dict:
    """Air and one solid material, for maps without classes."""
    return {
        "materials": [
            {"id": 0, "name": "air", "color_rgb": [0, 0, 0], "flags": ["empty"]},
            {"id": 1, "name": "concrete", "color_rgb": [180, 180, 180], "flags": ["solid", "destructible"], "density": 2400.0, "hardness": 30.0}],
        "semantic_classes": [{"id": 0, "name": "unknown", "default_material": 1}, {"id": 1, "name": "wall", "default_material": 1}],
        "color_lut": [[0, 0, 0], [180, 178, 175]],
    }


def _put(path: str, data: bytes) -> None:
    """Publish a file atomically, so a retried task cannot leave half of one."""
    handle, tmp = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "wb") as out:
        out.write(data)
    os.replace(tmp, path)


def write_index(path: str, chunks: DataFrame) -> None:
    """Chunk index in z-order. Rows stream through, sorted by the cluster."""
    ordered = chunks.select(*CHUNK, "size_bytes").orderBy(morton_key())
    body = bytearray()
    count = 0
    for row in ordered.toLocalIterator():
        body += struct.pack(ENTRY, row["cx"], row["cy"], row["cz"], 0, row["size_bytes"])
        count += 1
    _put(path, INDEX_MAGIC + struct.pack("<I", count) + bytes(body))


def parse_index(raw: bytes) -> list[tuple]:
    if raw[:4] != INDEX_MAGIC:
        raise WorldFormatError(f"bad index magic {raw[:4]!r}")
    count = struct.unpack_from("<I", raw, 4)[0]
    if len(raw) < 8 + count * ENTRY_SIZE:
        raise WorldFormatError("truncated index")
    return [struct.unpack_from(ENTRY, raw, 8 + i * ENTRY_SIZE) for i in range(count)]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    with open(path, "rb") as src:
        return spark.createDataFrame(parse_index(src.read()), INDEX)


# ---------------------------------------------------------------- world directory
def _write_chunk_files(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk files from the tasks; returns what was written."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                _put(os.path.join(folder, f"{row.cx}_{row.cy}_{row.cz}.chunk"), bytes(row.content))
            yield pdf[[*CHUNK, "size_bytes"]]

    return cut(chunks.mapInPandas(run, schema="cx bigint, cy bigint, cz bigint, size_bytes bigint"))


def write_world(path: str, voxels: DataFrame, manifest: dict, palette: dict, entities: list[dict] | None = None,
                encoding: int = RLE, compression: int = GZIP) -> DataFrame:
    """Write a world to a folder all workers share. Chunks of an older world go."""
    folder = os.path.join(path, "chunks")
    os.makedirs(folder, exist_ok=True)
    extent = check_manifest(manifest)["voxel"]["chunk_extent_voxels"][0]
    _put(os.path.join(path, "manifest.json"), json.dumps(manifest, indent=2).encode())
    _put(os.path.join(path, "palette.json"), json.dumps(check_palette(palette), indent=2).encode())
    written = _write_chunk_files(encode_chunks(voxels, extent, encoding, compression), folder)
    _drop_stale(folder, written)
    write_index(os.path.join(path, "chunks.idx"), written)
    target = os.path.join(path, "entities.json")
    if entities:
        _put(target, json.dumps({"format_version": "1.0", "entities": entities}, indent=2).encode())
    elif os.path.exists(target):
        os.remove(target)
    return written


def _drop_stale(folder: str, written: DataFrame) -> None:
    present = [(n,) for n in os.listdir(folder) if n.endswith(".chunk")]
    if not present:
        return
    names = written.select(F.concat_ws("_", *CHUNK).alias("n")).select(F.concat("n", F.lit(".chunk")).alias("name"))
    old = written.sparkSession.createDataFrame(present, "name string").join(names, "name", "left_anti")
    for row in old.toLocalIterator():
        os.remove(os.path.join(folder, row["name"]))


def save_dirty(path: str, voxels: DataFrame, dirty: DataFrame, encoding: int = RLE, compression: int = GZIP) -> DataFrame:
    """Rewrite the dirty chunks of an existing world and rebuild its index."""
    if not os.path.isfile(os.path.join(path, "manifest.json")):
        raise WorldFormatError(f"not an initialised world: {path}")
    with open(os.path.join(path, "manifest.json"), encoding="utf-8") as src:
        extent = check_manifest(json.load(src))["voxel"]["chunk_extent_voxels"][0]
    placed = voxels.withColumns({c: floor_div(a, extent) for a, c in zip(XYZ, CHUNK)})
    part = placed.join(dirty.select(*CHUNK).distinct(), CHUNK, "left_semi").select(*XYZ, *CELL)
    written = _write_chunk_files(encode_chunks(part, extent, encoding, compression), os.path.join(path, "chunks"))
    index = os.path.join(path, "chunks.idx")
    kept = read_index(voxels.sparkSession, index).select(*CHUNK, "size_bytes") if os.path.isfile(index) else written.where("false")
    kept = kept.join(dirty.select(*CHUNK), CHUNK, "left_anti").select(*CHUNK, "size_bytes")
    write_index(index, cut(kept.union(written.select(*CHUNK, "size_bytes"))))
    return written


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files of a world folder: path, content and the chunk that the file name tells."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.chunk").load(os.path.join(path, "chunks"))
    name = F.regexp_extract("path", r"(-?\d+_-?\d+_-?\d+)\.chunk$", 1)
    coords = {c: F.split(name, "_").getItem(i).cast("bigint") for i, c in enumerate(CHUNK)}
    return files.select("path", "content", *[v.alias(c) for c, v in coords.items()])


def read_world(spark: SparkSession, path: str, box=None) -> tuple[DataFrame, dict, dict, list[dict]]:
    """(voxels, manifest, palette, entities).

    Chunks come from the index where there is one, else from the folder. ``box``
    ((x0, y0, z0), (x1, y1, z1), exclusive) prunes chunk files by name before any
    is opened.
    """
    def load(name):
        with open(os.path.join(path, name), encoding="utf-8") as src:
            return json.load(src)

    manifest, palette = check_manifest(load("manifest.json")), load("palette.json")
    files = chunk_files(spark, path)
    if os.path.isfile(os.path.join(path, "chunks.idx")):
        files = files.join(read_index(spark, os.path.join(path, "chunks.idx")).select(*CHUNK), CHUNK, "left_semi")
    extent = manifest["voxel"]["chunk_extent_voxels"][0]
    if box:
        for c, lo, hi in zip(CHUNK, *box):
            files = files.where(F.col(c).between(lo // extent, (hi - 1) // extent))
    voxels = decode_chunks(files)
    if box:
        for a, lo, hi in zip(XYZ, *box):
            voxels = voxels.where((F.col(a) >= lo) & (F.col(a) < hi))
    entities = load("entities.json")["entities"] if os.path.isfile(os.path.join(path, "entities.json")) else []
    return voxels, manifest, palette, entities
