"""Block worlds in region files and schematics: tag trees, packed palettes, chunk pruning.

A region file ``r.X.Z.mca`` holds 32 x 32 chunks of 16 x 16 columns.  Files are read by
Spark's binary reader from any file system; a chunk box removes files by their names
before they are opened and chunks by the file's own header before they are decompressed.
A schematic is one compressed tag tree with named regions.

Blocks come as x, y, z, block; air is not returned.
"""

from __future__ import annotations

import gzip
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxhive.session import spread

# Names of air, bytes of a sector, first data version whose indices keep inside one word.
AIR = ("minecraft:air", "minecraft:cave_air", "minecraft:void_air")
SECTOR = 4096
WHOLE_WORDS = 2529

BLOCKS = "x long, y long, z long, block string"
_NAME = r"r\.(-?\d+)\.(-?\d+)\.mca$"
_SIZES = {1: ">b", 2: ">h", 3: ">i", 4: ">q", 5: ">f", 6: ">d"}
_ARRAYS = {7: ">i1", 11: ">i4", 12: ">i8"}


class DamagedFile(ValueError):
    """A tag tree, region header or palette that does not hold together."""


# ---------------------------------------------------------------- tag trees
class _Tags:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, code: str):
        (value,) = struct.unpack_from(code, self.data, self.at)
        self.at += struct.calcsize(code)
        return value

    def text(self) -> str:
        n = self.number(">H")
        self.at += n
        return self.data[self.at - n:self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind in _SIZES:
            return self.number(_SIZES[kind])
        if kind in _ARRAYS:
            n, item = self.number(">i"), np.dtype(_ARRAYS[kind])
            out = np.frombuffer(self.data, item, n, self.at)
            self.at += n * item.itemsize
            return out
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.number(">b"), self.number(">i")
            return [self.value(inner) for _ in range(n)]
        if kind == 10:
            out = {}
            while inner := self.number(">b"):
                name = self.text()
                out[name] = self.value(inner)
            return out
        raise DamagedFile(f"unknown tag {kind}")


def read_tags(data: bytes) -> dict:
    """The root compound of a tag tree, compressed (gzip, zlib) or plain."""
    try:
        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        elif data[:1] == b"\x78":
            data = zlib.decompress(data)
        tags = _Tags(data)
        if tags.number(">b") != 10:
            raise DamagedFile("no compound at the root")
        tags.text()
        return tags.value(10)
    except (struct.error, IndexError, ValueError, zlib.error, EOFError, OSError) as fault:
        raise DamagedFile(str(fault)) from fault


def write_tags(root: dict) -> bytes:
    """Plain tag tree of nested dicts, lists of dicts, strings, ints and integer arrays."""
    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">H", len(raw)) + raw

    def value(v) -> tuple[int, bytes]:
        if isinstance(v, dict):
            return 10, b"".join(struct.pack(">b", k) + text(n) + b for n, (k, b) in ((n, value(x)) for n, x in v.items())) + b"\0"
        if isinstance(v, str):
            return 8, text(v)
        if isinstance(v, list):
            inner = [value(x) for x in v]
            return 9, struct.pack(">bi", inner[0][0] if inner else 0, len(inner)) + b"".join(b for _, b in inner)
        if isinstance(v, np.ndarray):
            kind = {1: 7, 4: 11, 8: 12}[v.dtype.itemsize]
            return kind, struct.pack(">i", len(v)) + v.astype(_ARRAYS[kind]).tobytes()
        return (1, struct.pack(">b", v)) if isinstance(v, np.int8) else (3, struct.pack(">i", int(v)))

    return b"\x0a" + text("") + value(root)[1]


# ---------------------------------------------------------------- packed palettes
def index_bits(palette: int, least: int) -> int:
    return max(least, (max(palette, 1) - 1).bit_length())


def unpack(words: np.ndarray, bits: int, count: int, crossing: bool) -> np.ndarray:
    """``count`` indices of ``bits`` bits from 64-bit words, low bits first; ``crossing``: fields go on in the next word."""
    words = np.asarray(words).astype(np.int64).view(np.uint64)
    place = np.arange(count, dtype=np.uint64)
    mask = np.uint64((1 << bits) - 1)
    if crossing:
        start = place * np.uint64(bits)
        word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
        if count and int(word[-1]) + int(shift[-1] + np.uint64(bits) > 64) >= len(words):
            raise DamagedFile("too few words of indices")
        follow = words[np.minimum(word + 1, len(words) - 1)]
        # A shift by 64 is not defined: two steps.
        high = (follow << (np.uint64(63) - shift)) << np.uint64(1)
        return ((words[word] >> shift | np.where(shift + np.uint64(bits) > 64, high, 0)) & mask).astype(np.int64)
    each = 64 // bits
    word = (place // np.uint64(each)).astype(np.int64)
    if count and int(word[-1]) >= len(words):
        raise DamagedFile("too few words of indices")
    return (words[word] >> (place % np.uint64(each)) * np.uint64(bits) & mask).astype(np.int64)


def pack(indices: np.ndarray, bits: int, crossing: bool) -> np.ndarray:
    """Inverse of :func:`unpack`."""
    values, place = np.asarray(indices, np.uint64), np.arange(len(indices), dtype=np.uint64)
    if crossing:
        start = place * np.uint64(bits)
        word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
        out = np.zeros(-(-len(indices) * bits // 64) + 1, np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        np.bitwise_or.at(out, word + 1, np.where(shift + np.uint64(bits) > 64, (values >> (np.uint64(63) - shift)) >> np.uint64(1), 0))
        out = out[:-1]
    else:
        each = 64 // bits
        out = np.zeros(-(-len(indices) // each), np.uint64)
        np.bitwise_or.at(out, (place // np.uint64(each)).astype(np.int64), values << (place % np.uint64(each)) * np.uint64(bits))
    return out.view(np.int64)


# ---------------------------------------------------------------- region files
def _sections(chunk: dict) -> Iterator[tuple[int, list[str], np.ndarray | None, bool]]:
    """(section height, block names, index words, whether fields cross words) of both layouts of a chunk."""
    body = chunk.get("Level", chunk)
    crossing = chunk.get("DataVersion", 0) < WHOLE_WORDS
    for section in body.get("sections", body.get("Sections", [])):
        states = section.get("block_states", {})
        palette = states.get("palette", section.get("Palette"))
        if palette:
            yield int(section["Y"]), [p["Name"] for p in palette], states.get("data", section.get("BlockStates")), crossing


def chunk_blocks(chunk: dict, cx: int, cz: int, y_min: int | None, y_max: int | None) -> pd.DataFrame | None:
    """x, y, z, block of one chunk's blocks that are not air, y_min and y_max included; None if there are none."""
    parts = []
    for height, names, words, crossing in _sections(chunk):
        low = 16 * height
        if (y_min is not None and low + 15 < y_min) or (y_max is not None and low > y_max):
            continue
        solid = np.array([n not in AIR for n in names])
        if words is None:
            index = np.zeros(4096, np.int64)
        else:
            index = unpack(words, index_bits(len(names), 4), 4096, crossing)
        if int(index.max()) >= len(names):
            raise DamagedFile("index beyond the palette")
        at = np.flatnonzero(solid[index])  # index = (y * 16 + z) * 16 + x
        y = low + (at >> 8)
        keep = np.ones(len(at), bool)
        if y_min is not None:
            keep &= y >= y_min
        if y_max is not None:
            keep &= y <= y_max
        at, y = at[keep], y[keep]
        if not len(at):
            continue
        parts.append(pd.DataFrame({
            "x": 16 * cx + (at & 15), "y": y, "z": 16 * cz + (at >> 4 & 15), "block": np.array(names, object)[index[at]]}))
    return pd.concat(parts, ignore_index=True) if parts else None


def region_chunks(content: bytes, rx: int, rz: int, box: tuple[int, int, int, int] | None) -> Iterator[tuple[int, int, bytes]]:
    """(cx, cz, tag tree) of a region's chunks inside ``box`` (cx0, cz0, cx1, cz1, all included)."""
    if not content:
        return
    if len(content) < 2 * SECTOR:
        raise DamagedFile("region header cut short")
    table = np.frombuffer(content, ">u4", 1024)
    for slot in np.flatnonzero(table).tolist():
        cx, cz = 32 * rx + slot % 32, 32 * rz + slot // 32
        if box and not (box[0] <= cx <= box[2] and box[1] <= cz <= box[3]):
            continue
        at = int(table[slot] >> 8) * SECTOR
        if at + 5 > len(content):
            raise DamagedFile("chunk beyond the file")
        length, how = struct.unpack_from(">IB", content, at)
        if at + 4 + length > len(content) or how not in (1, 2, 3):
            raise DamagedFile("chunk cut short")
        yield cx, cz, content[at + 5:at + 4 + length]


def decode_regions(files: DataFrame, box: tuple[int, int, int, int] | None = None, y_min: int | None = None,
                   y_max: int | None = None, damaged: str = "raise") -> DataFrame:
    """x, y, z, block of region files given as rows of (path, content).

    ``damaged``: ``raise`` stops at a damaged chunk, ``skip`` leaves that chunk out.
    Names that are not region files are left out.
    """
    if damaged not in ("raise", "skip"):
        raise ValueError("damaged must be 'raise' or 'skip'")
    named = files.select("content", *[F.regexp_extract("path", _NAME, k).alias(n) for k, n in ((1, "rx"), (2, "rz"))]).where("rx <> ''")
    if box:
        named = named.where(F.col("rx").cast("long").between(box[0] >> 5, box[2] >> 5) & F.col("rz").cast("long").between(box[1] >> 5, box[3] >> 5))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rx, rz, content in zip(frame["rx"], frame["rz"], frame["content"]):
                try:
                    for cx, cz, raw in region_chunks(content, int(rx), int(rz), box):
                        try:
                            rows = chunk_blocks(read_tags(raw), cx, cz, y_min, y_max)
                            if rows is not None:
                                yield rows
                        except DamagedFile:
                            if damaged == "raise":
                                raise
                except DamagedFile:
                    if damaged == "raise":
                        raise

    return named.select("rx", "rz", "content").mapInPandas(run, BLOCKS)


def read_regions(spark: SparkSession, folder: str, box: tuple[int, int, int, int] | None = None, y_min: int | None = None,
                 y_max: int | None = None, damaged: str = "raise") -> DataFrame:
    """Blocks of a folder of region files; files outside the chunk ``box`` are not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "r.*.*.mca").load(folder)
    if box:
        name = F.col("_metadata.file_name")
        for k, low, high in ((1, box[0] >> 5, box[2] >> 5), (2, box[1] >> 5, box[3] >> 5)):
            files = files.where(F.regexp_extract(name, _NAME, k).cast("long").between(low, high))
    return decode_regions(files.select("path", "content"), box, y_min, y_max, damaged)


def encode_regions(blocks: DataFrame, data_version: int = 3465) -> DataFrame:
    """(path, content) of region files that hold the blocks (x, y, z, block); one row per region."""
    layout_new, crossing = data_version >= 2844, data_version < WHOLE_WORDS

    def section(height: int, rows: pd.DataFrame) -> dict:
        names = ["minecraft:air", *sorted(set(rows["block"]))]
        at = {n: i for i, n in enumerate(names)}
        index = np.zeros(4096, np.int64)
        x, y, z = (rows[a].to_numpy() & 15 for a in ("x", "y", "z"))
        index[y << 8 | z << 4 | x] = rows["block"].map(at).to_numpy()
        words, palette = pack(index, index_bits(len(names), 4), crossing), [{"Name": n} for n in names]
        if layout_new:
            return {"Y": np.int8(height), "block_states": {"palette": palette, "data": words}}
        return {"Y": np.int8(height), "Palette": palette, "BlockStates": words}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        header, body = np.zeros(2 * SECTOR // 4, ">u4"), []
        sector = 2
        rows = frame.assign(cx=frame["x"] // 16, cy=frame["y"] // 16, cz=frame["z"] // 16).sort_values(["cx", "cz", "cy"])
        for (cx, cz), own in rows.groupby(["cx", "cz"], sort=True):
            parts = [section(int(h), r) for h, r in own.groupby("cy", sort=True)]
            root = {"DataVersion": data_version, **({"sections": parts} if layout_new else {"Level": {"Sections": parts}})}
            raw = zlib.compress(write_tags(root))
            raw = struct.pack(">IB", len(raw) + 1, 2) + raw
            taken = -(-len(raw) // SECTOR)
            header[(cx & 31) + 32 * (cz & 31)] = sector << 8 | min(taken, 255)
            body.append(raw.ljust(taken * SECTOR, b"\0"))
            sector += taken
        rx, rz = int(frame["x"].iloc[0]) >> 9, int(frame["z"].iloc[0]) >> 9
        return pd.DataFrame({"path": [f"r.{rx}.{rz}.mca"], "content": [header.tobytes() + b"".join(body)]})

    keyed = blocks.select("x", "y", "z", "block", F.expr("shiftright(x, 9)").alias("rx"), F.expr("shiftright(z, 9)").alias("rz"))
    return spread(keyed, "rx", "rz").groupBy("rx", "rz").applyInPandas(run, "path string, content binary")


# ---------------------------------------------------------------- schematics
def schematic_regions(content: bytes) -> Iterator[tuple[str, pd.DataFrame]]:
    """Name and blocks of each region, in file order; coordinates count from the region's own corner."""
    for name, region in read_tags(content).get("Regions", {}).items():
        size = [int(region["Size"][a]) for a in "xyz"]
        wide = [abs(s) for s in size]
        names = [p["Name"] for p in region["BlockStatePalette"]]
        count = math.prod(wide)
        index = unpack(region["BlockStates"], index_bits(len(names), 2), count, crossing=True)
        if count and int(index.max()) >= len(names):
            raise DamagedFile("index beyond the palette")
        at = np.flatnonzero(np.array([n not in AIR for n in names])[index])  # index = (y * depth + z) * width + x
        low = [min(0, s + 1) for s in size]  # a negative size runs back from the corner
        yield name, pd.DataFrame({
            "x": low[0] + at % wide[0], "y": low[1] + at // (wide[0] * wide[2]), "z": low[2] + at // wide[0] % wide[2],
            "block": np.array(names, object)[index[at]]})


def decode_schematics(files: DataFrame) -> DataFrame:
    """path, region, seq (order in the file), x, y, z, block of schematics given as rows of (path, content)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                for seq, (name, rows) in enumerate(schematic_regions(content)):
                    yield rows.assign(path=path, region=name, seq=seq)[["path", "region", "seq", "x", "y", "z", "block"]]

    return files.select("path", "content").mapInPandas(run, f"path string, region string, seq int, {BLOCKS}")


def read_schematics(spark: SparkSession, folder: str, glob: str = "*.litematic") -> DataFrame:
    return decode_schematics(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder))


def schematic_cells(blocks: DataFrame) -> DataFrame:
    """path, x, y, z, block: where regions of one schematic share a place, the later one stays."""
    last = F.max_by("block", "seq").alias("block")
    return blocks.groupBy("path", "x", "y", "z").agg(last)


def encode_schematics(blocks: DataFrame) -> DataFrame:
    """(path, content) of schematics that hold (path, region, x, y, z, block); regions lie in name order, from their least corner."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        regions = {}
        for name, rows in frame.groupby("region", sort=True):
            at = rows[["x", "y", "z"]].to_numpy(np.int64)
            low, high = np.minimum(at.min(axis=0), 0), np.maximum(at.max(axis=0), 0)
            if (low < 0).any() and ((high > 0) & (low < 0)).any():
                raise ValueError("a region lies on one side of its corner on every axis")
            size, wide = np.where(low < 0, low - 1, high + 1), high - low + 1
            names = ["minecraft:air", *sorted(set(rows["block"]))]
            index = np.zeros(int(wide.prod()), np.int64)
            x, y, z = (at - low).T
            index[(y * wide[2] + z) * wide[0] + x] = rows["block"].map({n: i for i, n in enumerate(names)}).to_numpy()
            regions[name] = {
                "Position": dict.fromkeys("xyz", 0), "Size": dict(zip("xyz", size.tolist())), "BlockStatePalette": [{"Name": n} for n in names],
                "BlockStates": pack(index, index_bits(len(names), 2), crossing=True)}
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [gzip.compress(write_tags({"Regions": regions}), mtime=0)]})

    return spread(blocks, "path").groupBy("path").applyInPandas(run, "path string, content binary")
