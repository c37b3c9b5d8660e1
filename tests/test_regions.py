"""Region files and schematics: packing against plain bit strings, round trips, pruning, damage."""

import random

import numpy as np
import pytest

from voxhive.sources import regions as rg


@pytest.mark.parametrize("bits", [1, 2, 4, 5, 7, 13, 31])
@pytest.mark.parametrize("crossing", [True, False])
def test_packing_against_bit_strings(bits, crossing):
    rng = random.Random(bits)
    values = [rng.randrange(1 << bits) for _ in range(333)]
    if crossing:
        text = "".join(format(v, f"0{bits}b")[::-1] for v in values)
    else:
        each = 64 // bits
        text = "".join("".join(format(v, f"0{bits}b")[::-1] for v in values[i:i + each]).ljust(64, "0") for i in range(0, 333, each))
    text = text.ljust(-(-len(text) // 64) * 64, "0")
    words = [int(text[i:i + 64][::-1], 2) for i in range(0, len(text), 64)]
    packed = rg.pack(np.array(values), bits, crossing)
    assert [int(w) & (1 << 64) - 1 for w in packed] == words
    assert rg.unpack(packed, bits, len(values), crossing).tolist() == values
    with pytest.raises(rg.DamagedFile):
        rg.unpack(packed[:-1], bits, len(values), crossing)


def world(spark, n=3000, seed=3, kinds=40):
    rng = random.Random(seed)
    cells = {(rng.randrange(-700, 900), rng.randrange(-64, 200), rng.randrange(-40, 600)): f"minecraft:b{rng.randrange(kinds)}" for _ in range(n)}
    cells |= {(x, 5, z): "minecraft:stone" for x in range(16) for z in range(16)}
    return cells, spark.createDataFrame([(*k, v) for k, v in cells.items()], rg.BLOCKS)


def got(df):
    return {(r.x, r.y, r.z): r.block for r in df.collect()}


@pytest.mark.parametrize("version", [3465, 2600, 2200])
def test_region_round_trip(spark, version):
    cells, table = world(spark)
    files = rg.encode_regions(table, version)
    assert got(rg.decode_regions(files)) == cells
    some = rg.decode_regions(files, box=(-3, 0, 20, 9), y_min=0, y_max=99)
    want = {k: v for k, v in cells.items() if -48 <= k[0] < 336 and 0 <= k[2] < 160 and 0 <= k[1] <= 99}
    assert got(some) == want and want


def test_files_outside_the_box_are_not_opened(spark, tmp_path):
    cells, table = world(spark)
    for r in rg.encode_regions(table).collect():
        (tmp_path / r.path).write_bytes(bytes(r.content))
    (tmp_path / "r.9.9.mca").write_bytes(b"damaged")
    (tmp_path / "notes.txt").write_text("x")
    inside = rg.read_regions(spark, str(tmp_path), box=(0, 0, 31, 31))
    assert got(inside) == {k: v for k, v in cells.items() if 0 <= k[0] < 512 and 0 <= k[2] < 512}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        assert rg.read_regions(spark, str(tmp_path), box=(0, 0, 31, 31)).rdd.getNumPartitions() < rg.read_regions(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="region header cut short"):
        rg.read_regions(spark, str(tmp_path)).count()
    assert got(rg.read_regions(spark, str(tmp_path), damaged="skip")) == cells


def test_damaged_chunks(spark):
    cells, table = world(spark, n=50)
    row = rg.encode_regions(table.where("x >= 0 and x < 512 and z >= 0 and z < 512")).collect()[0]
    body = bytearray(row.content)
    body[2 * rg.SECTOR + 9:2 * rg.SECTOR + 40] = b"\0" * 31
    files = spark.createDataFrame([(row.path, bytes(body)), ("r.0.1.mca", b""), ("readme", b"zz")], "path string, content binary")
    with pytest.raises(Exception, match="DamagedFile"):
        rg.decode_regions(files).count()
    left = got(rg.decode_regions(files, damaged="skip"))
    assert left and left.items() < cells.items()
    for bad in (b"", b"\x0a", b"\x08\0\0", b"\x1f\x8bxx", b"\x0a\0\0\x63"):
        with pytest.raises(rg.DamagedFile):
            rg.read_tags(bad)


def test_schematics(spark):
    rng = random.Random(8)
    rows = [(p, r, s * rng.randrange(9), rng.randrange(7), s * rng.randrange(5), f"minecraft:b{rng.randrange(11)}")
            for p in ("a", "b") for r, s in (("one", 1), ("two", -1)) for _ in range(150)]
    rows = list({r[:5]: r for r in rows}.values())
    table = spark.createDataFrame(rows, "path string, region string, x long, y long, z long, block string")
    files = rg.encode_schematics(table)
    back = rg.decode_schematics(files)
    assert {tuple(r) for r in back.select("path", "region", "x", "y", "z", "block").collect()} == set(rows)
    cells = {(r[0], *r[2:5]): r[5] for r in sorted(rows, key=lambda r: r[1])}
    assert {(r.path, r.x, r.y, r.z): r.block for r in rg.schematic_cells(back).collect()} == cells


def test_empty(spark):
    none = spark.createDataFrame([], "path string, content binary")
    assert rg.decode_regions(none).collect() == [] and rg.decode_schematics(none).collect() == []
    assert rg.encode_regions(spark.createDataFrame([], rg.BLOCKS)).collect() == []
