import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxhive.sources import catalogues as ca, clouds as cl, worlds as ws


@pytest.fixture
def world(spark):
    rows = [(x, y, -z, 1 + (x + y) % 3, 2, 0, 7) for x in range(-3, 20) for y in range(4) for z in range(3)]
    return spark.createDataFrame(rows, ws.VOXELS)


def bag(df):
    return sorted(tuple(r) for r in df.select("x", "y", "z", *ws.CELL).collect())


@pytest.mark.parametrize("encoding", [ws.DENSE, ws.RLE])
@pytest.mark.parametrize("compression", [ws.RAW, ws.ZSTD, ws.GZIP])
def test_codec_round_trip(spark, world, encoding, compression):
    assert bag(ws.decode_chunks(ws.encode_chunks(world, 8, encoding, compression))) == bag(world)


def test_run_cap_and_sparse_size():
    values = np.zeros(4096, dtype=np.uint32)
    raw = ws.encode_chunk((0, 0, 0), values, 16, ws.RLE, ws.RAW)
    assert len(raw) == 28 + 4 + 5 * 17 + 4
    assert len(raw) < len(ws.encode_chunk((0, 0, 0), values, 16, ws.DENSE, ws.RAW))


def test_bad_files():
    raw = bytearray(ws.encode_chunk((1, -2, 3), np.arange(512, dtype=np.uint32), 8, ws.RLE, ws.RAW))
    assert ws.decode_chunk(bytes(raw))[0] == (1, -2, 3)
    flipped = bytearray(raw); flipped[40] ^= 0xFF
    with pytest.raises(ws.WorldCorruptError):
        ws.decode_chunk(bytes(flipped))
    for at, value, error in ((0, 0, ws.WorldFormatError), (4, 9, ws.WorldVersionError), (20, 99, ws.WorldFormatError)):
        broken = bytearray(raw); broken[at] = value
        with pytest.raises(error):
            ws.decode_chunk(bytes(broken))
    with pytest.raises(ws.WorldFormatError):
        ws.decode_chunk(bytes(raw[:50]))
    with pytest.raises(NotImplementedError):
        ws.encode_chunk((0, 0, 0), np.zeros(8, np.uint32), 2, ws.SVO)
    with pytest.raises(ws.WorldFormatError):
        ws.encode_chunk((0, 0, 0), np.zeros(27, np.uint32), 3)


def test_world_folder(spark, world, tmp_path):
    path = str(tmp_path / "w")
    manifest = ws.make_manifest("w", 0.1, 8, (-1, 0, -1), (3, 1, 1))
    ws.write_world(path, world, manifest, ws.concrete_palette(), [{"id": "a", "label": 5}])
    voxels, man, pal, ents = ws.read_world(spark, path)
    assert bag(voxels) == bag(world) and man["world_id"] == "w" and len(pal["materials"]) == 2 and ents[0]["id"] == "a"
    part, *_ = ws.read_world(spark, path, box=((0, 0, -2), (8, 4, 1)))
    assert bag(part) == [r for r in bag(world) if 0 <= r[0] < 8 and r[2] >= -2]
    before = {n: os.stat(os.path.join(path, "chunks", n)).st_mtime_ns for n in os.listdir(os.path.join(path, "chunks"))}
    edited = world.withColumn("material_id", F.when(F.col("x") == 0, F.lit(9)).otherwise(F.col("material_id")).cast("smallint"))
    dirty = spark.createDataFrame([(0, 0, 0), (0, 0, -1)], "cx bigint, cy bigint, cz bigint")
    assert ws.save_dirty(path, edited, dirty).count() == 2
    after = {n: os.stat(os.path.join(path, "chunks", n)).st_mtime_ns for n in before}
    assert {n for n in before if before[n] != after[n]} == {"0_0_0.chunk", "0_0_-1.chunk"}
    assert bag(ws.read_world(spark, path)[0]) == bag(edited)
    ws.write_world(path, world.where("x >= 8"), manifest, ws.concrete_palette())
    assert bag(ws.read_world(spark, path)[0]) == [r for r in bag(world) if r[0] >= 8]
    assert not os.path.exists(os.path.join(path, "entities.json"))
    with pytest.raises(ws.WorldFormatError):
        ws.save_dirty(str(tmp_path / "none"), world, dirty)


def test_sidecar_checks():
    good = ws.make_manifest("w", 0.1, 8, (0, 0, 0), (1, 1, 1))
    for change in ({"coord_system": {"convention": "z_up"}}, {"voxel": {"chunk_extent_voxels": [8, 8, 4]}}, {"voxel": {"chunk_extent_voxels": [6, 6, 6]}}):
        with pytest.raises(ws.WorldFormatError):
            ws.check_manifest({**good, **change})
    palette = ws.concrete_palette()
    with pytest.raises(ws.WorldFormatError):
        ws.check_palette({**palette, "materials": palette["materials"][1:]})
    with pytest.raises(ws.WorldFormatError):
        ws.check_palette({**palette, "materials": palette["materials"] * 200})


def test_clouds(spark, tmp_path):
    head = "VERSION .7\nFIELDS x y z i\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA {}\n"
    (tmp_path / "a.pcd").write_text(head.format("ascii") + "1 2 3 9\n4 5 6 9\n")
    (tmp_path / "b.pcd").write_bytes(head.format("binary").encode() + np.array([[7, 8, 9, 0], [1, 1, 1, 0]], "<f4").tobytes())
    got = sorted(tuple(r) for r in cl.read_pcd(spark, str(tmp_path / "*.pcd")).select("x", "y", "z").collect())
    assert got == [(1, 1, 1), (1, 2, 3), (4, 5, 6), (7, 8, 9)]
    (tmp_path / "t.txt").write_text("# c\n1.5 1 2 3 0 0 0 2\n\n2.5 1 2\n")
    assert tuple(cl.read_trajectory(spark, str(tmp_path / "t.txt")).first()) == (1.5, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)


def test_catalogues(spark, tmp_path):
    names, sets = ca.parse_label_space("label_names:\n- {label: 3, name: floor}\n- {label: 5, name: chair}\nsurface_places_labels: [3]\n")
    assert names == {3: "floor", 5: "chair"} and sets["surface_places_labels"] == {3}
    graph = {"layer_names": {"OBJECTS": {"layer": 2, "partition": 0}}, "nodes": [
        {"id": "1", "layer": 2, "partition": 0, "attributes": {"name": "a", "semantic_label": 5, "bounding_box": {"dimensions": [2, 2, 2], "world_P_center": [1, 1, 1]}}},
        {"id": "2", "layer": 2, "partition": 0, "attributes": {"name": "b"}},
        {"id": "3", "layer": 3, "partition": 0, "attributes": {"position": [0, 0, 0]}}]}
    old = {"layers": [{"nodes": [{"id": "9", "attributes": {"category": " Chair ", "bbox": None, "position": [1, 2, 3]}}]}]}
    docs = spark.createDataFrame([(json.dumps(graph),), (json.dumps(old),)], "value string")
    got = {r["id"]: r for r in ca.scene_graph_objects(docs).collect()}
    assert set(got) == {"1", "9"} and got["1"]["min_x"] == 0.0 and got["1"]["semantic_label"] == 5 and got["9"]["category"] == "chair"
    model = {"textures": {"all": "#side", "side": "block/stone", "loop": "#loop"}, "elements": [
        {"from": [0, 0, 0], "to": [16, 8, 16], "faces": {"up": {"texture": "#all"}, "down": {"texture": "#loop"}}}]}
    rows = ca.item_boxes(spark.createDataFrame([("t", json.dumps(model))], "item_id string, value string")).collect()
    assert {r["face"]: r["texture"] for r in rows} == {"up": "block/stone", "down": "block/missing"}
    assert rows[0]["extent_y"] == 0.5 and rows[0]["min_x"] == -0.5
    blocks = spark.createDataFrame([("minecraft:oak_log[axis=y]",), ("cave_air",), ("odd",)], "b string")
    ids = [r[0] for r in blocks.select(ca.block_material(F.col("b"), {"oak_log": "wood"}, {"stone": 1, "wood": 4})).collect()]
    assert ids == [4, 0, 1]
