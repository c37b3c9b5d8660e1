import os

import pytest

from voxhive.operators.objects import entity_order
from voxhive.sources import verify as vf, worlds as ws

CELLS = "x bigint, y bigint, z bigint, material_id smallint, semantic_id smallint, state smallint, color_palette_idx smallint"


@pytest.fixture
def world(spark):
    rows = [(x, y, -z, 1 + (x + y) % 3, x % 5, 0, 7) for x in range(-3, 20, 2) for y in range(3) for z in range(0, 30, 7)]
    return spark.createDataFrame(rows + [(500, 0, 0, 0, 0, 0, 0)], CELLS)  # the last one is air


def status(report):
    return {(r.cx, r.cy, r.cz): r.status for r in report.collect()}


def test_written_world_verifies(spark, world, tmp_path):
    path = str(tmp_path / "w")
    ws.write_world(path, world, ws.make_manifest("w", 0.1, 8, (-1, 0, -4), (3, 1, 1)), ws.concrete_palette())
    report = vf.verify_world(spark, path, world, 8)
    assert set(status(report).values()) == {"ok"}
    assert report.agg({"cells_found": "sum"}).first()[0] == world.where("material_id <> 0").count()
    vf.require_verified(report)
    names = sorted(os.listdir(os.path.join(path, "chunks")))
    key = lambda n: tuple(int(v) for v in n[:-6].split("_"))
    for name, change in zip(names, (lambda b: b[:10], lambda b: b[:-1] + bytes([b[-1] ^ 1]), lambda b: b"")):
        file = os.path.join(path, "chunks", name)
        with open(file, "rb") as src:
            data = src.read()
        with open(file, "wb") as out:
            out.write(change(data))
    with open(os.path.join(path, "chunks", names[3]), "rb") as src, open(os.path.join(path, "chunks", "9_9_9.chunk"), "wb") as out:
        out.write(src.read())  # a chunk under a foreign name
    os.remove(os.path.join(path, "chunks", names[4]))
    found = status(vf.verify_world(spark, path, world, 8))
    assert {k for k, v in found.items() if v == "unreadable"} == {*map(key, names[:2]), (9, 9, 9)}
    assert {k for k, v in found.items() if v == "missing"} == {key(names[2]), key(names[4])}  # no bytes, no file
    assert all(v == "ok" for k, v in found.items() if k not in {(9, 9, 9), *map(key, names[:3]), key(names[4])})
    with pytest.raises(ws.WorldCorruptError, match="5 chunks"):
        vf.require_verified(vf.verify_world(spark, path, world, 8))


def test_fingerprint_sees_rows(spark, world):
    base = {tuple(r) for r in vf.fingerprint(world, 8).collect()}
    assert base == {tuple(r) for r in vf.fingerprint(world.repartition(7, "y"), 8).collect()}
    twice = world.union(world.limit(1))
    assert len(base ^ {tuple(r) for r in vf.fingerprint(twice, 8).collect()}) == 2
    assert vf.fingerprint(world.where("false"), 8).count() == 0


def test_repeated_unexpected_and_empty(spark, world):
    files = ws.encode_chunks(world.where("material_id <> 0"), 8)
    one = files.where("cx = 0 and cy = 0 and cz = 0")
    found = status(vf.verify_chunks(world, files.union(one), 8))
    assert [k for k, v in found.items() if v != "ok"] == [(0, 0, 0)] and found[0, 0, 0] == "repeated"
    assert set(status(vf.verify_chunks(world.where("false"), files, 8)).values()) == {"unexpected"}
    assert vf.verify_chunks(world.where("false"), files.where("false"), 8).count() == 0


def test_entity_order(spark):
    boxes = [(1, "a", 0., 1., 5., 6., 0., 1.), (2, "b", 0., 2., 1., 2., 0., 1.), (3, "c", 0., 1., 1., 2., 0., 2.), (4, "d", None, 1., None, 2., 0., 1.)]
    df = spark.createDataFrame(boxes, "seq long, id string, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    order = {r.id: (r.by_bottom, r.by_volume) for r in entity_order(df).collect()}
    assert order == {"b": (0, 0), "c": (1, 1), "a": (2, 2), "d": (3, 3)}
