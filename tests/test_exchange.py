"""Exchange documents and change logs: both layouts, round trips, limits, damage."""

import io
import json

import numpy as np
import pytest

from voxhive.sources import exchange as ex

NODES = "seq bigint, id string, layer string, label string, x double, y double, z double, parent string, class bigint, voxel_count bigint, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, shape_0 double, shape_1 double, shape_2 double"


def scene(spark):
    box = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.1, 0.2, 0.3)
    none = (None,) * 9
    rows = [(1, "b", "building", "house", 0.0, 0.0, 0.0, None, None, None, *none), (2, "r1", "room", "", 1.0, 0.0, 0.0, "b", None, None, *none),
            (3, "r2", "room", 'k "q" ü', 2.0, 0.0, 0.0, "b", None, None, *none)]
    rows += [(10 + i, f"o{i}", "object", "chair", float(i), 0.5, 0.0, f"r{1 + i % 2}" if i else "o1", 7, i, *box) for i in range(9)]
    return spark.createDataFrame(rows, NODES)


@pytest.mark.parametrize("per_document", [1, 3, 100])
def test_scene_round_trip(spark, tmp_path, per_document):
    nodes, folder = scene(spark), str(tmp_path / "graph")
    ex.write_scene_graph(nodes, folder, per_document=per_document, cycle=4)
    back = ex.read_scene_graph(spark, folder).select(*nodes.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, nodes.collect()))
    docs = [json.loads(r.value) for r in ex.scene_documents(nodes, per_document=per_document).collect()]
    assert sum(len(d["nodes"]) for d in docs) == 12 and all(d["coords"] == "vxw_yup" for d in docs)
    if per_document == 100:
        assert len(docs) == 3  # the building, and a document per room with the objects in it


def test_nested_layout_of_one_file(spark, tmp_path):
    doc = {"root": "b", "nodes": [
        {"id": "b", "layer": "building", "label": "x", "pos_m": [0, 1, 2], "attrs": {}, "parent": None, "children": ["o"]},
        {"id": "o", "layer": "object", "pos_m": [3, 4, 5], "attrs": {"label_id": 9, "voxel_count": 5, "other": [1]}, "parent": "b", "children": []}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=2))
    rows = {r.id: r for r in ex.read_scene_graph(spark, str(tmp_path), whole=True).collect()}
    assert (rows["o"].seq, rows["o"].y, rows["o"]["class"], rows["o"].voxel_count, rows["o"].parent, rows["o"].label) == (1, 4.0, 9, 5, "b", "")
    bad = spark.createDataFrame([("{\"nodes\": [",)], "value string")
    with pytest.raises(Exception):
        ex.parse_scene_documents(bad).collect()


LOG = "seq bigint, x bigint, y bigint, z bigint, op string, sem int, generator string, binding string"


def test_overlay_round_trip(spark, tmp_path, monkeypatch):
    rows = [(i, -i, i * 2, 5, ex.OPS[i % 3], i % 256, f"g{i % 5}", "manual" if i % 2 else "persistent") for i in range(300)]
    log, folder = spark.createDataFrame(rows, LOG).repartition(4), str(tmp_path / "log")
    ex.write_overlay(log, folder)
    assert sorted(map(tuple, ex.read_overlay(spark, folder).collect())) == rows
    legends = {(r.kind, r.id): r.name for r in spark.read.parquet(f"{folder}/legends").collect()}
    assert legends["generator", 0] == "g0" and legends["binding", 1] == "manual"
    monkeypatch.setattr(ex, "GENERATORS", 4)
    with pytest.raises(ValueError):
        ex.write_overlay(log, folder)
    with pytest.raises(Exception, match="bad change record"):
        ex.write_overlay(spark.createDataFrame([(1, 0, 0, 0, "drop", 1, "g", "b")], LOG), str(tmp_path / "bad"))


def test_array_archives(spark):
    held = io.BytesIO()
    np.savez_compressed(held, idx=np.array([[1, 2, 3], [-4, 5, 6]], np.int32), op=np.array([0, 2], np.uint8), sem=np.array([7, 255], np.uint8),
                        gen_id=np.array([1, 0], np.uint16), bind_id=np.array([0, 0], np.uint8))
    legend = json.dumps({"gen_legend": {"0": "floor", "1": "wall"}, "bind_legend": {"0": "persistent"}})
    files = spark.createDataFrame([("a", held.getvalue(), legend)], "path string, content binary, legend string")
    assert [tuple(r) for r in ex.overlay_archives(files).collect()] == [
        ("a", 0, 1, 2, 3, "add", 7, "wall", "persistent"), ("a", 1, -4, 5, 6, "replace", 255, "floor", "persistent")]


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "none")
    ex.write_scene_graph(scene(spark).limit(0), folder)
    assert ex.read_scene_graph(spark, folder).collect() == []
