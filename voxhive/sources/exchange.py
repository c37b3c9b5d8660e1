"""Exchange of scene graphs and change logs with other programs.

A scene graph is a folder of JSON documents, one per line, each with the header of the
graph and the nodes of one subtree (at most ``per_document`` of them), so no task writes
or parses a whole graph.  Documents that others write as one file are read as well, in
the flat layout (``pos``, object fields on the node) and in the nested one (``pos_m``, ``attrs``).

A change log is a table whose names of generators and bindings are numbers into legends.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxhive.operators.completion import check_changes
from voxhive.operators.scene import NODE_COLS, OBJECT_COLS, room_of
from voxhive.operators.voxels import XYZ

PER_DOCUMENT = 10_000
# Numbers of the operations in stored change logs, and how many names a legend can hold.
OPS = ("add", "remove", "replace")
GENERATORS, BINDINGS = 1 << 16, 1 << 8

_NUMBERS = {"class": "bigint", "voxel_count": "bigint", "place_id": "string", "misses": "bigint", "seen_count": "bigint"}
_BODY = (
    "id:string,layer:string,label:string,name:string,parent:string,seq:bigint,pos:array<double>,pos_m:array<double>,"
    "class:bigint,voxel_count:bigint,place_id:string,misses:bigint,seen_count:bigint,bbox_min_m:array<double>,bbox_max_m:array<double>,shape:array<double>"
)
DOCUMENT = (
    f"struct<stamp_sec:bigint,cycle:bigint,id_counter:bigint,frame:string,coords:string,root:string,nodes:array<struct<{_BODY},"
    "attrs:struct<class:bigint,label_id:bigint,voxel_count:bigint,place_id:string,misses:bigint,seen_count:bigint,"
    "bbox_min_m:array<double>,bbox_max_m:array<double>,shape:array<double>>>>>"
)


def _triple(prefix: str, names: tuple[str, ...] | list[str], columns: list[str]) -> Column:
    have = [F.col(f"{prefix}{n}") if f"{prefix}{n}" in columns else F.lit(None).cast("double") for n in names]
    full = F.lit(True)
    for h in have:
        full = full & h.isNotNull()
    return F.when(full, F.array(*have))


def scene_documents(nodes: DataFrame, id_counter: int = 0, cycle: int = 0, stamp_sec: int = 0, frame: str = "map",
                    per_document: int = PER_DOCUMENT) -> DataFrame:
    """One JSON document per row: the nodes of a room with what stands in it, or a slice of them; nodes outside rooms by layer."""
    have = nodes.columns
    placed = nodes.join(room_of(nodes).withColumnRenamed("room", "_room"), "id", "left")
    placed = placed.withColumn("_tree", F.coalesce("_room", F.col("layer")))
    slices = placed.groupBy("_tree").agg(F.ceil(F.count(F.lit(1)) / per_document).alias("_slices"))
    dealt = placed.join(slices, "_tree").withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices")))
    number = lambda c: (F.col(f"`{c}`") if c in have else F.lit(None)).cast(_NUMBERS[c]).alias(c)
    body = F.struct(
        "id", "layer", "label", F.when(F.col("layer") == "object", F.col("label")).alias("name"), "parent", F.col("seq").cast("bigint").alias("seq"),
        F.array(*XYZ).alias("pos"), *[number(c) for c in _NUMBERS], _triple("min_", XYZ, have).alias("bbox_min_m"),
        _triple("max_", XYZ, have).alias("bbox_max_m"), _triple("shape_", ["0", "1", "2"], have).alias("shape"))
    # Sorted by seq, the order in which a reader sees the nodes.
    docs = dealt.groupBy("_tree", "_slice").agg(F.sort_array(F.collect_list(F.struct("seq", body.alias("body")))).alias("rows"))
    header = [F.lit(stamp_sec).cast("bigint").alias("stamp_sec"), F.lit(cycle).cast("bigint").alias("cycle"), F.lit(id_counter).cast("bigint").alias("id_counter"),
              F.lit(frame).alias("frame"), F.lit("vxw_yup").alias("coords")]
    return docs.select(F.to_json(F.struct(*header, F.transform("rows", lambda r: r["body"]).alias("nodes"))).alias("value"))


def write_scene_graph(nodes: DataFrame, folder: str, **header) -> None:
    scene_documents(nodes, **header).write.mode("overwrite").text(folder)


def parse_scene_documents(texts: DataFrame, col: str = "value") -> DataFrame:
    """Node rows of documents: the columns of the scene graph's node table.

    Without ``seq`` nodes are numbered by their place in their document.  A document that is not JSON raises an error.
    """
    doc = texts.select(F.from_json(col, DOCUMENT, {"mode": "FAILFAST"}).alias("d")).where(F.col("d").isNotNull())
    rows = doc.select(F.posexplode("d.nodes").alias("place", "n"))
    own = lambda f: F.coalesce(F.col(f"n.{f}"), F.col(f"n.attrs.{f}"))
    pos = F.coalesce("n.pos", "n.pos_m")
    out = [F.coalesce("n.seq", F.col("place").cast("bigint")).alias("seq"), F.col("n.id").alias("id"), F.col("n.layer").alias("layer"),
           F.coalesce("n.label", "n.name", F.lit("")).alias("label"), *[F.get(pos, F.lit(i)).alias(a) for i, a in enumerate(XYZ)], F.col("n.parent").alias("parent"),
           F.coalesce("n.class", "n.attrs.class", "n.attrs.label_id").alias("class")]
    out += [own(c).alias(c) for c in _NUMBERS if c != "class"]
    out += [F.get(own(f"bbox_{side}_m"), F.lit(i)).alias(f"{side}_{a}") for side in ("min", "max") for i, a in enumerate(XYZ)]
    out += [F.get(own("shape"), F.lit(i)).alias(f"shape_{i}") for i in range(3)]
    return rows.select(*out).select(*NODE_COLS, *OBJECT_COLS)


def read_scene_graph(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Nodes of a folder of documents, one per line; ``whole``: every file is one (indented) document."""
    return parse_scene_documents(spark.read.text(path, wholetext=whole))


# ---------------------------------------------------------------- change logs
def _legend(deltas: DataFrame, name: str, limit: int) -> DataFrame:
    """(kind, id, name): names numbered by their first use, ties by name; more than ``limit`` are refused."""
    first = deltas.groupBy(name).agg(F.min("seq").alias("_first"))
    found = [r[name] for r in first.orderBy("_first", name).limit(limit + 1).collect()]  # names of rules, few by the format
    if len(found) > limit:
        raise ValueError(f"a change log names at most {limit} {name}s")
    rows = [(name, i, n) for i, n in enumerate(found)]
    return deltas.sparkSession.createDataFrame(rows, "kind string, id int, name string")


def write_overlay(deltas: DataFrame, folder: str) -> None:
    """Store a change log (seq, x, y, z, op, sem, generator, binding) under ``folder``: voxels and legends."""
    good = check_changes(deltas)
    legends = _legend(deltas, "generator", GENERATORS).union(_legend(deltas, "binding", BINDINGS))
    named = lambda kind: F.broadcast(legends.where(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("id").alias(f"{kind}_id")))
    rows = good.join(named("generator"), "generator").join(named("binding"), "binding")
    op = F.array_position(F.array(*[F.lit(o) for o in OPS]), F.col("op")) - 1
    rows.select("seq", *XYZ, op.cast("tinyint").alias("op"), F.col("sem").cast("smallint").alias("sem"), F.col("generator_id").alias("gen_id"),
                F.col("binding_id").alias("bind_id")).write.mode("overwrite").parquet(f"{folder}/voxels")
    legends.coalesce(1).write.mode("overwrite").parquet(f"{folder}/legends")


def read_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """The change log of :func:`write_overlay`."""
    rows = spark.read.parquet(f"{folder}/voxels")
    legends = spark.read.schema("kind string, id int, name string").parquet(f"{folder}/legends")
    for kind, number in (("generator", "gen_id"), ("binding", "bind_id")):
        names = legends.where(F.col("kind") == kind).select(F.col("id").alias(number), F.col("name").alias(kind))
        rows = rows.join(F.broadcast(names), number)
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), F.col("op").cast("int") + 1)
    return rows.select("seq", *XYZ, op.alias("op"), F.col("sem").cast("int").alias("sem"), "generator", "binding")


def overlay_archives(files: DataFrame) -> DataFrame:
    """path, seq, x, y, z, op, sem, generator, binding of change logs stored as array archives: rows of (path, content, legend).

    ``content`` is the archive of idx, op, sem, gen_id and bind_id, ``legend`` the JSON text beside it; seq is the place in the archive.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content, legend in zip(frame["path"], frame["content"], frame["legend"]):
                names = json.loads(legend)
                generators, bindings = ({int(k): v for k, v in names[kind].items()} for kind in ("gen_legend", "bind_legend"))
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    idx = held["idx"].reshape(-1, 3).astype(np.int64)
                    if not len(idx):
                        continue
                    yield pd.DataFrame({
                        "path": [path] * len(idx), "seq": np.arange(len(idx)), "x": idx[:, 0], "y": idx[:, 1], "z": idx[:, 2],
                        "op": [OPS[o] for o in held["op"].tolist()], "sem": held["sem"].astype(np.int32),
                        "generator": [generators[g] for g in held["gen_id"].tolist()], "binding": [bindings[b] for b in held["bind_id"].tolist()]})

    schema = "path string, seq long, x long, y long, z long, op string, sem int, generator string, binding string"
    return files.select("path", "content", "legend").mapInPandas(run, schema)
