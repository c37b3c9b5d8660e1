"""Label spaces, colour tables, block maps, item packs and exported scene graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Object categories of exported scene graphs -> material id.
CATEGORY_MATERIAL = {
    "chair": 4, "armchair": 4, "stool": 4, "office_chair": 4, "table": 5, "desk": 5, "coffee_table": 5,
    "couch": 6, "sofa": 6, "bed": 7, "tv_monitor": 8, "monitor": 8, "tv": 8, "screen": 8, "computer": 8,
    "lamp": 9, "light": 9, "ceiling_light": 9, "potted_plant": 10, "plant": 10, "flower": 10,
    "window": 11, "glass": 11, "wall": 1, "floor": 2, "carpet": 2, "rug": 2, "ceiling": 1, "door": 3,
    "cabinet": 3, "shelves": 3, "bookshelf": 3, "cupboard": 3,
}
# Block names that mean empty space.
AIR_BLOCKS = ("air", "cave_air", "void_air", "structure_void")


def category_material(category: Column, table: dict[str, int] = CATEGORY_MATERIAL, default: int = 1) -> Column:
    """Exact category first, then the first listed word it contains."""
    name = F.trim(F.lower(category))
    exact = F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), name)
    partial = F.coalesce(*[F.when(F.contains(name, F.lit(word)), F.lit(mat)) for word, mat in table.items()])
    return F.coalesce(exact, F.when(name != "", partial), F.lit(default))


def parse_label_space(text: str) -> tuple[dict[int, str], dict[str, set[int]]]:
    """Class names and the id sets (structure, surface, invalid) of a label space file."""
    import yaml

    doc = yaml.safe_load(text) or {}
    names = {int(item["label"]): str(item["name"]) for item in doc.get("label_names", [])}
    sets = {key: {int(v) for v in doc.get(key, [])} for key in ("surface_places_labels", "invalid_labels", "dynamic_labels", "object_labels")}
    return names, sets


def label_space(spark: SparkSession, path: str) -> DataFrame:
    """Label space as a dimension table."""
    from voxhive.functions.labels import is_structure_name

    with open(path, encoding="utf-8") as src:
        names, sets = parse_label_space(src.read())
    rows = [(k, v, k in sets["surface_places_labels"], k in (sets["invalid_labels"] or {0})) for k, v in names.items()]
    table = spark.createDataFrame(rows, "label int, name string, is_surface boolean, is_invalid boolean")
    return table.withColumn("is_structure", is_structure_name("name"))


def colour_table(spark: SparkSession, path: str) -> DataFrame:
    """Colour-coded segmentation classes: packed colour key and class id."""
    from voxhive.functions.labels import packed_rgb

    raw = spark.read.option("header", True).schema(
        "name string, red int, green int, blue int, alpha int, id int").csv(path)
    return raw.select(packed_rgb("red", "green", "blue").alias("rgb"), F.col("id").alias("label"))


def block_material(block_id: Column, groups: dict[str, str], material_ids: dict[str, int]) -> Column:
    """Block state string to material id: air is 0, unknown blocks are stone (1)."""
    from voxhive.functions.labels import block_name, map_lookup

    name = block_name(block_id)
    material = map_lookup(material_ids, map_lookup(groups, name, "stone"), 1)
    return F.when(name.isin(*AIR_BLOCKS), F.lit(0)).otherwise(material)


# ---------------------------------------------------------------- exported scene graphs
_BOX = ("struct<dimensions:array<double>,extents:array<double>,world_P_center:array<double>,center:array<double>,"
        "min:array<double>,max:array<double>,world_R_center:struct<w:double,x:double,y:double,z:double>>")
_NODE = ("struct<id:string,symbol:string,layer:int,partition:int,attributes:struct<name:string,category:string,semantic_label:string,"
         f"position:array<double>,world_t_position:array<double>,color:struct<r:int,g:int,b:int>,bounding_box:{_BOX}>>")
GRAPH_SCHEMA = f"struct<layer_names:struct<OBJECTS:struct<layer:int,partition:int>>,nodes:array<{_NODE}>,layers:array<struct<nodes:array<{_NODE}>>>>"


def scene_graph_objects(texts: DataFrame, col: str = "value") -> DataFrame:
    """Object nodes of exported graphs (one JSON document per row).

    Accepts the flat and the layered layout and several box encodings; nodes with
    neither box nor position are dropped.
    """
    doc = texts.select(F.from_json(col, GRAPH_SCHEMA).alias("d"))
    layer = F.coalesce("d.layer_names.OBJECTS.layer", F.lit(2))
    part = F.coalesce("d.layer_names.OBJECTS.partition", F.lit(0))
    flat = F.filter("d.nodes", lambda n: (n["layer"] == layer) & (n["partition"] == part))
    nested = F.flatten(F.transform("d.layers", lambda l: l["nodes"]))
    rows = doc.select(F.explode(F.when(F.size(flat) > 0, flat).otherwise(nested)).alias("n"))
    a, box = F.col("n.attributes"), F.col("n.attributes.bounding_box")
    dims = F.coalesce(box["dimensions"], box["extents"])
    mid = F.coalesce(box["world_P_center"], box["center"], a["position"])
    low, high = [], []
    for i in range(3):
        half, centre = F.get(dims, F.lit(i)) * 0.5, F.get(mid, F.lit(i))
        low.append(F.coalesce(centre - half, F.get(box["min"], F.lit(i))))
        high.append(F.coalesce(centre + half, F.get(box["max"], F.lit(i))))
    position = F.coalesce(a["position"], a["world_t_position"])
    out = rows.select(
        F.coalesce("n.id", "n.symbol").alias("id"), F.coalesce(a["name"], F.lit("")).alias("name"),
        F.lower(F.trim(a["category"])).alias("category"), a["semantic_label"].try_cast("int").alias("semantic_label"),
        *[v.alias(f"min_{c}") for v, c in zip(low, "xyz")], *[v.alias(f"max_{c}") for v, c in zip(high, "xyz")],
        *[F.get(mid, F.lit(i)).alias(f"c{c}") for i, c in enumerate("xyz")],
        *[(F.get(dims, F.lit(i)) * 0.5).alias(f"h{c}") for i, c in enumerate("xyz")],
        *[box["world_R_center"][q].alias(f"q{q}") for q in "xyzw"], position.alias("position"), a["color"].alias("colour"))
    return out.where("min_x IS NOT NULL OR position IS NOT NULL")


# ---------------------------------------------------------------- item packs
_FACE = "struct<texture:string>"
MODEL_SCHEMA = f"struct<textures:map<string,string>,elements:array<struct<from:array<double>,to:array<double>,faces:map<string,{_FACE}>>>>"


def resolve_texture(name: Column, textures: Column) -> Column:
    """Follow ``#key`` references; cycles and dead ends give block/missing.

    A chain without a cycle visits no key twice, so as many steps as there are keys suffice.
    """
    missing = F.lit("block/missing")
    keys = F.coalesce(F.map_keys(textures), F.array().cast("array<string>"))
    follow = lambda at, _: F.when(
        at.startswith("#"), F.coalesce(F.try_element_at(textures, F.substr(at, F.lit(2))), missing)).otherwise(at)
    out = F.aggregate(keys, F.coalesce(name, F.lit("")), follow)
    return F.when(out.startswith("#"), missing).otherwise(out)


def item_boxes(models: DataFrame, col: str = "value") -> DataFrame:
    """Boxes of block models in metres around the model centre (16 units = 1 m).

    Input: item_id and the model JSON; output one row per box and face.
    """
    doc = models.select("item_id", F.from_json(col, MODEL_SCHEMA).alias("d"))
    el = doc.select("item_id", F.col("d.textures").alias("textures"), F.posexplode("d.elements").alias("box", "e"))
    for i, c in enumerate("xyz"):
        f, t = F.get("e.from", F.lit(i)), F.get("e.to", F.lit(i))
        el = el.withColumn(f"lo_{c}", F.least(f, t)).withColumn(f"hi_{c}", F.greatest(f, t))
    whole = el.groupBy("item_id").agg(*[(F.min(f"lo_{c}") + F.max(f"hi_{c}")).alias(f"s_{c}") for c in "xyz"],
                                      *[((F.max(f"hi_{c}") - F.min(f"lo_{c}")) / 16.0).alias(f"extent_{c}") for c in "xyz"])
    out = el.join(whole, "item_id")
    metres = [((F.col(f"{s}_{c}") - F.col(f"s_{c}") / 2) / 16.0).alias(f"{n}_{c}") for s, n in (("lo", "min"), ("hi", "max")) for c in "xyz"]
    faces = out.select("item_id", "box", *metres, *[f"extent_{c}" for c in "xyz"], "textures", F.explode_outer("e.faces").alias("face", "f"))
    return faces.withColumn("texture", resolve_texture(F.col("f.texture"), F.col("textures"))).drop("f", "textures")
