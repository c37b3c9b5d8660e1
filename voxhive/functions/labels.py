"""Label, colour and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that mark a class as building structure.
STRUCTURE_KEYWORDS = (
    "wall", "ceiling", "roof", "building", "floor", "ground", "carpet", "rug",
    "pillar", "column", "beam", "stair", "sky",
)

# Class ids of the default label space.
FLOOR_LABEL, CEILING_LABEL, STAIRS_LABEL, WALL_LABEL, HUMAN_LABEL = 3, 4, 15, 19, 20
STRUCTURE_LABELS = (FLOOR_LABEL, CEILING_LABEL, WALL_LABEL)
MODEL_LABELS = (1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 18)
ENTITY_LABELS = (5, 7, 10, 11, 14, 16, 18)
DYNAMIC_LABELS = (HUMAN_LABEL,)
SMALL_OBJECT_LABELS = (2, 6)

# Class id -> prebuilt item model.
ITEM_OF_LABEL = {5: "chair", 16: "table", 11: "lamp", 10: "computer", 14: "bed", 18: "trashcan"}


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_structure_name(name: Column | str, keywords: tuple[str, ...] = STRUCTURE_KEYWORDS) -> Column:
    return F.lower(_c(name)).rlike("|".join(keywords))


def map_lookup(mapping: dict, key: Column, default=None) -> Column:
    """Small fixed dictionary as an expression (no join, no shuffle)."""
    table = F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def _md5_byte(seed: Column, index: int) -> Column:
    return F.conv(F.substring(F.md5(seed), 2 * index + 1, 2), 16, 10).cast("int")


def hashed_colour(seed: Column, spread: int) -> Column:
    """Stable mid-bright RGB from a name."""
    return F.array(*[F.lit(60) + _md5_byte(seed, i) % F.lit(spread) for i in range(3)])


def label_colour(label: Column | str, observed: Column | None = None) -> Column:
    """Observed RGB if it is not black, otherwise a colour hashed from the label."""
    seed = F.concat(F.lit("sem_label_"), _c(label).cast("string"))
    hashed = hashed_colour(seed, 170)
    if observed is None:
        return hashed
    clipped = F.transform(observed, lambda c: F.least(F.lit(255), F.greatest(F.lit(0), c)).cast("int"))
    return F.when(F.exists(observed, lambda c: c > 0), clipped).otherwise(hashed)


def texture_fallback_colour(name: Column | str) -> Column:
    return hashed_colour(_c(name), 160)


def hsv_rgb(hue: Column, sat: float = 0.85, val: float = 0.95) -> Column:
    """HSV to 8-bit RGB, rounding half to even."""
    h = hue - F.floor(hue)
    sector = F.floor(h * 6.0)
    f = h * 6.0 - sector
    p = F.lit(val * (1.0 - sat))
    q = val * (1.0 - sat * f)
    t = val * (1.0 - sat * (1.0 - f))
    v = F.lit(val)
    table = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    s = sector.cast("int") % 6
    def channel(i: int) -> Column:
        out = F.lit(None).cast("double")
        for k, rgb in enumerate(table):
            out = F.when(s == k, rgb[i]).otherwise(out)
        return F.rint(out * 255).cast("int")
    return F.array(channel(0), channel(1), channel(2))


def golden_hue(label: Column | str) -> Column:
    """Display hue (degrees) spread by the golden angle."""
    return (_c(label) * F.lit(137.508)) % F.lit(360.0)


def uuid_from(seed: Column) -> Column:
    """md5 of a seed printed in uuid shape."""
    h = F.md5(seed)
    parts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def cluster_material(label: Column | str, include_noise: bool) -> Column:
    """Cluster number to material id; the last id is shared past the palette's end."""
    col = _c(label)
    base = 2 if include_noise else 1
    return F.when(col < 0, F.lit(1 if include_noise else 0)).otherwise(
        F.lit(base) + F.least(col, F.lit(256 - base - 1))
    ).cast("smallint")


def packed_rgb(r, g, b) -> Column:
    """24-bit colour key."""
    red, green, blue = (_c(c).cast("int") for c in (r, g, b))
    return F.shiftleft(red, 16).bitwiseOR(F.shiftleft(green, 8)).bitwiseOR(blue)


def block_name(block_id: Column | str) -> Column:
    """``minecraft:name[state]`` to ``name``."""
    stripped = F.regexp_replace(_c(block_id), "^minecraft:", "")
    return F.regexp_replace(stripped, r"\[.*$", "")
