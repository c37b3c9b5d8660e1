"""Exact near-duplicate join of embeddings: pivot cells, boundary replication by the triangle inequality.

Unit vectors have the metric |x - y| = sqrt(2 - 2 cos).  Every vector belongs to the
cell of its nearest pivot.  A partner within radius r that lives in cell p is at
most (own distance + 2 r), and at most (radius of p + r), from pivot p, so a vector
visits only the cells that pass both bounds.  Cells are dealt into blocks of bounded
size; a join unit is one block against the visitors from a few blocks, and units
run independently.  Identical vectors are joined once and counted with their copies;
a unit reports link counts and a spanning set of links, never all pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (and are their own component); vectors of different
length do not link; rows with a null id take part in nothing (null component);
repeated ids count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxhive.llm.common import stage
from voxhive.operators.blocks import min_label
from voxhive.operators.components import connected_components
from voxhive.session import spread

PIVOTS = 48
#: Bound of the sample that pivots are picked from.
PIVOT_SAMPLE = 2000
BLOCK = 4096
VISITING_BLOCKS = 4
STRIP = 256
#: Room for rounding in the bounds.
SLACK = 1e-6


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of float32 bytes, all of one length, as double unit vectors."""
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def pick_pivots(sample: list[bytes], count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Per vector length, pivots that lie far from each other (farthest-first over the sample)."""
    by_size: dict[int, list[bytes]] = {}
    for raw in sample:
        by_size.setdefault(len(raw) // 4, []).append(raw)
    picked = {}
    for size, rows in by_size.items():
        x = unit(rows)
        chosen, away = [0], distances(x, x[:1])[:, 0]
        while len(chosen) < min(count, len(x)) and away.max() > SLACK:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, distances(x, x[chosen[-1:]])[:, 0])
        picked[size] = x[chosen]
    return picked


class Layout:
    """Cells (length, pivot), their radii and the blocks that they are dealt into."""

    def __init__(self, pivots: dict[int, np.ndarray], cells: list[tuple[int, int, int, float]], radius: float, block: int):
        self.pivots, self.radius = pivots, radius
        self.size_of = [c[0] for c in cells]
        self.pivot_of = np.array([c[1] for c in cells], int)
        self.reach = np.array([c[3] for c in cells], float)
        self.blocks = np.array([-(-c[2] // block) for c in cells], int)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.cell_of_block = np.repeat(np.arange(len(cells)), self.blocks)
        self.number = {(c[0], c[1]): i for i, c in enumerate(cells)}

    def open_cells(self, size: int, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(n, cells): may the cell hold a partner of the vector?"""
        mine = np.array([s == size for s in self.size_of], bool)
        allowed = np.broadcast_to(mine, (len(x), len(mine))).copy()
        if size in self.pivots:
            away = distances(x, self.pivots[size])[:, self.pivot_of[mine]]
            bound = np.minimum(own[:, None] + 2 * self.radius, self.reach[mine][None, :] + self.radius) + SLACK
            allowed[:, mine] = away <= bound
        return allowed


def join_unit(home: np.ndarray, home_copies: np.ndarray, guest: np.ndarray, guest_copies: np.ndarray, least: float,
              within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Link counts (copies included) and component labels over home then guest vectors."""
    n = len(home)
    links = np.zeros(n + len(guest), np.int64)
    label = np.arange(n + len(guest))

    def note(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        if not len(i):
            return
        copies = np.concatenate([home_copies, guest_copies])
        links[:] += np.bincount(i, copies[j], len(links)).astype(np.int64)
        links[:] += np.bincount(j, copies[i], len(links)).astype(np.int64)
        pairs = np.unique(label[i] * len(label) + label[j])
        label = min_label(len(label), pairs // len(label), pairs % len(label))[label]

    for at in range(0, n, STRIP):
        strip = home[at:at + STRIP]
        if len(guest):
            i, j = np.nonzero(strip @ guest.T >= least)
            note(i + at, j + n)
        if within:
            i, j = np.nonzero(strip @ home[at:].T >= least)
            later = j > i
            note(i[later] + at, j[later] + at)
    return links, label


def near_vectors(vectors: DataFrame, least: float = 0.95, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    number = F.col("embedding").cast("array<double>")
    finite = F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate(number, F.lit(0.0), lambda a, v: a + v * v)
    valid = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & (norm > 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), valid.alias("valid"))
    classes = stage(
        rows.where("valid").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes",
    )

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, np.float32).tobytes() for x in v], dtype=object)

    raw = classes.select("cls", "copies", packed("embedding").alias("raw"))
    sample = raw.orderBy(F.xxhash64("raw"), "raw").limit(PIVOT_SAMPLE).collect()
    chosen = pick_pivots([bytes(r["raw"]) for r in sample], pivots)
    radius = float(np.sqrt(2 - 2 * least))

    @F.pandas_udf("length int, pivot int, own double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"length": v.map(len) // 4, "pivot": 0, "own": 0.0})
        for size, at in out.groupby("length").groups.items():
            if size in chosen:
                away = distances(unit(v[at].tolist()), chosen[size])
                out.loc[at, "pivot"] = away.argmin(axis=1)
                out.loc[at, "own"] = away.min(axis=1)
        return out

    homed = stage(raw.withColumn("c", nearest("raw")).select("cls", "copies", "raw", "c.*"), "homed")
    cells = homed.groupBy("length", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("reach")).collect()
    layout = Layout(chosen, sorted((r["length"], r["pivot"], r["n"], r["reach"]) for r in cells), radius, block)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector at home, once for every group of visitors, and as a visitor in later blocks."""
        for frame in frames:
            cell = np.array([layout.number[k] for k in zip(frame["length"], frame["pivot"])], int)
            own_block = layout.first[cell] + frame["mark"].to_numpy() % layout.blocks[cell]
            for size, at in frame.groupby("length").indices.items():
                part, mine = frame.iloc[at], own_block[at]
                open_to = layout.open_cells(int(size), unit(part["raw"].tolist()), part["own"].to_numpy())
                base = part[["cls", "copies", "raw"]]
                for k in np.flatnonzero(np.array([layout.size_of[c] == size for c in layout.cell_of_block], bool)):
                    home = mine == k
                    if home.any():
                        for g in range(k // VISITING_BLOCKS + 1):
                            yield base[home].assign(block=k, visitors=g, home=True)
                    comes = open_to[:, layout.cell_of_block[k]] & (mine < k)
                    if comes.any():
                        yield base[comes].assign(block=k, visitors=mine[comes] // VISITING_BLOCKS, home=False)

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("home", ascending=False, kind="stable")
        n = int(frame["home"].sum())
        own = key[0] // VISITING_BLOCKS == key[1]
        if not n or (len(frame) == n and not own):
            return pd.DataFrame({"cls": [], "links": [], "root": []})
        x, copies = unit(frame["raw"].tolist()), frame["copies"].to_numpy(np.float64)
        links, label = join_unit(x[:n], copies[:n], x[n:], copies[n:], least, own)
        ids, linked = frame["cls"].to_numpy(), links > 0
        return pd.DataFrame({"cls": ids[linked], "links": links[linked], "root": ids[label[linked]]})

    marked = homed.withColumn("mark", F.pmod(F.xxhash64("cls"), F.lit(1 << 40)))
    dealt = marked.mapInPandas(deal, "cls long, copies long, raw binary, block int, visitors int, home boolean")
    found = stage(spread(dealt, "block", "visitors").groupBy("block", "visitors").applyInPandas(
        join, "cls long, links long, root long"), "links")

    counted = found.groupBy(F.col("cls").alias("l_cls")).agg(F.sum("links").alias("links"))
    parts = stage(connected_components(found.where("cls <> root"), "cls", "root", tail_edges=0), "components")
    grouped = classes.select("cls", "low").join(parts, F.col("cls") == F.col("node"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("lowest"))
    moved = grouped.join(lowest, "component").select(F.col("cls").alias("m_cls"), "lowest")
    # a table of its own, so that adaptive execution may split the join of a vector that many rows share
    told = stage(
        classes.join(counted, F.col("cls") == F.col("l_cls"), "left").join(moved, F.col("cls") == F.col("m_cls"), "left")
        .select(F.col("embedding").alias("vector"), F.coalesce("lowest", "low").alias("component_id"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labels",
    )
    linked = rows.where("valid").join(told, F.col("embedding") == F.col("vector")).select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
