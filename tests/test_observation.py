import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxhive.operators import observation as ob


def points(spark, rows):
    """rows: frame, origin, point, label"""
    data = [(f, i, *map(float, o), *map(float, p), l, *c) for i, (f, o, p, l, c) in enumerate(rows)]
    return spark.createDataFrame(data, "frame_seq bigint, row_seq bigint, ox double, oy double, oz double, px double, py double, pz double, label int, r int, g int, b int")


def shot(frame, x, label=0, colour=(0, 0, 0), origin=(0.5, 2.5, 2.5)):
    return frame, origin, (x, 2.5, 2.5), label, colour


def as_map(df):
    return {(r["x"], r["y"], r["z"]): r for r in df.collect()}


def test_single_ray_marks_end_and_path(spark):
    got = as_map(ob.integrate_frames(points(spark, [shot(0, 15.5)]), 1.0, margin=1.0))
    assert got[15, 2, 2]["logodds"] >= np.float32(0.85)
    assert got[5, 2, 2]["logodds"] <= np.float32(-0.4)


def test_passing_rays_clear_an_occupied_cell(spark):
    rows = [shot(0, 8.5)] + [shot(1 + i, 18.5) for i in range(20)]
    obs = ob.integrate_frames(points(spark, rows), 1.0, margin=1.0, segment=6)
    assert as_map(obs)[8, 2, 2]["logodds"] == np.float32(-2.0)
    assert (8, 2, 2) in {(r.x, r.y, r.z) for r in ob.observed_free(obs).collect()}


@pytest.mark.parametrize("votes, winner", [((3, 3, 7, 3), 3), ((3, 7, 9, 7, 7), 7), ((0, 0, 4), 4)])
def test_streaming_majority(spark, votes, winner):
    obs = ob.integrate_frames(points(spark, [shot(i, 8.5, v) for i, v in enumerate(votes)]), 1.0, margin=1.0, segment=2)
    assert as_map(obs)[8, 2, 2]["sem_label"] == winner


def test_mean_colour(spark):
    obs = as_map(ob.integrate_frames(points(spark, [shot(0, 8.5, 0, (100, 0, 0)), shot(1, 8.5, 0, (200, 0, 0))]), 1.0, margin=1.0))
    assert obs[8, 2, 2]["rgb_count"] == 2 and abs(obs[8, 2, 2]["r"] - 150) <= 1
    assert obs[3, 2, 2]["rgb_count"] == 0


def brute(rows, margin=0.1):
    """Frame by frame, cell by cell, in single precision."""
    odds, votes, colour = {}, {}, {}
    frames = {}
    for r in rows:
        frames.setdefault(r[0], []).append(r)
    for frame in sorted(frames):
        missed, hit, shades = set(), set(), {}
        for _, o, p, label, rgb in frames[frame]:
            o, p = np.array(o, float), np.array(p, float)
            d = p - o
            length = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
            if length <= margin:
                continue
            step = 0
            while step < length - margin:
                missed.add(tuple(np.floor(o + step * (d / length)).astype(int)))
                step += 1
            end = tuple(np.floor(p).astype(int))
            hit.add(end)
            shades.setdefault(end, []).append(rgb)
            if label:
                kind, n = votes.get(end, (0, 0))
                votes[end] = (kind, n + 1) if kind == label else ((label, 1) if n == 0 else (kind, n - 1))
        for cell in missed | hit:
            v = np.float32(odds.get(cell, 0))
            v = np.float32(v + np.float32(-0.4)) if cell in missed else v
            v = np.float32(v + np.float32(0.85)) if cell in hit else v
            odds[cell] = min(max(v, np.float32(-2)), np.float32(3.5))
        for cell, seen in shades.items():
            mean = np.array(seen, float).sum(0) / len(seen)
            *cur, n = colour.get(cell, (0, 0, 0, 0))
            cur = np.array(cur, float)
            colour[cell] = (*np.clip(np.rint(cur + (mean - cur) / (n + 1)), 0, 255).astype(int), min(n + 1, 255))
    return {c: (float(v), *votes.get(c, (0, 0)), *map(int, colour.get(c, (0, 0, 0, 0)))) for c, v in odds.items()}


@pytest.fixture(scope="module")
def random_rows():
    rng = np.random.default_rng(0)
    return [(f, (3.0, 3.0, 3.0), tuple(rng.random(3) * 6), int(rng.integers(0, 4)), tuple(int(v) for v in rng.integers(0, 256, 3)))
            for f in range(40) for _ in range(15)]


@pytest.mark.parametrize("segment", [1024, 7])
def test_fold_equals_brute_force(spark, random_rows, segment):
    obs = ob.integrate_frames(points(spark, random_rows), 1.0, segment=segment)
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in obs.collect()} == brute(random_rows)


def test_resume_equals_one_go(spark, random_rows):
    pts = points(spark, random_rows)
    first = ob.integrate_frames(pts.where("frame_seq < 20"), 1.0)
    second = ob.integrate_frames(pts.where("frame_seq >= 20"), 1.0, prior=first, segment=8)
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in second.collect()} == brute(random_rows)


@pytest.fixture(scope="module")
def long_rows():
    """Rays over many blocks and pieces, crowded cells, and points without a number, colour, label or frame."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 30)), tuple(rng.random(3) * 20 - 10), tuple(rng.random(3) * 160 - 80), int(rng.integers(0, 4)),
             tuple(int(v) for v in rng.integers(0, 256, 3))) for _ in range(150)]
    return rows + [(int(rng.integers(0, 30)), (1.5, 1.5, 1.5), (3.5, 3.5, 3.5 + i % 2), int(rng.integers(0, 4)), (i, 0, 255)) for i in range(150)]


def test_rays_fold_in_blocks(spark, long_rows, monkeypatch):
    """The shuffle carries rays: no (frame, cell) rows are made."""
    def refuse(*args, **named):
        raise AssertionError("every crossed cell went through the shuffle")

    monkeypatch.setattr(ob, "frame_evidence", refuse)
    monkeypatch.setattr(ob.rayfold, "FLUSH", 64)
    pts = points(spark, long_rows)
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in ob.integrate_frames(pts, 1.0).collect()} == brute(long_rows)
    first = ob.integrate_frames(pts.where("frame_seq < 9"), 1.0)
    second = ob.integrate_frames(pts.where("frame_seq >= 9"), 1.0, prior=first, segment=4)
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in second.collect()} == brute(long_rows)


@pytest.mark.parametrize("segment", [1024, 7])
def test_blocks_equal_segments_with_nulls(spark, long_rows, monkeypatch, segment):
    gap = lambda c, n: F.when(F.col("row_seq") % n != 0, F.col(c)).alias(c)
    pts = points(spark, long_rows).select(
        gap("frame_seq", 11), "ox", "oy", "oz", gap("px", 13), "py", "pz", gap("label", 5), gap("r", 7), gap("g", 3), "b",
        F.when(F.col("row_seq") % 4 != 0, F.col("row_seq")).alias("row_seq"))
    blocks = sorted(map(tuple, ob.integrate_frames(pts, 0.7, segment=segment).collect()))
    monkeypatch.setattr(ob, "CROWD", 0)
    assert blocks == sorted(map(tuple, ob.integrate_frames(pts, 0.7, segment=segment).collect()))


def test_stateful_stream_matches_batch(spark, tmp_path):
    from voxhive.streaming.maps import stateful_log_odds

    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 5)), 0, 0, f, int(rng.integers(0, 2)), int(rng.integers(0, 2)), int(rng.integers(0, 3))) for f in range(200)]
    schema = "x bigint, y bigint, z bigint, frame_seq bigint, miss int, hit int, label int"
    for part in range(2):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful_log_odds(stream).writeStream.outputMode("update").format("memory").queryName("cells_out").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    latest = {}
    for r in spark.sql("SELECT * FROM cells_out").collect():
        latest[r["x"]] = r
    want = {}
    for x, _, _, _, m, h, l in rows:
        v, kind, n = want.get(x, (np.float32(0), 0, 0))
        v = np.float32(v + np.float32(-0.4)) if m else v
        v = np.float32(v + np.float32(0.85)) if h else v
        v = min(max(v, np.float32(-2)), np.float32(3.5))
        if h and l:
            kind, n = (kind, n + 1) if kind == l else ((l, 1) if n == 0 else (kind, n - 1))
        want[x] = (v, kind, n)
    assert {k: (np.float32(r["logodds"]), r["sem_label"]) for k, r in latest.items()}.keys() == want.keys()
    assert sum(latest[k]["sem_label"] == want[k][1] for k in want) == len(want)
