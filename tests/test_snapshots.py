"""Count windows: equal for every cut of the stream into batches."""

import random

import pytest

from voxhive.operators import observation as ob
from voxhive.streaming import snapshots as sn
from voxhive.streaming.maps import shared_folder

SCHEMA = "sensor string, seq bigint, v double"


def deliver(spark, rows, schema, cuts, run):
    """Write the rows as one file per batch and run the stream over them, one file a trigger."""
    folder = shared_folder(spark, "feed")
    for part in cuts:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return run(stream)


def collected(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", shared_folder(spark, name)).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


@pytest.mark.parametrize("number,sizes", [(0, [97]), (1, [1, 3, 40, 53]), (2, [30, 30, 37])])
def test_windows_do_not_depend_on_batches(spark, number, sizes):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, float(rng.randrange(100)) if rng.random() < 0.9 else None) for i in range(97)]
    cuts, at = [], 0
    for size in sizes:
        part = list(range(at, at + size))
        rng.shuffle(part)
        cuts.append(part)
        at += size
    got = deliver(spark, rows, SCHEMA, cuts, lambda s: collected(spark, sn.count_windows(s, "sensor", "seq", ("v",), 10), f"windows{number}"))
    want = []
    for key in "abc":
        own = [r for r in rows if r[0] == key]
        for w in range(len(own) // 10):
            part = own[10 * w:10 * w + 10]
            want.append((key, w, part[0][1], part[-1][1], 10, sum(r[2] or 0.0 for r in part)))
    assert got == sorted(want)


@pytest.mark.parametrize("sizes", [[23], [5, 1, 17], [9, 14]])
def test_maps_of_every_few_frames(spark, sizes):
    rng = random.Random(7)
    rows = [(f * 3 + 1, rng.randrange(3), rng.randrange(2), 0, k, 1 - k, 3) for f in range(23) for k in (0, 1)]
    schema = "frame_seq bigint, x bigint, y bigint, z bigint, miss int, hit int, label int"
    fold = lambda batch, prior: ob.fold_evidence(
        batch.selectExpr("frame_seq", "x", "y", "z", "miss", "hit", "cast(null as double) r", "cast(null as double) g", "cast(null as double) b"), prior=prior)
    folder = shared_folder(spark, "counted")
    maps = sn.CountedMaps(folder, fold, every=6)
    at = 0
    for batch_id, size in enumerate(sizes):
        part = [r for r in rows if at <= (r[0] - 1) // 3 < at + size]
        at += size
        table = spark.createDataFrame(part, schema)
        maps(table, batch_id)
        maps(table, batch_id)  # a replay changes nothing
    for window in range(3):
        whole = fold(spark.createDataFrame([r for r in rows if (r[0] - 1) // 3 < 6 * (window + 1)], schema), None)
        key = lambda df: sorted((r.x, r.y, r.z, round(r.logodds, 4)) for r in df.collect())
        assert key(maps.snapshot(spark, window)) == key(whole)
    assert maps.frames_until(spark, len(sizes) - 1) == 23
