"""The scene cycle keeps identity over batches on a file system named by URI, and late rows are counted."""

import datetime as dt
import time

from pyspark.sql import functions as F

from tests.test_snapshots import deliver
from voxhive.operators import observation as ob
from voxhive.plans import jobs
from voxhive.streaming import maps as mp

SCHEMA = "seq bigint, id string"


def fold(batch, prior):
    """A map of one cell a row; only the number of its rows matters here."""
    zero = {f.name: F.lit(0).cast(f.dataType) for f in batch.sparkSession.createDataFrame([], ob.OBS_SCHEMA).schema.fields}
    now = batch.select(*[c.alias(n) for n, c in zero.items()])
    return now if prior is None else prior.union(now)


def test_identity_over_three_batches(spark, monkeypatch):
    seen = []

    def update_scene(obs, scene, voxel_size, names, config, first_new=0):
        known = sorted(r.id for r in scene.collect()) if scene is not None else None
        seen.append((obs.count(), known, first_new))
        if len(seen) == 2:  # too little is occupied: the scene stays as it is
            return scene, None
        ids = (known or []) + [f"object:{first_new}"]
        return spark.createDataFrame([(i,) for i in ids], "id string"), None

    monkeypatch.setattr(jobs, "update_scene", update_scene)
    folder = "file:" + mp.shared_folder(spark, "cycle").removeprefix("file:")
    cycle = mp.SceneCycle(mp.MapUpdater(f"{folder}/map", fold), f"{folder}/scene", 0.1)
    rows = [(i, "r") for i in range(6)]
    deliver(spark, rows, SCHEMA, [[0, 1, 2], [3], [4, 5]],
            lambda s: mp.run_map_stream(s, cycle, f"{folder}/progress").awaitTermination())
    assert seen == [(3, None, 0), (4, ["object:0"], 1 << 24), (6, ["object:0"], 2 << 24)]
    last = mp.stored(spark, cycle.version(2))
    assert sorted(r.id for r in last.collect()) == ["object:0", f"object:{2 << 24}"]
    assert mp.stored(spark, cycle.version(3)) is None


def test_late_rows_are_counted(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=s), s) for s in (0, 100, 200, 5, 6, 300)]
    late = mp.LateRows()
    spark.streams.addListener(late)
    try:
        def run(stream):
            counts = stream.withWatermark("ts", "10 seconds").groupBy(F.window("ts", "10 seconds")).count()
            query = counts.writeStream.format("memory").queryName("late_counts").outputMode("append").option(
                "checkpointLocation", mp.shared_folder(spark, "late")).trigger(availableNow=True).start()
            query.awaitTermination()
            return str(query.id)
        key = deliver(spark, rows, "ts timestamp, n bigint", [[0, 1], [2], [3, 4], [5]], run)
        deadline = time.time() + 20
        while late.dropped.get(key, 0) < 1 and time.time() < deadline:  # listeners hear with a delay
            time.sleep(0.2)
        time.sleep(0.5)
        # rows of one window meet in the task before the watermark is applied to them
        assert late.dropped[key] == 1
        assert spark.table("late_counts").agg(F.sum("count")).first()[0] == 3
    finally:
        spark.streams.removeListener(late)
