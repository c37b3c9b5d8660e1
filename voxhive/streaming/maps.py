"""The observation map as a stream.

Two forms. ``MapUpdater`` folds micro-batches into versions of a stored map and
suits dense frames, where one frame touches thousands of cells.
``stateful_log_odds`` keeps one state per cell in the state store and emits every
change, for sparse evidence that must show at once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxhive.operators import observation as ob
from voxhive.operators.voxels import XYZ
from voxhive.session import ensure_checkpoint_dir

STATE = "logodds float, sem_label int, sem_count int"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` on whatever file system it names, or None where nothing is stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.parquet(path) if known else None


class MapUpdater:
    """``foreachBatch`` target: version n of the map = version n-1 folded with batch n.

    A version is a complete table named by its batch id. A batch that is replayed
    after a failure overwrites its own version only, so each frame counts once.
    """

    def __init__(self, folder: str, fold: Callable[[DataFrame, DataFrame | None], DataFrame]):
        self.folder = folder
        self.fold = fold

    def version(self, batch_id: int) -> str:
        return f"{self.folder}/v{batch_id}"

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(ob.OBS_SCHEMA).parquet(self.version(batch_id))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prior = self.read(spark, batch_id - 1) if batch_id else None
        self.fold(batch, prior).write.mode("overwrite").parquet(self.version(batch_id))


def map_from_points(voxel_size: float, margin: float = ob.FREE_MARGIN_M):
    """Fold for a stream of measured points."""
    return lambda batch, prior: ob.integrate_frames(batch, voxel_size, margin, prior)


def run_map_stream(stream: DataFrame, updater: MapUpdater, checkpoint: str, trigger: dict | None = None):
    """Start folding; returns the streaming query."""
    return (
        stream.writeStream.foreachBatch(updater).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stateful_log_odds(evidence: DataFrame) -> DataFrame:
    """Per-cell state over a stream of ``x, y, z, frame_seq, miss, hit, label``.

    Evidence of one trigger is applied in frame order. Emits the cells that
    changed (update mode), so a flip to free retracts an earlier occupied row.
    """
    hit, miss = np.float32(ob.L_HIT), np.float32(ob.L_MISS)
    low, high = np.float32(ob.L_MIN), np.float32(ob.L_MAX)

    def step(key, batches, state: GroupState):
        odds, label, count = state.get if state.exists else (0.0, 0, 0)
        odds = np.float32(odds)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("frame_seq", kind="stable")
        for m, h, vote in zip(rows["miss"], rows["hit"], rows["label"]):
            odds = odds + miss if m else odds
            odds = odds + hit if h else odds
            odds = min(max(odds, low), high)
            if h and vote:
                if vote == label:
                    count = min(count + 1, ob.COUNT_MAX)
                elif count == 0:
                    label, count = int(vote), 1
                else:
                    count -= 1
        state.update((float(odds), int(label), int(count)))
        yield pd.DataFrame({"x": [key[0]], "y": [key[1]], "z": [key[2]], "logodds": [odds], "sem_label": [label], "sem_count": [count]})

    return evidence.groupBy(*XYZ).applyInPandasWithState(
        step, f"x bigint, y bigint, z bigint, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def synchronise_streams(left: DataFrame, right: DataFrame, slop: str = "20 milliseconds", delay: str = "5 seconds") -> DataFrame:
    """Event-time pairing of two topics (column ``ts``), late data dropped after ``delay``."""
    l = left.withWatermark("ts", delay).alias("l")
    r = right.withWatermark("ts", delay).alias("r")
    return l.join(r, F.expr(f"r.ts BETWEEN l.ts - INTERVAL {slop} AND l.ts + INTERVAL {slop}"))


class SceneCycle:
    """``foreachBatch`` target of the slow cycle: latest map to merged scene graph.

    Scene versions are tables named by batch id, like the map's, in a folder on any file
    system. A cycle without a new scene stores the last one again, so object identity
    outlives batches in which too little is occupied. A replayed batch reads the version
    before it and overwrites its own.
    """

    def __init__(self, maps: MapUpdater, folder: str, voxel_size: float, names=None, config=None):
        self.maps, self.folder, self.voxel_size, self.names, self.config = maps, folder, voxel_size, names, config

    def version(self, batch_id: int) -> str:
        return f"{self.folder}/v{batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from voxhive.plans.jobs import TopologyConfig, update_scene

        spark = batch.sparkSession
        self.maps(batch, batch_id)
        scene = stored(spark, self.version(batch_id - 1)) if batch_id else None
        # counter ids of this cycle start in their own range
        scene, _ = update_scene(self.maps.read(spark, batch_id), scene, self.voxel_size, self.names,
                                self.config or TopologyConfig(), first_new=batch_id << 24)
        if scene is not None:
            scene.write.mode("overwrite").parquet(self.version(batch_id))


class LateRows(StreamingQueryListener):
    """Counts, per streaming query, the rows that came after the watermark and were dropped by a stateful operator.

    Add it with ``spark.streams.addListener``. ``dropped`` maps query ids to counts; it
    has one entry per query that reported, zero where nothing was late. Rows that an
    aggregation combined inside a task before the watermark met them count as one.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        key = str(event.progress.id)
        self.dropped[key] = self.dropped.get(key, 0) + late

    def onQueryTerminated(self, event) -> None:
        pass
