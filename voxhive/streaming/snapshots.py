"""Count windows over streams: a result after every N frames, wherever the batches end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxhive.operators import observation as ob
from voxhive.streaming.maps import MapUpdater

#: Frames of a snapshot; 50 in the slow cycle, 10 for a view.
EVERY = 50


def count_windows(stream: DataFrame, key: str, order: str, values: tuple[str, ...] = (), every: int = EVERY) -> DataFrame:
    """key, window, first, last, frames and the sum of each of ``values`` for every ``every`` rows of a key.

    Rows of one trigger are taken by ascending ``order``; rows of later triggers follow.
    The state of a key is its count and the sums of the open window, so its size does not
    depend on ``every``.  An open window gives nothing.
    """
    names = [f"sum_{v}" for v in values]
    kind = stream.schema[key].dataType.simpleString()
    place = stream.schema[order].dataType.simpleString()
    sums = "".join(f", {n} double" for n in names)
    state = f"seen bigint, first {place}" + sums

    def step(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seen, first, *open_sums = held.get if held.exists else (0, None, *[0.0] * len(values))
        # One key's rows of one trigger; the trigger's size bounds them.
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        at = rows[order].to_numpy()
        numbers = seen + np.arange(len(rows))
        window = numbers // every
        ends = np.flatnonzero((numbers + 1) % every == 0)
        starts = np.concatenate([[0], ends + 1]).astype(int)
        totals = [np.add.reduceat(np.append(rows[v].fillna(0).to_numpy(float), 0.0), starts) for v in values]
        for total, before in zip(totals, open_sums):
            total[0] += before
        firsts = [first if k == 0 and seen % every else at[s] if s < len(at) else None for k, s in enumerate(starts)]
        if len(ends):
            out = pd.DataFrame({
                key: [group[0]] * len(ends), "window": window[ends], "first": firsts[:len(ends)], "last": at[ends],
                "frames": np.full(len(ends), every), **{n: t[:len(ends)] for n, t in zip(names, totals)}})
            yield out
        rest = [float(t[-1]) for t in totals]
        opened = firsts[-1]
        held.update((int(seen + len(rows)), None if opened is None else opened.item() if hasattr(opened, "item") else opened, *rest))

    schema = f"{key} {kind}, window bigint, first {place}, last {place}, frames bigint" + sums
    return stream.select(key, order, *values).groupBy(key).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


class CountedMaps(MapUpdater):
    """``foreachBatch`` target: the map as of every ``every`` frames, beside its versions by batch.

    A batch is cut where a window ends; the map folded so far is written as snapshot
    ``s<window>``.  Counts are kept by batch id, like the versions, so a replayed batch
    writes the same snapshots again and no frame counts twice.
    """

    def __init__(self, folder: str, fold, every: int = EVERY, frame: str = "frame_seq"):
        super().__init__(folder, fold)
        self.every, self.frame = every, frame

    def snapshot(self, spark: SparkSession, window: int) -> DataFrame:
        return spark.read.schema(ob.OBS_SCHEMA).parquet(f"{self.folder}/s{window}")

    def frames_until(self, spark: SparkSession, batch_id: int) -> int:
        if batch_id < 0:
            return 0
        return spark.read.schema("frames long").parquet(f"{self.folder}/c{batch_id}").first()["frames"]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = self.frames_until(spark, batch_id - 1)
        batch.persist()
        try:
            frames = batch.select(self.frame).distinct()
            fresh = frames.count()
            prior = self.read(spark, batch_id - 1) if batch_id else None
            low = None
            for window in range(seen // self.every, (seen + fresh) // self.every):
                high = self._nth(frames, (window + 1) * self.every - seen)
                part = batch.where(F.col(self.frame) <= high)
                prior = self.fold(part if low is None else part.where(F.col(self.frame) > low), prior)
                prior.write.mode("overwrite").parquet(f"{self.folder}/s{window}")
                prior, low = self.snapshot(spark, window), high
            rest = batch if low is None else batch.where(F.col(self.frame) > low)
            self.fold(rest, prior).write.mode("overwrite").parquet(self.version(batch_id))
            spark.range(1).select(F.lit(seen + fresh).cast("long").alias("frames")).write.mode("overwrite").parquet(f"{self.folder}/c{batch_id}")
        finally:
            batch.unpersist()

    def _nth(self, frames: DataFrame, n: int) -> int:
        """The n-th smallest frame of the batch, from counts by range: no task sorts them all."""
        low, high = frames.agg(F.min(self.frame), F.max(self.frame)).first()
        while low < high:
            width = max(1, -(-(high - low + 1) // 64))
            slot = F.floor((F.col(self.frame) - low) / width).cast("long")
            counts = frames.where(F.col(self.frame).between(low, high)).groupBy(slot.alias("slot")).count().orderBy("slot").collect()  # 64 rows
            for row in counts:
                if n <= row["count"]:
                    low, high = low + row["slot"] * width, min(high, low + (row["slot"] + 1) * width - 1)
                    break
                n -= row["count"]
        return low
