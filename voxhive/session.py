"""Session helpers: lineage cuts and small-side checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Largest side that may be sent to every executor, in rows of a few numbers.
BROADCAST_ROW_LIMIT = 1_000_000


def local_session(app: str = "voxhive", cores: int = 8, **conf: str) -> SparkSession:
    """Session used by the tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="voxhive-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage.

    Iterative operators call this once per round. Reliable checkpoints survive
    the loss of executors, unlike executor-local ones.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only after counting that the side really is small."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def by_sorting(df: DataFrame) -> DataFrame:
    """Hint: join this side by sorting, never by a broadcast.

    Spark guesses tables that an ``explode``, a ``distinct`` over a small file or a
    kernel made far too small, and would send them whole through the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning for a Python kernel, at the configured parallelism.

    Adaptive execution merges shuffle partitions by bytes, which would run a
    compute-heavy kernel in one or two tasks; an explicit count keeps it parallel.
    The following ``groupBy(*keys)`` reuses this partitioning, so it costs no
    extra shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, *keys)
