"""Helpers of the training-data operators: staged tables and distributed running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxhive.session import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def running_total(df: DataFrame, group: str, order: list[str], weight: str, out: str, n: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over earlier rows of the same ``group`` (own row excluded).

    A group may hold any share of the rows: the table is cut into ranges of
    (group, order), ranges are summed, and only the (range, group) sums meet in one
    window.  ``group`` must not be null; ``order`` must tell rows apart.
    """
    n = n or partitions(df.sparkSession)
    cut = df.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id())
    cut = stage(cut, "ranges")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        cut.groupBy("_range", group).agg(F.sum(weight).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .select(F.col("_range").alias("_range_of"), F.col(group).alias("_group_of"), "_before")
    )
    inside = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(sums, (F.col("_range") == F.col("_range_of")) & (F.col(group) == F.col("_group_of")))
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_range", "_range_of", "_group_of", "_before", "_inside")
    )


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """``needed`` columns with all others in a struct, and the expressions that bring the columns of ``docs`` back.

    What an operator adds on its way cannot clash with a column that it only passes on.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    rows = docs.select(*needed, F.struct(*(rest or [F.lit(0).alias("none")])).alias("_rest"))
    return rows, [F.col(c) if c in needed else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns]


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
