"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Every source has a share of the token budget and a weight that runs linearly from
a start to an end value over the training time [0, 1].  The integral of the weight,
scaled to the source's target, is its cumulative demand; a document that begins
after ``c`` tokens of its source stands at the time when the demand reaches ``c``.
Documents are then range-sorted by that time.

Units are (doc_id, source, size): repeated rows share one plan.  Edge cases: a null
text has size 0; null sources are one source, last in order; a source without words
has target 0; ties in the keyed order fall to doc_id, then size; whole documents are
taken, so a source misses its target by at most half of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxhive.llm.common import running_total, set_aside, stage, word_count

WEIGHTS = (5, 2, 1)
#: (start, end) weight of each rank modulo three: the largest share fades, the smallest grows.
SCHEDULES = ((2.0, 1.0), (1.0, 1.0), (1.0, 3.0))
BUDGET_PERCENT = 150
MOST_REPEATS = 2


def demand_time(taken: Column, target: Column, start: Column, end: Column) -> Column:
    """Time at which a source's cumulative demand reaches ``taken`` tokens (inverse of the integral)."""
    area = F.least(taken / target, F.lit(1.0)) * (start + end) / 2
    return 2 * area / (start + F.sqrt(start * start + 2 * (end - start) * area))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(_g, source_size, target, start, end) per source from (_g, size) rows; water filling under the repeat cap.

    Each round is one sum over the source table; rounds end when no source is above its cap.
    """
    sources = sizes.groupBy("_g").agg(F.sum("weight").alias("source_size")).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    ranked = running_total(sources, "_all", ["_g"], "_one", "rank")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % 3 + 1).cast("int"))
    ranked = stage(ranked.select(
        "_g", "source_size", pick(WEIGHTS).alias("w"), (MOST_REPEATS * F.col("source_size")).alias("cap"),
        pick([s for s, _ in SCHEDULES]).alias("start"), pick([e for _, e in SCHEDULES]).alias("end"),
    ), "sources")
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * BUDGET_PERCENT / 100
    rate, full = 0.0, -1
    while True:
        above = F.col("w") * F.lit(rate) > F.col("cap")
        row = ranked.agg(
            F.count(F.when(above, 1)).alias("full"), F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("held"),
            F.sum(F.when(~above, F.col("w")).otherwise(0)).alias("open"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, rate = row["full"], (budget - row["held"]) / row["open"]
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(rate)))


def plan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per (doc_id, source, size) with source_size, target, copies and the training time of each copy."""
    name = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    units = stage(
        docs.select("doc_id", "source", name.alias("_g"), word_count(F.col(text)).alias("size"))
        .groupBy("doc_id", "source", "_g", "size").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("weight", F.col("size") * F.col("n"))
        .withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "units",
    )
    targets = source_targets(units)
    placed = running_total(units, "_g", ["mark", "doc_id", "size"], "weight", "before")
    joined = placed.join(targets, "_g")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    extra = (2 * F.col("before") + F.col("weight") <= 2 * rest) & (F.col("passes") < MOST_REPEATS)
    middle = F.col("before") + F.col("weight") / 2
    time = lambda copy: demand_time(
        copy * F.col("source_size") + middle, F.col("target"), F.col("start"), F.col("end")
    )
    return (
        joined.withColumn("passes", passes)
        .withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + extra.cast("long")).otherwise(0))
        .withColumn("positions", F.when(
            F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), time)
        ))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "positions")
    )


def _with_plan(docs: DataFrame, planned: DataFrame, size: Column) -> DataFrame:
    """Give each row the plan of its unit."""
    keys = planned.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "copies", "positions")],
    )
    return docs.join(
        keys, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (size == F.col("_size"))
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """One row per document with the words the mix takes, range-sorted by its first training time (not taken: last)."""
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    met = _with_plan(rows, plan(docs), F.col("size"))
    first = F.coalesce(F.col("_positions")[0], F.lit(2.0))
    return met.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("size")).cast("long").alias("taken"), first.alias("_at"),
    ).repartitionByRange("_at", "doc_id").sortWithinPartitions("_at", "doc_id").drop("_at")


def training_stream(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, repeats as rows, with the columns of ``docs``."""
    taken = stage(plan(docs).where("copies > 0"), "plan")
    rows, columns = set_aside(docs, "doc_id", "source", "text")
    met = _with_plan(rows.withColumn("words", word_count(F.col("text"))), taken, F.col("words"))
    stream = met.select("doc_id", "source", "text", "_rest", F.explode("_positions").alias("at"))
    return stream.repartitionByRange("at", "doc_id").sortWithinPartitions("at", "doc_id").select(*columns)


#: The same rows in DuckDB: word counts, targets by the first consistent number of full sources, keyed order.
ROWS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, rank) AS k, sum(source_size) OVER () * 150 / 100 AS budget FROM w
), p AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open FROM r
), l AS (
  SELECT (budget - held) / open AS rate FROM p WHERE w * ((budget - held) / open) <= cap ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, w * coalesce((SELECT rate FROM l), 0)) AS target FROM w
), u AS (
  SELECT doc_id, source, size, size * count(*) AS weight,
         row_number() OVER () AS x FROM d GROUP BY doc_id, source, size
), b AS (
  SELECT u.*, t.source_size, t.target,
         coalesce(sum(u.weight) OVER (PARTITION BY u.source ORDER BY md5(coalesce(u.doc_id::VARCHAR, '')), u.doc_id, u.size
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM b
)
SELECT d.doc_id, d.size, c.source_size, c.target,
       CASE WHEN d.size = 0 THEN 0 ELSE d.size * (passes + CASE WHEN
         2 * before + weight <= 2 * (target - passes * source_size) AND passes < 2 THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM d JOIN c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source AND d.size = c.size
"""
