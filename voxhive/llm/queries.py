"""Queries over the training-data operators, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxhive.llm import (
    bpe, collocations, kdshards, langid, metricjoin, mixture, perplexity, simhash, suffixdedup, surrogates, tokenalign, toxicity, warc,
)
from voxhive.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


@query("op1_pii_surrogates")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = surrogates.pseudonymise(docs, kinds="kinds")
    return done.select("doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), "kinds")


@query("op2_warc_boundary_chain", warc.ROWS_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query("op3_metric_range_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return metricjoin.near_vectors(table(spark, folder, "embeddings"))


@query("op4_kd_shards")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return kdshards.shards(table(spark, folder, "documents"), count=8)


@query("op5_byte_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = bpe.default_ranks(spark)
    return bpe.encoded(table(spark, folder, "documents"), path, pattern)


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


@query("op7_simhash_groups")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op8_curriculum_mix", mixture.ROWS_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixed_rows(table(spark, folder, "documents"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffixdedup.cut_repeats(docs).select("doc_id", "cut.*")


@query("op10_perplexity_bands")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    judged = perplexity.quality(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "metrics.n_words", "metrics.word_chars", "metrics.n_symbols", "metrics.n_dup_lines",
        "metrics.n_repeat_words", "base_failed", "kept", "metrics.log_ppl",
    )


@query("op11_toxicity_lexicon")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.scored(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query("op12_collocations", collocations.ROWS_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return tokenalign.aligned(table(spark, folder, "documents"), *tokenalign.default_vocabularies())


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
