"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import crc_mod


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _held_out(by: int, rest: int) -> Column:
    return F.coalesce(crc_mod("doc_id", by) == rest, F.lit(False)).alias("held_out")


def _predicted() -> Column:
    return F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _docs(spark, sf_dir)
    scored = score_toxicity(docs, fit_toxicity(docs, _labels(spark, sf_dir)))
    return scored.select("doc_id", _held_out(3, 1), "score", _predicted(), "insult_weight", "threat_weight")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_language_id, predict_language

    docs = _docs(spark, sf_dir)
    return predict_language(docs, fit_language_id(docs)).select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected")


def op3_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .arrow_output import round_trip

    return round_trip(_docs(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import mark_duplicates

    return mark_duplicates(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(_docs(spark, sf_dir), with_text=False)


def op7_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit_quality, score_quality

    docs = _docs(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, _labels(spark, sf_dir))).select("doc_id", _held_out(4, 2), "score", _predicted(), "n_passages")


def op8_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan_mix

    return plan_mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_docs(spark, sf_dir), with_ids=False).drop("bucket")


def op10_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity_grammar, op2_language_id, op3_arrow_sequences, op4_minhash_near_dedup, op5_exact_dedup, op6_quality_rules, op7_quality_attention, op8_sainte_lague_mix, op9_binary_packing, op10_pii_disclosure]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
