"""The queries of this subpackage, by name, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontam, katz, langid, minhash, mixing, oracles, pii, quality, repeats, resampling, secrets, sharding, tokens
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"), order=3)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_tokens": op3_tokens,
    "op4_mixing": op4_mixing,
    "op5_langid": op5_langid,
    "op6_katz": op6_katz,
    "op7_minhash": op7_minhash,
    "op8_decontam": op8_decontam,
    "op9_quality": op9_quality,
    "op10_repeats": op10_repeats,
    "op11_audit": op11_audit,
    "op12_resampling": op12_resampling,
    "op13_secrets": op13_secrets,
}

ORACLES: dict[str, str] = {
    "op7_minhash": oracles.near_duplicates(),
    "op8_decontam": oracles.contamination(),
    "op9_quality": oracles.quality(),
    "op10_repeats": oracles.repeats(),
    "op11_audit": oracles.audit(),
    "op12_resampling": oracles.resampling(),
}
