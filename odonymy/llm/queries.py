"""Queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from odonymy.llm import decontaminate, jaccard_join, language, oracles, packing, quality, repair_codec, rules, substring_dedup, token_rollup, toxicity
from odonymy.llm.frames import table
from odonymy.llm.tokens import public_path
from odonymy.session import scratch_path, ship


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.find(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.replay(table(spark, sf_dir, "documents"), scratch_path(spark, "rollup"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(jaccard_join.similar(table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.digest(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_codec.round_trip(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.digest(language.predict(docs, language.fit(docs)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(rules.judge(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
