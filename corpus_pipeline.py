"""Turns documents into packed training sequences, in five stages.

1. Quality classifier: documents that the model rejects go.
2. N-gram Jaccard join: of each class of near duplicates (five-word shingles, similarity 0.8)
   the document with the least id stays.
3. Substring dedup: words inside passages of 50 words that a smaller id also has are taken out.
4. Benchmark decontamination: documents with a benchmark window (10 words) go.
5. Best-fit packing: what is left, in sequences of 2048 tokens.

Every stage but the last returns the columns of ``documents``; rows with null text carry no
words, so they pass 2 to 4 and are judged like empty texts by 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from odonymy.llm import decontaminate, jaccard_join, packing, quality, substring_dedup
from odonymy.llm.frames import table
from odonymy.llm.tokens import public_path
from odonymy.session import materialize, ship

PASSAGE_WORDS = 50


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.keep_one(docs, size=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring_dedup.remove_repeats(docs, PASSAGE_WORDS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(packing.pieces(docs, public_path("word_bpe_49k.json")))


STAGES = [("quality_classifier", good_quality), ("ngram_jaccard_join", one_of_near_duplicates), ("substring_dedup", without_repeats), ("benchmark_decontamination", decontaminated), ("best_fit_packing", packed)]
#: SQL cannot express the trained classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written to the shared folder and read again."""
    rows = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = materialize(rows, name)
    return rows
