"""DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts (0 for none); sizes blocks and buckets, never drops rows."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
