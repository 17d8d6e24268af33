"""Relabelling of street keys by an alias mapping, and checks of the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mapping_frame(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """(line, variant, canonical), in the file's order."""
    rows = [(i, v, c) for i, (v, c) in enumerate(mapping.items())]
    return spark.createDataFrame(rows, "line int, variant string, canonical string")


def chained(mapping: DataFrame) -> DataFrame:
    """Mappings whose canonical key is itself a variant: these are rejected."""
    variants = mapping.select(F.col("variant").alias("v")).distinct()
    return mapping.join(variants, F.col("canonical") == F.col("v"), "left_semi")


def unknown(mapping: DataFrame, streets: DataFrame) -> DataFrame:
    """Mappings whose variant no street has."""
    keys = streets.select(F.col("norm_name").alias("k")).distinct()
    return mapping.join(keys, F.col("variant") == F.col("k"), "left_anti")


def relabelled(streets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Streets under their canonical keys. Variants are unique and never canonical, so one pass is all."""
    names = mapping.select("variant", "canonical")
    joined = streets.join(names, streets["norm_name"] == names["variant"], "left")
    return joined.select(*(F.coalesce("canonical", "norm_name").alias("norm_name") if c == "norm_name" else streets[c] for c in streets.columns))


def relabel_counts(streets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Streets moved by each mapping, zeros included."""
    per = streets.groupBy("norm_name").agg(F.count("*").alias("n"))
    joined = mapping.join(per, mapping["variant"] == per["norm_name"], "left")
    return joined.select("line", "variant", "canonical", F.coalesce("n", F.lit(0)).cast("long").alias("moved")).orderBy("line")
