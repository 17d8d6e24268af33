"""Bounded labelled samples for fitting, and help for fitting with numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonymy.llm.frames import id_remainder


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, modulus: int = 3, held: int = 1) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents outside the held-out ids, one row for an id.

    A document with several labels takes the largest; null labels and texts are no examples; of
    several texts under one id the one with the least hash stands for it. Over the limit, the ids
    with the least hash are taken (a uniform, repeatable choice).
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_remainder("doc_id", modulus) != held))
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    return one_text(docs, ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "y")


def one_text(docs: DataFrame, ids: DataFrame, value: str) -> DataFrame:
    """(text, value) of the ids, a table of bounded size with ``value`` for each; one text for an id, so no more rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", value).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    return found.select("text", value)
