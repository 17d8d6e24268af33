"""Connected components as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from odonymy.session import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b.

    Large star: every vertex hands its larger neighbours to the least vertex of its
    neighbourhood; small star: the smaller neighbours and itself.
    """
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        hub = least.select("a", F.least("a", "m").alias("m"))
        out = near.where("b > a").join(hub, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hub = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(hub, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(hub.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _written(edges: DataFrame, before: int | None = None) -> tuple[DataFrame, dict]:
    """The edges in the shared folder, with their number and a digest observed while they are written.

    before: edges of the round before, of which there is a file for each quarter million.
    """
    watch = Observation()
    out = materialize(edges.observe(watch, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "edges", None if before is None else max(8, before // 250_000))
    return out, watch.get


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Labels each vertex that has an edge with the least vertex it can reach: (id, component).

    Alternates large-star and small-star until the edge set is a set of stars; each round
    is written to the shared folder, so lineage stays short. Self loops and null ends are
    ignored; repeated edges count once. No group of vertices is gathered in one task: both
    steps are a minimum per vertex (combined before the shuffle) and an equi-join.
    """
    x, y = F.col(a), F.col(b)
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y))
    now, seen = _written(now.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        new, then = _written(_star(_star(now, True), False), seen["n"])
        discard(now)
        now, before, seen = new, seen, then
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
