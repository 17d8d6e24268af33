"""Points that stand for streets, name matches, and the prominence grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonymy.functions import geo, names


def street_points(streets: DataFrame, ways: DataFrame) -> DataFrame:
    """Mean vertex of each street (each way's vertices count for themselves): street_id, norm_name, lon, lat.

    Sums are taken per way before the shuffle. Streets without vertices are left out.
    """
    total = lambda k: F.aggregate("coords", F.lit(0.0), lambda a, c: a + c[k])
    sums = ways.where(F.size("coords") > 0).select("way_id", total("lon").alias("x"), total("lat").alias("y"), F.size("coords").alias("n"))
    members = streets.select("street_id", "norm_name", F.explode("way_ids").alias("way_id"))
    grouped = members.join(sums, "way_id").groupBy("street_id", "norm_name").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n"))
    return grouped.select("street_id", "norm_name", (F.col("x") / F.col("n")).alias("lon"), (F.col("y") / F.col("n")).alias("lat"))


def matched_ways(ways: DataFrame, includes: list[str], excludes: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Middle vertices of ways whose raw name matches: name, lon, lat. The name is tested before geometry is read."""
    found = ways.where(names.matches(F.col("name"), includes, excludes) & (F.size("coords") > 0))
    return found.select("name", geo.middle(F.col("coords")).alias("c")).select("name", "c.lon", "c.lat")


def matched_squares(squares: DataFrame, includes: list[str], excludes: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return squares.where(names.matches(F.col("name"), includes, excludes)).select("name", "lon", "lat")


def location_quotient(ratio: Column, base: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise(ratio / base)


def grid(points: DataFrame, target: str, cell_size: float, min_streets: int, projection: geo.Identity | geo.TransverseMercator | None = None) -> DataFrame:
    """Cells of a square grid with the share of the target's streets.

    x, y (lower left corner), total, matches, ratio, populated, then for the whole grid, on every
    row: total_streets, matching_streets, global_ratio (populated cells only), and the cell's lq.
    """
    if cell_size <= 0:
        raise ValueError("cell_size must be positive")
    x, y = (projection or geo.TransverseMercator()).xy(F.col("lon"), F.col("lat"))
    placed = points.select(F.floor(x / cell_size).alias("col"), F.floor(y / cell_size).alias("row"), (F.col("norm_name") == target).alias("hit"))
    cells = placed.groupBy("col", "row").agg(F.count("*").alias("total"), F.count_if("hit").alias("matches"))
    cells = cells.withColumn("populated", F.col("total") >= min_streets)
    in_scale = lambda c: F.coalesce(F.sum(F.when(F.col("populated"), F.col(c))), F.lit(0))
    whole = cells.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_streets"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matching_streets"), in_scale("total").alias("t"), in_scale("matches").alias("m"))
    whole = whole.select("total_streets", "matching_streets", F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(0.0).alias("global_ratio"))
    ratio = F.col("matches") / F.col("total")
    out = cells.join(F.broadcast(whole))  # one row
    return out.select((F.col("col") * F.lit(float(cell_size))).alias("x"), (F.col("row") * F.lit(float(cell_size))).alias("y"), "total", "matches", ratio.alias("ratio"), "populated", "total_streets", "matching_streets", "global_ratio", location_quotient(ratio, F.col("global_ratio")).alias("lq"))


def first_words(ways: DataFrame, limit: int = 50) -> DataFrame:
    """Most common first words that are no known street type; ties by word."""
    word = ways.select(names.first_word(F.col("name")).alias("word")).where(F.col("word").isNotNull() & ~names.is_street_type(F.col("word")))
    return word.groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(limit)


def header(ways: DataFrame) -> DataFrame:
    """parsed, unnamed and distinct groups of a ways table, unnamed ways included in it."""
    return ways.agg(F.count("*").alias("parsed_count"), F.count_if(F.col("name").isNull()).alias("unnamed_count"), F.count_distinct("norm_name").alias("group_count"))
