"""Distribution figures of each street name: spread, regional concentration, composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odonymy.functions import geo
from odonymy.operators.cities import place

KPI_COLUMNS = ("norm_name", "count", "mean_lon", "mean_lat", "std_distance_km", "top_region", "top_region_lq", "top_region_share", "effective_regions", "region_gini", "skew_score")


def regional(counts: DataFrame, regions: int) -> DataFrame:
    """From (norm_name, region_seq, region, n): top region, effective regions and Gini of each name.

    Weights are a name's streets over all streets of the region, scaled to one. Regions a name does
    not reach are zeros: with k of n reached they fill the ranks 1..n-k.
    """
    whole = counts.groupBy("region_seq").agg(F.sum("n").alias("all_n"))
    by_name = Window.partitionBy("norm_name")
    # At most one row for each region stands in a name's window.
    rows = counts.join(whole, "region_seq").withColumn("share", F.col("n") / F.col("all_n"))
    rows = rows.withColumn("name_n", F.sum("n").over(by_name)).withColumn("w", F.col("share") / F.sum("share").over(by_name))
    placed = whole.agg(F.sum("all_n").alias("placed"))
    rows = rows.join(F.broadcast(placed))  # one row
    rows = rows.withColumn("lq", F.col("share") / (F.col("name_n") / F.col("placed")))
    rows = rows.withColumn("rank", F.row_number().over(by_name.orderBy("w", "region_seq"))).withColumn("k", F.count("*").over(by_name))
    top = F.max(F.struct("lq", (-F.col("region_seq")).alias("o"), "region", "share"))
    n = F.lit(float(regions))
    return rows.groupBy("norm_name").agg(
        top.alias("t"),
        F.exp(-F.sum(F.col("w") * F.log("w"))).alias("effective_regions"),
        (2 * F.sum((n - F.col("k") + F.col("rank")) * F.col("w")) / n - (n + 1) / n).alias("region_gini"),
    ).select("norm_name", F.col("t.region").alias("top_region"), F.col("t.lq").alias("top_region_lq"), F.col("t.share").alias("top_region_share"), "effective_regions", "region_gini")


def _unit(name: str, invert: bool) -> Column:
    """Min-max place in the batch, turned over if small means skewed; constant: 0; null stays null."""
    lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
    unit = (F.col(name) - lo) / (hi - lo)
    return F.when(F.col(name).isNull(), None).when(hi == lo, 0.0).otherwise(1.0 - unit if invert else unit)


def kpis(points: DataFrame, min_count: int = 20, projection: geo.Identity | geo.TransverseMercator | None = None, areas: DataFrame | None = None) -> DataFrame:
    """A row of KPI_COLUMNS for every name with more than ``min_count`` points, most skewed first (scores that differ by less than a billionth are ties)."""
    x, y = (projection or geo.TransverseMercator()).xy(F.col("lon"), F.col("lat"))
    rows = points.select("norm_name", "lon", "lat", x.alias("x"), y.alias("y"))
    names = rows.groupBy("norm_name").agg(F.count("*").alias("count"), F.avg("lon").alias("mean_lon"), F.avg("lat").alias("mean_lat"), (F.sqrt(F.var_pop("x") + F.var_pop("y")) / 1000).alias("std_distance_km"))
    names = names.where(F.col("count") > min_count)
    if areas is not None:
        regions = areas.where("admin_level = '4'")
        found = place(points.withColumn("point_id", F.monotonically_increasing_id()), regions, "norm_name")
        label = F.when(F.coalesce(F.col("area_name"), F.lit("")) == "", geo.osm_ref(F.col("from_way"), F.col("osm_id"))).otherwise(F.col("area_name"))
        counts = found.groupBy("norm_name", F.col("area_seq").alias("region_seq"), label.alias("region")).agg(F.count("*").alias("n"))
        names = names.join(regional(counts, regions.count()), "norm_name", "left")
    else:
        none = lambda t: F.lit(None).cast(t)
        names = names.select("*", none("string").alias("top_region"), *(none("double").alias(c) for c in KPI_COLUMNS[6:10]))
    parts = {"std_distance_km": True, "top_region_lq": False, "top_region_share": False, "effective_regions": True, "region_gini": False}
    ends = names.agg(*(f(c).alias(f"{k}_{c}") for c in parts for k, f in (("lo", F.min), ("hi", F.max))))
    scored = names.join(F.broadcast(ends))  # one row
    units = F.filter(F.array(*(_unit(c, inv) for c, inv in parts.items())), lambda v: v.isNotNull())
    score = F.when(F.size(units) > 0, F.aggregate(units, F.lit(0.0), lambda a, v: a + v) / F.size(units)).otherwise(0.0)
    return scored.withColumn("skew_score", score).select(*KPI_COLUMNS).orderBy(F.desc(F.round("skew_score", 9)), "norm_name")
