"""Points in areas: flags per municipality, region assignment, clipping, the wide report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonymy.functions import geo

ID_COLUMNS = ("name", "postal_code", "istat", "catasto", "wikidata", "osm_id")
MUNICIPALITY, TOTAL_KEY = "8", "total"


class RegionError(ValueError):
    """The parent boundary asked for is not there."""


def _hits(points: DataFrame, areas: DataFrame, cell: float = 0.25) -> DataFrame:
    """Point and area columns of each point an area covers, borders included.

    An area lists the grid cells of its box, a point has one; the join is on the cell, whatever the
    number of areas. To each cell goes only what of the outline can matter to points in it, so the
    exact test costs a point a few sides and a large outline is not copied for each of its cells.
    """
    span = lambda k: F.sequence(F.floor(F.col(f"box.{k}0") / cell), F.floor(F.col(f"box.{k}1") / cell))
    keep = [c for c in areas.columns if c != "geometry"]
    listed = areas.select(*keep, geo.bounds(F.col("geometry")).alias("box"), geo.edge_list(F.col("geometry")).alias("sides")).where("box.x0 is not null")
    # Rows of cells first, with what reaches each row; then the cells of a row.
    low = F.col("cy") * cell
    listed = listed.withColumn("cy", F.explode(span("y"))).withColumn("sides", geo.edges_for(F.col("sides"), F.col("box.x0"), low, low + cell))
    listed = listed.withColumn("cx", F.explode(span("x"))).withColumn("sides", geo.edges_for(F.col("sides"), F.col("cx") * cell, low, low + cell))
    dealt = points.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell))
    in_box = F.col("lon").between(F.col("box.x0"), F.col("box.x1")) & F.col("lat").between(F.col("box.y0"), F.col("box.y1"))
    near = dealt.join(listed, ["cx", "cy"]).where(in_box & geo.covered(F.col("sides"), F.col("lon"), F.col("lat")))
    return near.drop("cx", "cy", "box", "sides")


def flagged(areas: DataFrame, points: DataFrame) -> DataFrame:
    """The areas with ``matched``: whether any point lies in them. A point may match several areas."""
    here = _hits(points.select("lon", "lat").distinct(), areas.select("area_seq", "geometry")).select("area_seq").distinct().withColumn("matched", F.lit(True))
    return areas.join(here, "area_seq", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def place(points: DataFrame, areas: DataFrame, *keep: str) -> DataFrame:
    """Each point (point_id) with the first area in read order that covers it; others are left out."""
    side = areas.select("area_seq", F.col("name").alias("area_name"), "osm_id", "from_way", "geometry")
    first = F.min(F.struct("area_seq", "area_name", "osm_id", "from_way")).alias("a")
    return _hits(points, side).groupBy("point_id", *keep).agg(first).select("point_id", *keep, "a.*")


def municipalities(areas: DataFrame, region_id: int | None = None) -> DataFrame:
    """Municipalities, clipped to those with an inner point that the parent boundary covers if one is named."""
    towns = areas.where(F.col("admin_level") == MUNICIPALITY)
    if region_id is None:
        return towns
    parents = areas.where(F.col("admin_level") != MUNICIPALITY)
    # The last boundary read under an id holds; one row.
    region = parents.where(F.col("osm_id") == region_id).orderBy(F.desc("area_seq")).limit(1).select(F.col("geometry").alias("region"))
    if region.isEmpty():
        known = [str(r.osm_id) for r in parents.select("osm_id").distinct().orderBy("osm_id").collect()]  # a few thousand boundaries at most
        raise RegionError(f"no boundary relation/{region_id}; known parents: {', '.join(known) or 'none'}")
    spot = geo.inner_point(F.col("geometry"))
    kept = towns.withColumn("spot", spot).join(F.broadcast(region)).where(geo.covers(F.col("region"), F.col("spot.x"), F.col("spot.y")))
    return kept.drop("spot", "region")


def report(found: DataFrame, column: str) -> DataFrame:
    """A row of ID_COLUMNS, ``column`` ('true'/'false') and ``seq`` for each flagged area."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    ref = geo.osm_ref(F.col("from_way"), F.col("osm_id")).alias("osm_id")
    return found.select(F.col("area_seq").alias("seq"), *(text(c) for c in ID_COLUMNS[:-1]), ref, F.col("matched").cast("string").alias(column))


def merge(old: DataFrame | None, new: DataFrame, column: str) -> DataFrame:
    """Full outer merge of a run into the wide report, by osm_id, with a fresh Total row at the end.

    ``old``: seq, ID_COLUMNS and result columns; ``new``: as from ``report``. Rows seen before keep
    their place and the cells this run does not write, even in a column of the same name; new rows
    follow. Of several new rows with one id the last holds. Cells without a value are empty.
    """
    last = new.groupBy("osm_id").agg(F.max_by(F.struct(*(c for c in new.columns if c not in ("osm_id", "seq"))), "seq").alias("r"), F.min("seq").alias("seq"))
    new = last.select("osm_id", "seq", "r.*")
    if old is None:
        merged, results = new.select(F.lit(1).alias("part"), "seq", *ID_COLUMNS, column), [column]
    else:
        results = [c for c in old.columns if c not in (*ID_COLUMNS, "seq")]
        results += [column] if column not in results else []
        kept = old.where(F.col("osm_id") != TOTAL_KEY)
        both = kept.alias("o").join(new.alias("n"), F.col("o.osm_id") == F.col("n.osm_id"), "full_outer")
        have = lambda side, c: F.col(f"{side}.{c}")
        pick = []
        for c in (*ID_COLUMNS, *results):
            olds = have("o", c) if c in old.columns else F.lit(None)
            news = have("n", c) if c in new.columns else F.lit(None)
            pick.append(F.coalesce(news, olds, F.lit("")).alias(c))
        seen = F.col("o.osm_id").isNotNull()
        merged = both.select(F.when(seen, 0).otherwise(1).alias("part"), F.when(seen, F.col("o.seq")).otherwise(F.col("n.seq")).alias("seq"), *pick)
    # Materialized once more for the totals: the report has a row for each municipality, a few thousand.
    total = merged.agg(*(F.count_if(F.col(c) == "true").cast("string").alias(c) for c in results))
    blank = {"name": "Total", "osm_id": TOTAL_KEY}
    total = total.select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("seq"), *(F.lit(blank.get(c, "")).alias(c) for c in ID_COLUMNS), *results)
    return merged.withColumn("seq", F.col("seq").cast("long")).unionByName(total).orderBy("part", "seq").select(*ID_COLUMNS, *results)


def merge_by_istat(parts: dict[str, DataFrame], order: list[str] | None = None) -> DataFrame:
    """One table from per-pattern reports: the result of each (its last column) beside the common id columns.

    The first part sets the rows; a later row with an unknown istat or other id columns is an error.
    """
    names = order or list(parts)
    base = parts[names[0]].select(*ID_COLUMNS)
    first = base.groupBy("istat").agg(F.max(F.struct(*ID_COLUMNS)).alias("id"))
    out = first
    for name in names:
        part = parts[name]
        side = part.select(F.struct(*ID_COLUMNS).alias("other"), F.col("istat").alias("k"), F.col(part.columns[-1]).alias(name))
        wrong = side.join(first, F.col("k") == F.col("istat"), "left").where(F.col("id").isNull() | (F.col("id") != F.col("other")))
        if not wrong.isEmpty():
            raise ValueError(f"{name}: rows that do not fit the first report")
        out = out.join(side.select("k", name), F.col("k") == F.col("istat"), "left").drop("k")
    return out.select("id.*", *names).orderBy("istat")


def true_count(column: Column) -> Column:
    return F.count_if(column == "true")
