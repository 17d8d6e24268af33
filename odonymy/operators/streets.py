"""From ways to streets: shared-node and distance joins, components, groups, near misses.

Columns: ways have way_id, name, norm_name, node_ids and coords (node_id, lon, lat). Streets
exist per norm_name only; two ways of different norm_name never join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonymy.functions import geo
from odonymy.plans.graph import connected_components
from odonymy.plans.raster import Contracted
from odonymy.session import discard, materialize, parts_of, release, split

Projection = geo.Identity | geo.TransverseMercator
CHUNK = 8  # segments of a way that meet others as one row
GAPS = "norm_name string, a long, b long, part_a long, part_b long, d2 double"


def _nodes(ways: DataFrame) -> DataFrame:
    return ways.select("norm_name", "way_id", F.explode(F.array_distinct("node_ids")).alias("node"))


def _hubs(ways: DataFrame) -> DataFrame:
    """(norm_name, node, a) of the nodes that several ways of a group have, a being the least of them."""
    # The least way of a node is combined before the shuffle; a hot node's rows can then be split by the join.
    hub = _nodes(ways).groupBy("norm_name", "node").agg(F.min("way_id").alias("a"), F.max("way_id").alias("most"))
    return hub.where("a < most").drop("most")


def node_edges(ways: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Certain join: each way of a group with the least way of the group at each of its nodes (a star, not all pairs)."""
    at = _nodes(ways).join(_hubs(ways) if hubs is None else hubs, ["norm_name", "node"])
    return at.where("a <> way_id").select("a", F.col("way_id").alias("b")).distinct()


def _cells(lo: str, hi: str, size: float):
    return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))


def near_segments(ways: DataFrame, radius: float, projection: Projection, keep: list[str], cell: float | None = None) -> DataFrame:
    """Pairs of directed segments (structs s and t) of one norm_name whose boxes are within the radius; s.way_id < t.way_id.

    Segments meet in grid cells: one side lists the cells of its box, the other those of its box
    widened by the radius; the key is (norm_name, cell), so a very common name is spread by place.
    A pair is kept only in the cell of its common corner, so it occurs once without a distinct.
    """
    size = cell or max(4 * radius, 250.0)
    lines = ways.select("norm_name", *keep, geo.metric(F.col("coords"), projection).alias("line"))
    # A long segment goes as pieces, so none lists more than a few cells; their least distance is the segment's.
    cut, box = ("ax", "bx", "ay", "by"), ("x0", "x1", "y0", "y1")
    seg = geo.pieces(lines, size, ["norm_name", *keep])
    seg = seg.select("norm_name", *keep, "pos", *box, geo.directed(F.struct(*cut)).alias("g")).select("norm_name", *keep, "pos", *box, "g.*")

    fields = [*keep, "pos", *cut, "dx", "dy", "inv", *box]

    def dealt(side: str, wide: float) -> DataFrame:
        rows = seg.select("norm_name", *(F.col(c).alias(f"{side}_{c}") for c in fields), *((F.col(f"{k}0") - wide).alias(f"{side}_lo_{k}") for k in "xy"), *((F.col(f"{k}1") + wide).alias(f"{side}_hi_{k}") for k in "xy"))
        for k in "xy":
            rows = rows.withColumn(f"c{k}", F.explode(_cells(f"{side}_lo_{k}", f"{side}_hi_{k}", size)))
        return rows

    both = dealt("s", 0.0).join(dealt("t", radius), ["norm_name", "cx", "cy"])
    corner = lambda k: F.col(f"c{k}") == F.greatest(F.floor(F.col(f"s_lo_{k}") / size), F.floor(F.col(f"t_lo_{k}") / size))
    apart = lambda k: F.greatest(F.col(f"s_{k}0") - F.col(f"t_{k}1"), F.col(f"t_{k}0") - F.col(f"s_{k}1"))
    both = both.where(corner("x") & corner("y") & (F.col("s_way_id") < F.col("t_way_id")) & (apart("x") <= radius) & (apart("y") <= radius))
    return both.select("norm_name", *(F.struct(*(F.col(f"{side}_{c}").alias(c) for c in fields)).alias(side) for side in "st"))


def way_gaps(ways: DataFrame, radius: float, projection: Projection) -> DataFrame:
    """(norm_name, a, b, d2) of ways of one group whose segments' boxes come within the radius: their least squared distance.

    Distances are an aggregate: as a filter the formula would be worked out without sharing its parts.
    """
    pairs = near_segments(ways, radius, projection, ["way_id"])
    return pairs.groupBy("norm_name", F.col("s.way_id").alias("a"), F.col("t.way_id").alias("b")).agg(F.min(geo.distance2("s", "t")).alias("d2"))


def unmeasurable(ways: DataFrame) -> DataFrame:
    """Ways with a vertex that no distance can be measured from: they join by shared nodes only."""
    return ways.where((F.size("coords") >= 2) & ~geo.finite(F.col("coords")))


def distance_edges(ways: DataFrame, threshold: float, projection: Projection) -> DataFrame:
    """Heuristic join: pairs of ways of one group at most ``threshold`` apart."""
    return way_gaps(ways, threshold, projection).where(F.sqrt("d2") <= threshold).select("a", "b")


def _polylines(ways: DataFrame, size: float, projection: Projection) -> DataFrame:
    """(norm_name, way_id, part, line, x0, x1, y0, y1): ways in stretches of CHUNK segments, line being all x and then all y.

    A stretch wider than a cell goes as pieces of its segments, so none lists more than a few cells.
    """
    lines = ways.select("norm_name", "way_id", "part", geo.metric(F.col("coords"), projection).alias("line")).where("line IS NOT NULL")
    rows = lines.select("norm_name", "way_id", "part", F.explode(F.transform(F.sequence(F.lit(1), F.size("line") - 1, F.lit(CHUNK)), lambda i: F.slice("line", i, CHUNK + 1))).alias("line"))
    rows = rows.select("norm_name", "way_id", "part", *(F.col(f"line.{k}") for k in "xy"))
    rows = rows.select("*", *(f(k).alias(f"{k}{i}") for k in "xy" for i, f in enumerate((F.array_min, F.array_max))))
    small = (F.col("x1") - F.col("x0") <= size) & (F.col("y1") - F.col("y0") <= size)
    flat = F.concat("x", "y").alias("line")
    keep = ["norm_name", "way_id", "part"]
    wide = rows.where(~small).select(*keep, F.arrays_zip("x", "y").alias("line"))
    cut = geo.pieces(wide, size, keep).select(*keep, F.array("ax", "bx", "ay", "by").alias("line"), "x0", "x1", "y0", "y1")
    return rows.where(small).select(*keep, flat, "x0", "x1", "y0", "y1").union(cut)


def _part_gaps(parts: Contracted, radius: float) -> DataFrame | None:
    """(norm_name, a, b, part_a, part_b, d2) of ways of different parts that come within the radius; None if there are none.

    Stretches of ways meet in grid cells as segments do in ``near_segments``; a stretch is one row there, not one for each
    segment, and what follows from its vertices is worked out behind the join.
    """
    ways = parts.near_others(radius)
    if ways is None:
        return None
    size = max(4 * radius, 250.0)
    line = materialize(_polylines(ways, size, parts.projection), "near-lines")
    parts.clear()
    parts.spent.append(line)
    parts.split = max(parts.split, parts_of(line, 8))  # each stretch is dealt to some four cells, with all it needs there
    release(line.sparkSession)

    def dealt(side: str, wide: float) -> DataFrame:
        rows = line.select("norm_name", *(F.col(c).alias(f"{side}_{c}") for c in line.columns[1:]))
        for k in "xy":
            rows = rows.withColumn(f"c{k}", F.explode(F.sequence(F.floor((F.col(f"{side}_{k}0") - wide) / size), F.floor((F.col(f"{side}_{k}1") + wide) / size))))
        return rows

    both = dealt("s", 0.0).join(dealt("t", radius), ["norm_name", "cx", "cy"])
    corner = lambda k: F.col(f"c{k}") == F.greatest(F.floor(F.col(f"s_{k}0") / size), F.floor((F.col(f"t_{k}0") - radius) / size))
    apart = lambda k: F.greatest(F.col(f"s_{k}0") - F.col(f"t_{k}1"), F.col(f"t_{k}0") - F.col(f"s_{k}1"))
    both = both.where(corner("x") & corner("y") & (F.col("s_way_id") < F.col("t_way_id")) & (F.col("s_part") != F.col("t_part")) & (apart("x") <= radius) & (apart("y") <= radius))
    both = both.select("norm_name", *(f"{side}_{c}" for side in "st" for c in ("way_id", "part", "line")))
    for side in "st":
        both = both.withColumn(f"{side}_i", F.explode(F.sequence(F.lit(0), (F.size(f"{side}_line") / 2).cast("int") - 2)))
    ends = [F.col(f"{side}_{c}").alias(name) for c, names in (("way_id", "ab"), ("part", ("part_a", "part_b"))) for side, name in zip("st", names, strict=True)]
    # Known to be there: without tests for null the distance of a pair is a short loop.
    at = lambda side, k, o: F.coalesce(F.get(f"{side}_line", F.col(f"{side}_i") + o + (0 if k == "x" else (F.size(f"{side}_line") / 2).cast("int"))), F.lit(0.0))
    both = both.select("norm_name", *ends, *(at(side, k, o).alias(f"{side}_{e}{k}") for side in "st" for e, o in (("a", 0), ("b", 1)) for k in "xy"))
    both = both.select("*", *((F.col(f"{side}_b{k}") - F.col(f"{side}_a{k}")).alias(f"{side}_d{k}") for side in "st" for k in "xy"))
    both = both.select("*", *(F.coalesce(F.try_divide(F.lit(1.0), F.col(f"{side}_dx") * F.col(f"{side}_dx") + F.col(f"{side}_dy") * F.col(f"{side}_dy")), F.lit(0.0)).alias(f"{side}_inv") for side in "st"))
    names = ["norm_name", "a", "b", "part_a", "part_b"]
    pairs = both.select(*names, *(F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ("ax", "ay", "bx", "by", "dx", "dy", "inv"))).alias(side) for side in "st"))
    return pairs.groupBy(*names).agg(F.min(geo.distance2("s", "t")).alias("d2")).where(F.sqrt("d2") <= radius)


def _part_labels(made: Contracted, near: DataFrame | None) -> DataFrame:
    """(part, component) of the parts that are joined, by shared nodes or by ``near`` (a, b); an unmeasurable way is a part of its own."""
    hubs = materialize(_hubs(made.ways), "node-hubs")
    release(hubs.sparkSession)
    # Without a shared node the ways need not be dealt out by node again.
    joined = edges = hubs.select("a", F.col("a").alias("b"))
    if not hubs.isEmpty():
        joined = edges = materialize(node_edges(made.ways, hubs), "node-edges")
        for side in "ab":
            joined = joined.join(made.parts.select(F.col("way_id").alias(side), "part"), side, "left").withColumn(side, F.coalesce("part", side)).select("a", "b")
    for more in (made.ties, near):
        joined = joined if more is None else joined.union(more)
    label = connected_components(joined)
    discard(edges)
    discard(hubs)
    return label.select(F.col("id").alias("part"), "component")


def components(ways: DataFrame, threshold: float | None = None, projection: Projection | None = None) -> DataFrame:
    """Adds ``component``, the least way_id of the way's street; without a threshold by shared nodes only."""
    if threshold is None:
        label = connected_components(node_edges(ways))
        return ways.join(label, ways["way_id"] == label["id"], "left").select(ways["*"], F.coalesce("component", "way_id").alias("component"))
    made = Contracted(ways, threshold, projection or geo.TransverseMercator())
    gaps = _part_gaps(made, threshold)
    near = None if gaps is None else gaps.where(F.sqrt("d2") <= threshold).select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    label = _part_labels(made, near)
    made.clear()
    # Unmeasurable ways are in no part; shared nodes may still join them.
    named = ways.join(made.parts, "way_id", "left").select(ways["*"], F.coalesce("part", "way_id").alias("part"))
    return named.join(label, "part", "left").select(*(named[c] for c in ways.columns), F.coalesce("component", "part").alias("component"))


def _most_frequent(rows: DataFrame) -> DataFrame:
    """(norm_name, name): counted per name first, so no key's names stand in one buffer."""
    counted = rows.groupBy("norm_name", "name").agg((-F.count("*")).alias("n"))
    return counted.groupBy("norm_name").agg(F.min(F.struct("n", "name"))["name"].alias("name"))


def display_names(ways: DataFrame) -> DataFrame:
    """Most frequent raw name of each group's ways, the least on ties: (norm_name, name)."""
    return _most_frequent(ways)


def streets(labelled: DataFrame) -> DataFrame:
    """One row for each component: norm_name, name (of the group), way_ids ascending, street_id."""
    grouped = labelled.groupBy("norm_name", "component").agg(F.array_sort(F.collect_set("way_id")).alias("way_ids"))
    return grouped.join(display_names(labelled), "norm_name").select("norm_name", "name", "way_ids", F.col("component").alias("street_id"))


def street_count(way_ids: Column) -> Column:
    """Number of distinct ways of a street."""
    return F.size(F.array_distinct(way_ids)).cast("long")


def ids_to_json(way_ids: Column) -> Column:
    """Way ids as a JSON array, for files that know no arrays."""
    return F.to_json(way_ids)


def ids_from_json(text: Column) -> Column:
    return F.from_json(text, "array<long>")


def street_groups(streets_: DataFrame) -> DataFrame:
    """Number of distinct streets and least name of each key."""
    return streets_.groupBy("norm_name").agg(F.min("name").alias("name"), F.count("*").alias("count"))


def top_groups(groups: DataFrame, limit: int = 10) -> DataFrame:
    return groups.orderBy(F.desc("count"), "norm_name").limit(limit)


def street_display_names(streets_: DataFrame) -> DataFrame:
    """Most frequent street name of each key, the least on ties."""
    return _most_frequent(streets_)


def near_misses(ways: DataFrame, threshold: float, projection: Projection | None = None) -> DataFrame:
    """Pairs of streets of one group whose gap is at least the threshold and under twice that.

    Streets without a measurable way have no gap. street_id is the least measurable way; the way and
    the node next to the gap describe each side. Ordered by distance (to a micrometre), then by the ids.
    """
    projection = projection or geo.TransverseMercator()
    made = Contracted(ways, threshold, projection)
    # Distances once, out to twice the threshold; those within it are what joins parts.
    gaps = _part_gaps(made, 2 * threshold)
    gaps = materialize(ways.sparkSession.createDataFrame([], GAPS) if gaps is None else split(gaps, made.split), "way-gaps")
    made.clear()
    release(ways.sparkSession)
    label = _part_labels(made, gaps.where(F.sqrt("d2") <= threshold).select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    # A part's id is its least way and measurable.
    street = made.parts.select("part").distinct().join(label, "part", "left").select("part", F.coalesce("component", "part").alias("component"))
    street = labelled = materialize(street, "part-components")
    discard(made.parts)
    discard(label)
    ids = street.groupBy("component").agg(F.min("part").alias("street_id"))
    street = materialize(street.join(ids, "component").select("part", "street_id"), "part-streets")
    discard(labelled)
    release(ways.sparkSession)
    of = lambda side: street.select(F.col("part").alias(f"part_{side}"), F.col("street_id").alias(f"street_{side}"))
    apart = gaps.join(of("a"), "part_a").join(of("b"), "part_b").where("street_a <> street_b")
    turn = F.col("street_a") > F.col("street_b")
    low, high = (F.when(turn == first, F.struct(F.col("street_b").alias("s"), F.col("b").alias("w"))).otherwise(F.struct(F.col("street_a").alias("s"), F.col("a").alias("w"))) for first in (True, False))
    apart = apart.select("norm_name", "d2", low.alias("p"), high.alias("q"))
    # Of way pairs equally far apart (to a millionth of a square metre) the least ids stand for the gap.
    best = apart.groupBy("norm_name", F.col("p.s").alias("street_id_a"), F.col("q.s").alias("street_id_b")).agg(F.min("d2").alias("d2"), F.min(F.struct(F.round("d2", 6).alias("d2"), F.col("p.w").alias("a"), F.col("q.w").alias("b"))).alias("m"))
    best = best.withColumn("distance_m", F.sqrt("d2")).where((F.col("distance_m") >= threshold) & (F.col("distance_m") < 2 * threshold))
    best = materialize(best.select("norm_name", "street_id_a", "street_id_b", F.col("m.a").alias("way_id_a"), F.col("m.b").alias("way_id_b"), "distance_m"), "near-misses")
    discard(gaps)
    discard(street)
    release(ways.sparkSession)
    ends = best.select(F.explode(F.array("way_id_a", "way_id_b")).alias("way_id")).distinct()
    shown = materialize(ways.select("way_id", "coords").join(ends, "way_id", "left_semi"), "near-miss-ways")
    release(ways.sparkSession)
    named = best.join(display_names(ways.join(best.select("norm_name").distinct(), "norm_name", "left_semi")), "norm_name").join(_gap_nodes(best, shown, projection), ["way_id_a", "way_id_b"], "left")
    return named.select("name", "norm_name", "street_id_a", "street_id_b", "way_id_a", "way_id_b", "node_id_a", "node_id_b", "distance_m").orderBy(F.round("distance_m", 6), "street_id_a", "street_id_b")


def _gap_nodes(best: DataFrame, ways: DataFrame, projection: Projection) -> DataFrame:
    """(way_id_a, way_id_b, node_id_a, node_id_b): the vertex of each way next to where the two are nearest, the least on ties (to a millionth)."""
    named = best.groupBy("way_id_a", "way_id_b").agg(F.max("distance_m").alias("distance_m"))
    lines = ways.select("way_id", geo.metric(F.col("coords"), projection).alias("line"))
    for side in "ab":
        named = named.join(lines.select(F.col("way_id").alias(f"way_id_{side}"), F.col("line").alias(f"line_{side}")), f"way_id_{side}")
    pair = ["way_id_a", "way_id_b"]
    rows = named.select(*pair, "distance_m", "line_b", F.explode(geo.segment_list(F.col("line_a"))).alias("s"))
    rows = rows.select(*pair, "distance_m", geo.directed(F.col("s")).alias("s"), F.explode(geo.segment_list(F.col("line_b"))).alias("t")).withColumn("t", geo.directed(F.col("t")))
    # The gap is known but for rounding, so few of a pair's segment pairs remain; points are worked out for these. The number
    # keeps the test above the distance, which a filter would work out without sharing its parts.
    rows = rows.withColumn("d2", F.round(geo.distance2("s", "t"), 6)).withColumn("k", F.monotonically_increasing_id())
    rows = rows.where((F.col("d2") <= F.pow("distance_m", F.lit(2)) * 1.001 + 0.01) & (F.col("k") >= 0))
    ends = materialize(rows.select(*pair, F.struct("d2", geo.nearest("s", "t").alias("at")).alias("g")), "gap-ends")
    release(ends.sparkSession)
    found = ends.groupBy(*pair).agg(F.min("g").alias("g")).select(*pair, "g.at.*")

    def next_to(side: str, x: str, y: str) -> DataFrame:
        at = found.select(*pair, F.col(x).alias("x"), F.col(y).alias("y")).join(lines.withColumnRenamed("way_id", f"way_id_{side}"), f"way_id_{side}")
        away = lambda v: F.struct(F.round(F.pow(v["x"] - F.col("x"), F.lit(2)) + F.pow(v["y"] - F.col("y"), F.lit(2)), 6).alias("d"), v["node_id"].alias("n"))
        return at.select(*pair, F.array_min(F.transform("line", away)).alias("m")).groupBy(*pair).agg(F.min("m")["n"].alias(f"node_id_{side}"))

    return next_to("a", "sx", "sy").join(next_to("b", "tx", "ty"), pair)
