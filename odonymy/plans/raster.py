"""Ways contracted on a raster, so that dense places need no list of pairs.

A cell's side is 0.35 thresholds, so points in the same cell or in touching ones are less than a
threshold apart (2 * sqrt(2) * 0.35 = 0.99). Ways are sampled in steps below a side: all cells of
a way touch, and ways whose cells touch belong to one street. Such ways are one part. What is
left to measure are pairs of ways of different parts, in the few blocks that two parts come near.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odonymy.functions import geo
from odonymy.plans.graph import connected_components
from odonymy.session import discard, materialize, parts_of, release, split

SIDE, STEP, STEPS, TILE = 0.35, 0.9, 64, 256
_WIDE, _ZERO = 1 << 32, 1 << 30  # a cell is one number: row * 2^32 + column + 2^30


def _lines(ways: DataFrame, projection: geo.Identity | geo.TransverseMercator) -> DataFrame:
    return ways.select("norm_name", "way_id", geo.metric(F.col("coords"), projection).alias("line")).where("line IS NOT NULL")


def _short(side: float) -> Column:
    """Whether a line goes on the raster: no segment of more than STEPS steps, no cell number beyond 2^30.

    One pass that names the line once: as a filter it is worked out below, where each mention means projecting again.
    """
    near = lambda v, w: F.abs(v - w) <= STEPS * STEP * side
    begin = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("ok"))

    def go_on(to: Column, p: Column) -> Column:
        ok = to["ok"] & (F.abs(p["x"]) < _ZERO * side) & (F.abs(p["y"]) < _ZERO * side) & F.coalesce(near(p["x"], to["x"]) & near(p["y"], to["y"]), F.lit(True))
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), ok.alias("ok"))

    return F.aggregate("line", begin, go_on, lambda to: to["ok"])


def _cell(x: Column, y: Column, side: float) -> Column:
    return F.floor(y / side) * F.lit(_WIDE) + F.floor(x / side) + F.lit(_ZERO)


def _row(cell: str) -> Column:
    return F.shiftright(F.col(cell), 32)


def _column(cell: str) -> Column:
    return F.col(cell).bitwiseAND(F.lit(_WIDE - 1)) - F.lit(_ZERO)


def _runs(short: DataFrame, side: float) -> DataFrame:
    """(norm_name, cell, first, hub) of all cells: the first cell of the row's unbroken run, and the least way_id in the run."""
    seg = geo.segments(short, "line", ["norm_name", "way_id"])
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / (STEP * side)).cast("int"))
    seg = seg.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.when(F.col("pos") == 0, 0).otherwise(1), F.col("n"))))
    at = lambda k: F.when(F.col("i") == F.col("n"), F.col(f"b{k}")).otherwise(F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * F.col("i") / F.col("n"))
    cells = seg.select("norm_name", "way_id", _cell(at("x"), at("y"), side).alias("cell")).groupBy("norm_name", "cell").agg(F.min("way_id").alias("least"))
    cells = cells.withColumn("row", _row("cell"))
    along = Window.partitionBy("norm_name", "row").orderBy("cell")
    begins = F.coalesce(F.col("cell") - F.lag("cell").over(along) > 1, F.lit(True))
    cells = cells.withColumn("begin", F.when(begins, F.col("cell"))).withColumn("first", F.max("begin").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return cells.select("norm_name", "cell", "first", F.min("least").over(Window.partitionBy("norm_name", "row", "first")).alias("hub"))


def _touching(cells: DataFrame) -> DataFrame:
    """(a, b): hubs of runs in neighbouring rows that touch. Runs meet by the TILE columns they reach, not by whole rows."""
    runs = cells.groupBy("norm_name", "first", "hub").agg(F.max("cell").alias("last"))
    runs = runs.select("norm_name", "hub", _row("first").alias("row"), _column("first").alias("x0"), _column("last").alias("x1"))
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(lo / TILE), F.floor(hi / TILE))).alias("tile")
    below = runs.select("norm_name", "row", F.col("hub").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), tiles(F.col("x0"), F.col("x1")))
    above = runs.select("norm_name", (F.col("row") - 1).alias("row"), F.col("hub").alias("b"), (F.col("x0") - 1).alias("b0"), (F.col("x1") + 1).alias("b1"), tiles(F.col("x0") - 1, F.col("x1") + 1))
    return below.join(above, ["norm_name", "row", "tile"]).where("a0 <= b1 AND b0 <= a1 AND a <> b").select("a", "b").distinct()


class Contracted:
    """Measurable ways in parts: ``parts`` has (way_id, part), the part being its least way_id.

    ``ties`` has the parts (a, b) that one way_id with several rows belongs to; None as a rule.
    """

    def __init__(self, ways: DataFrame, threshold: float, projection: geo.Identity | geo.TransverseMercator):
        self.ways, self.projection, self.side, self.ties, self.spent = ways, projection, SIDE * threshold, None, []
        self.split = parts_of(ways, 4)  # about what the cells of a sparse table shuffle
        if not 0 < threshold < math.inf:  # nothing to contract by
            self.cells = None
            self.parts = materialize(_lines(ways, projection).select("way_id", F.col("way_id").alias("part")).distinct(), "parts")
            return
        # Ways without a name never meet; they stay out as long ones do.
        inside = F.col("norm_name").isNotNull() & _short(self.side)
        release(ways.sparkSession)
        # The choice of a part's ways comes first: it is cheap, the other conditions are not.
        self.cells = materialize((_runs(_lines(some, projection).where(inside), self.side) for some in split(ways, self.split)), "cells")
        release(ways.sparkSession)
        touching = materialize((_touching(some) for some in split(self.cells, parts_of(self.cells, 4))), "touching")
        release(ways.sparkSession)
        self.label = connected_components(touching).select(F.col("id").alias("hub"), "component")
        discard(touching)
        start = F.get("line", F.lit(0))

        def placed(some: DataFrame) -> DataFrame:
            of = _lines(some, projection).select("norm_name", "way_id", F.when(inside, _cell(start["x"], start["y"], self.side)).alias("cell"))
            of = of.join(self.cells.select("norm_name", "cell", "hub"), ["norm_name", "cell"], "left").join(self.label, "hub", "left")
            return of.select("way_id", F.coalesce("component", "hub", "way_id").alias("part"), F.col("cell").isNull().alias("long"))

        of = materialize((placed(some) for some in split(ways, self.split)), "way-parts")
        release(ways.sparkSession)
        self.long = None if of.where("long").isEmpty() else materialize(_lines(ways, projection).where(~inside), "long-ways")
        once = materialize(of.groupBy("way_id").agg(F.min("part").alias("part"), F.max("part").alias("most")), "parts")
        self.parts, twice = once.select("way_id", "part"), once.where("part < most").select("way_id", F.col("part").alias("a"))
        if not twice.isEmpty():
            self.ties = materialize(of.select("way_id", F.col("part").alias("b")).join(twice, "way_id").where("a <> b").select("a", "b").distinct(), "part-ties")
        discard(of)
        release(ways.sparkSession)

    def _blocks(self, lines: DataFrame, cells: int) -> DataFrame:
        """(norm_name, way_id, bx, by): the blocks of each segment's box, long segments in pieces."""
        seg = geo.pieces(lines, cells * self.side, ["norm_name", "way_id"])
        at = lambda c: F.floor(F.floor(F.col(c) / self.side) / cells)
        return seg.select("norm_name", "way_id", "y0", "y1", F.explode(F.sequence(at("x0"), at("x1"))).alias("bx")).select("norm_name", "way_id", "bx", F.explode(F.sequence(at("y0"), at("y1"))).alias("by"))

    def clear(self) -> None:
        """Deletes what only the tables written since were worked out from."""
        while self.spent:
            discard(self.spent.pop())

    def near_others(self, radius: float) -> DataFrame | None:
        """Ways that another part may come within the radius of, as (norm_name, way_id, coords, part); None if there are none.

        A block is wider than the radius and a way's distance from its samples: what is near a point
        of a block is in it or in one of its eight neighbours. To be called once: the cells are deleted.
        """
        if self.cells is None:
            return self.ways.select("norm_name", "way_id", "coords").join(self.parts, "way_id")
        m = max(math.ceil(radius / self.side) + 2, math.ceil(250 / self.side))
        block = lambda c: F.floor(c / m)
        here = self.cells.select("norm_name", block(_column("cell")).alias("bx"), block(_row("cell")).alias("by"), "hub").distinct().join(self.label, "hub", "left")
        here = here.select("norm_name", "bx", "by", F.coalesce("component", "hub").alias("part")).distinct()
        if self.long is not None:
            here = here.union(self._blocks(self.long, m).select("norm_name", "bx", "by", F.col("way_id").alias("part")).distinct())
        for k in ("bx", "by"):
            here = here.withColumn(k, F.explode(F.sequence(F.col(k) - 1, F.col(k) + 1)))
        mixed = here.groupBy("norm_name", "bx", "by").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("norm_name", "bx", "by")
        mixed = materialize(split(mixed, parts_of(self.cells, 4)), "mixed-blocks")
        release(mixed.sparkSession)
        for spent in (self.cells, self.label, *([] if self.long is None else [self.long])):
            discard(spent)
        if mixed.isEmpty():
            discard(mixed)
            return None
        near = self._blocks(_lines(self.ways, self.projection), m).join(mixed, ["norm_name", "bx", "by"], "left_semi").select("way_id").distinct()
        near = materialize(near.join(self.parts, "way_id"), "near-others")
        discard(mixed)
        release(near.sparkSession)
        self.spent.append(near)
        return self.ways.select("norm_name", "way_id", "coords").join(near, "way_id")
