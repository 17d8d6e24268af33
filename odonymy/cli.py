"""Command line: extract, areas, join, threshold, prefixes, map, kpi, alias, cities."""

from __future__ import annotations

import argparse
import io
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from odonymy import paths, sinks
from odonymy.functions import geo
from odonymy.operators import aliases, cities, points, stats, streets
from odonymy.reporter import Reporter
from odonymy.session import get_spark
from odonymy.sources import config_files as files
from odonymy.sources import osm
from odonymy.store import Store
from odonymy.streaming.ingest import extract_in_steps, join_in_buckets

_DERIVED = object()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="odonymy", description="Distinct streets and street-name statistics from OpenStreetMap dumps.")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-v", action="count", default=0, dest="verbosity")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=text, parents=[common])

    for name, text in (("extract", "named highways and squares of a dump"), ("areas", "administrative boundaries of a dump")):
        p = command(name, text)
        p.add_argument("input")
        p.add_argument("database", nargs="?")
        p.add_argument("-d", "--database", dest="database_opt")
        if name == "extract":
            p.add_argument("--steps", type=int, default=4, help="ranges of way ids; an interrupted run goes on with the next one")
    for name, text in (("join", "ways into streets"), ("threshold", "street pairs that are nearly joined")):
        p = command(name, text)
        p.add_argument("database")
        p.add_argument("-t", "--threshold", type=float, default=100.0, metavar="METERS")
        if name == "join":
            p.add_argument("--steps", type=int, default=4, help="buckets of names; an interrupted run goes on with the next one")
    p = command("prefixes", "frequent first words that are no known street type")
    p.add_argument("input")
    p = command("map", "grid of a name's prominence")
    p.add_argument("database")
    p.add_argument("target")
    p.add_argument("-o", "--output")
    p.add_argument("--cell", type=float, default=10.0, metavar="KM")
    p.add_argument("--min-streets", type=int, default=42)
    p = command("kpi", "distribution figures of every name")
    p.add_argument("database")
    p.add_argument("-n", "--min-count", type=int, default=20)
    p.add_argument("-o", "--output")
    p = command("alias", "relabel street keys")
    p.add_argument("database")
    p.add_argument("-a", "--aliases")
    p = command("cities", "municipalities with a street that matches patterns")
    p.add_argument("database")
    p.add_argument("patterns")
    p.add_argument("-r", "--region", type=int, metavar="ID")
    p.add_argument("-m", "--map", nargs="?", const=_DERIVED, dest="map_path")
    return top


def _dump(spark: SparkSession, args: argparse.Namespace) -> tuple[osm.Dump, Store]:
    osm.validate_input(args.input)
    where = args.database_opt or args.database or files.store_path(args.input)
    return osm.read(spark, args.input), Store(spark, where)


def run_extract(spark: SparkSession, args: argparse.Namespace, say: Reporter) -> None:
    dump, store = _dump(spark, args)
    if store.parts("ways_parts"):
        say.info(f"extract: going on behind way {max(map(int, store.parts('ways_parts')))}")
    parsed, unnamed = extract_in_steps(store, dump.nodes, dump.ways, args.steps)
    say.debug(f"extract: {parsed} ways, {unnamed} without a name")
    store.write("squares", osm.squares(dump))
    say.progress(f"extract: {store.read('squares').count()} named squares")
    say.set_counts(parsed=parsed, groups=store.header()["groups"])
    say.summary()


def run_areas(spark: SparkSession, args: argparse.Namespace, say: Reporter) -> None:
    dump, store = _dump(spark, args)
    store.write("areas", osm.admin_areas(dump))
    say.progress(f"areas: {store.read('areas').count()} boundaries")


def run_join(spark: SparkSession, args: argparse.Namespace, say: Reporter) -> None:
    store = Store(spark, args.database)
    header = store.header()
    say.debug(f"join: {args.steps} buckets, {len(store.parts(f'streets_parts/of={args.steps}'))} of them done before")
    for way in streets.unmeasurable(store.read("ways")).select("way_id").toLocalIterator():
        say.warn(f"way {way.way_id}: no distances, as a vertex is not a place; it joins by shared nodes only")
    made = join_in_buckets(store, args.threshold, buckets=args.steps)
    sinks.print_groups(streets.top_groups(store.read("street_groups"), 10).collect(), sys.stdout)
    say.set_counts(parsed=header["parsed"], groups=header["groups"], streets=made)
    say.summary()


def run_threshold(spark: SparkSession, args: argparse.Namespace, say: Reporter) -> None:
    store = Store(spark, args.database)
    pairs = streets.near_misses(store.read("ways"), args.threshold).persist()
    n = pairs.count()
    if n:
        sinks.print_pairs(pairs.toLocalIterator(), sys.stdout)
    say.progress(f"threshold: {n} pairs")
    header = store.header()
    say.set_counts(parsed=header["parsed"], groups=header["groups"])
    say.summary()


def run_prefixes(spark: SparkSession, args: argparse.Namespace, say: Reporter) -> None:
    osm.validate_input(args.input)
    dump = osm.read(spark, args.input)
    words = points.first_words(osm.highways(dump.nodes, dump.ways)).collect()
    sinks.print_words(words, sys.stdout)
    say.progress(f"prefixes: {len(words)} words")


def run_map(spark: SparkSession, args: argparse.Namespace, say: Reporter) -> None:
    store = Store(spark, args.database)
    made = store.read("streets")
    size = args.cell * 1000
    cells = points.grid(points.street_points(made, store.read("ways")), args.target, size, args.min_streets).persist()
    label = streets.street_display_names(made).where(F.col("norm_name") == args.target).first()
    whole = cells.agg(F.max("total_streets").alias("t"), F.max("matching_streets").alias("m"), F.count_if("populated").alias("scored"), F.count("*").alias("n")).first()
    if not whole.t:
        say.warn(f"no streets in {args.database}; run join first")
    elif not whole.m:
        say.warn(f"no street has the key {args.target!r}")
    if whole.t and not whole.scored:
        say.warn(f"no cell has {args.min_streets} streets")
    out = sinks.draw_grid(cells, args.output or files.map_path(args.database, args.target), size, label.name if label else args.target)
    say.progress(f"map: {whole.m or 0}/{whole.t or 0} streets, {whole.scored} cells scored, {whole.n - whole.scored} sparse -> {out}")


def run_kpi(spark: SparkSession, args: argparse.Namespace, say: Reporter) -> None:
    store = Store(spark, args.database)
    areas = store.read("areas")
    if areas.where("admin_level = '4'").isEmpty():
        say.warn(f"no region boundaries in {args.database}; regional figures stay blank (run areas)")
        areas = None
    found = points.street_points(store.read("streets"), store.read("ways"))
    out = args.output or files.kpi_path(args.database)
    text = io.StringIO(newline="")
    rows = sinks.write_kpis(stats.kpis(found, args.min_count, areas=areas).toLocalIterator(), text)
    paths.write_text(out, text.getvalue(), spark)
    if store.read("streets").isEmpty():
        say.warn(f"no streets in {args.database}; run join first")
    elif not rows:
        say.warn(f"no name has more than {args.min_count} streets")
    say.progress(f"kpi: {rows} names -> {out}")


def run_alias(spark: SparkSession, args: argparse.Namespace, say: Reporter) -> None:
    mapping = files.parse_aliases(args.aliases or files.alias_path(args.database))
    files.check_aliases(mapping)
    store = Store(spark, args.database)
    made, table = store.read("streets"), aliases.mapping_frame(spark, mapping)
    missing = sorted(r.variant for r in aliases.unknown(table, made).collect())
    if missing:
        say.warn(f"{len(missing)} variants that no street has: {', '.join(missing)}")
    moved = aliases.relabel_counts(made, table).collect()
    store.write("streets", aliases.relabelled(made, table))
    store.write("street_groups", streets.street_groups(store.read("streets")))
    for row in moved:
        print(f"{row.moved} - {row.variant}")
    print(f"total: {sum(r.moved for r in moved)}")
    say.progress(f"alias: {len(mapping)} mappings")


def run_cities(spark: SparkSession, args: argparse.Namespace, say: Reporter) -> None:
    store = Store(spark, args.database)
    if not store.present():
        raise FileNotFoundError(f"{args.database} does not exist; run extract first")
    wanted = files.parse_patterns(args.patterns)
    if store.read("areas").isEmpty():
        raise cities.RegionError(f"no boundaries in {args.database}; run areas first")
    towns = cities.municipalities(store.read("areas"), args.region)
    found = points.matched_ways(store.read("ways"), wanted.includes, wanted.excludes).unionByName(points.matched_squares(store.read("squares"), wanted.includes, wanted.excludes))
    flagged = cities.flagged(towns, found).persist()
    column, out = paths.stem_of(args.patterns), files.cities_path(args.database)
    rows = sinks.write_report(spark, out, cities.report(flagged, column), column)
    say.progress(f"cities: {flagged.where('matched').count()} of {rows} ({found.count()} streets and squares) -> {out}")
    if args.map_path is not None:
        path = files.cities_map_path(args.database, args.patterns) if args.map_path is _DERIVED else args.map_path
        drawn, n = sinks.draw_cities(flagged, path, column, geo.TransverseMercator())
        say.progress(f"cities: {n} boundaries -> {drawn}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    say = Reporter(verbosity=args.verbosity)
    try:
        globals()[f"run_{args.command}"](spark or get_spark(), args, say)
    except (osm.InputError, files.AliasError, files.PatternError, cities.RegionError, OSError) as problem:
        say.warn(str(problem))
    except KeyboardInterrupt:
        print("interrupted; run it again to go on", file=sys.stderr)
        return 130
    return say.exit_code


if __name__ == "__main__":
    sys.exit(main())
