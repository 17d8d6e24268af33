"""Text tables and drawings made on the driver from results of bounded size."""

from __future__ import annotations

import csv
import importlib.util
import io
from collections.abc import Iterable
from html import escape
from typing import TextIO

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from odonymy import paths
from odonymy.functions import geo
from odonymy.operators import cities
from odonymy.operators.stats import KPI_COLUMNS

#: Decimals of each number, rounded half to even on the exact value.
_DECIMALS = {"mean_lon": 6, "mean_lat": 6, "std_distance_km": 3, "top_region_lq": 3, "top_region_share": 4, "effective_regions": 2, "region_gini": 4, "skew_score": 4}


CITY_COLOURS = {True: "#d7301f", False: "#9ecae1"}


def print_groups(groups: Iterable[Row], out: TextIO) -> None:
    print("count", "norm_name", "name", sep="\t", file=out)
    for g in groups:
        print(g["count"], g.norm_name, g.name, sep="\t", file=out)


def print_pairs(pairs: Iterable[Row], out: TextIO, header: bool = True) -> None:
    if header:
        print("distance_m", "way_id_a", "way_id_b", "norm_name", "name", sep="\t", file=out)
    for p in pairs:
        print(f"{p.distance_m:.2f}", p.way_id_a, p.way_id_b, p.norm_name, p.name, sep="\t", file=out)


def print_words(words: Iterable[Row], out: TextIO) -> None:
    for w in words:
        print(w["count"], w.word, sep="\t", file=out)


def write_kpis(kpis: Iterable[Row], out: TextIO) -> int:
    """CSV of KPI rows; null cells are blank. Returns the number of rows."""
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(KPI_COLUMNS)
    n = 0
    for row in kpis:
        cells = ((c, row[c]) for c in KPI_COLUMNS)
        writer.writerow("" if v is None else f"{v:.{_DECIMALS[c]}f}" if c in _DECIMALS else v for c, v in cells)
        n += 1
    return n


def read_report(spark: SparkSession, path: object) -> DataFrame | None:
    """A wide report with its row order as seq; None if there is none yet."""
    if not paths.is_file(path, spark):
        return None
    header, *rows = csv.reader(io.StringIO(paths.read_text(path, spark), newline=""))
    schema = "seq long, " + ", ".join(f"`{c}` string" for c in header)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def write_report(spark: SparkSession, path: object, new: DataFrame, column: str) -> int:
    """Merges a run (as from ``cities.report``) into the CSV; returns the run's rows."""
    merged = cities.merge(read_report(spark, path), new, column)
    rows = merged.collect()  # a row for each municipality
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(merged.columns)
    writer.writerows(rows)
    paths.write_text(path, text.getvalue(), spark)
    return new.count()


def _svg(path: object, shapes: list[str], box: tuple[float, float, float, float], title: str, note: str = "") -> str:
    """Writes a drawing with y upwards. Without a plotting library the file is SVG, whatever was asked for."""
    path = paths.beside(path, f"{paths.stem_of(path)}.svg")
    x0, y0, x1, y1 = box
    w, h = max(x1 - x0, 1e-9), max(y1 - y0, 1e-9)
    size = max(w, h) / 40
    text = f'<text x="{x0}" y="{-y1 - size}" font-size="{size}">{escape(title)}</text><text x="{x0}" y="{-y0 + 2 * size}" font-size="{size * 0.7}">{escape(note)}</text>'
    paths.write_text(path, f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{x0 - size} {-y1 - 3 * size} {w + 2 * size} {h + 6 * size}"><defs><pattern id="sparse" width="{size}" height="{size}" patternUnits="userSpaceOnUse"><path d="M0 {size}L{size} 0" stroke="#999" stroke-width="{size / 10}"/></pattern></defs>{"".join(shapes)}{text}</svg>')
    return path


def quotient_colour(lq: float) -> str:
    """Blue under 1, white at 1, red over 1 (full at 0 and at 2)."""
    t = max(-1.0, min(1.0, lq - 1.0))
    fade = round(255 * (1 - abs(t)))
    return f"#ff{fade:02x}{fade:02x}" if t > 0 else f"#{fade:02x}{fade:02x}ff"


def draw_grid(cells: DataFrame, path: object, cell_size: float, label: str) -> str:
    """Cells coloured by location quotient, sparse ones hatched. With matplotlib installed: a PNG."""
    rows = cells.collect()  # bounded by the mapped area over the cell size
    if importlib.util.find_spec("matplotlib"):
        return _plot_grid(rows, path, cell_size, label)
    shapes = [f'<rect x="{r.x}" y="{-r.y - cell_size}" width="{cell_size}" height="{cell_size}" fill="{quotient_colour(r.lq) if r.populated else "url(#sparse)"}"><title>{r.matches}/{r.total} ({100 * r.ratio:.2f} %)</title></rect>' for r in rows]
    box = (min((r.x for r in rows), default=0), min((r.y for r in rows), default=0), max((r.x for r in rows), default=0) + cell_size, max((r.y for r in rows), default=0) + cell_size)
    note = f"average {100 * rows[0].global_ratio:.2f} %" if any(r.populated for r in rows) else "no cell has enough streets"
    return _svg(path, shapes, box, label, note)


def _png(figure, path: object) -> str:
    data = io.BytesIO()
    figure.savefig(data, format="png")
    paths.write_bytes(path, data.getvalue())
    return str(path)


def _plot_grid(rows: list[Row], path: object, cell_size: float, label: str) -> str:
    from matplotlib.cm import ScalarMappable
    from matplotlib.colors import ListedColormap, Normalize
    from matplotlib.figure import Figure
    from matplotlib.patches import Rectangle

    axes = (figure := Figure(figsize=(10, 10))).subplots()
    for r in rows:
        style = {"facecolor": quotient_colour(r.lq)} if r.populated else {"facecolor": "none", "hatch": "//"}
        axes.add_patch(Rectangle((r.x, r.y), cell_size, cell_size, **style))
    if average := next((r.global_ratio for r in rows if r.populated), 0.0):
        scale = ScalarMappable(Normalize(0, 2 * average), ListedColormap([quotient_colour(k / 50) for k in range(101)]))
        bar = figure.colorbar(scale, ax=axes, label=f"share of streets, average {100 * average:.2f} %", ticks=[0, average, 2 * average])
        bar.set_ticklabels([f"{100 * v:.2f} %" for v in (0, average, 2 * average)])
    else:
        axes.set_xlabel("no cell has enough streets")
    axes.set_title(label)
    axes.autoscale()
    axes.set_aspect("equal")
    return _png(figure, path)


def city_outlines(flagged: DataFrame, projection) -> DataFrame:
    """matched and the outer rings, in the plane, of each municipality that has an outline."""
    rings = F.transform(geo.project_geometry(F.col("geometry"), projection), lambda polygon: polygon[0])
    return flagged.where(F.size("geometry") > 0).select("area_seq", "matched", rings.alias("rings"))


def draw_cities(flagged: DataFrame, path: object, label: str, projection) -> tuple[str, int]:
    """Outer rings of the municipalities, warm where matched; a PNG if matplotlib is installed. Returns the number drawn."""
    rows = city_outlines(flagged, projection).collect()  # a few thousand municipalities
    if importlib.util.find_spec("matplotlib"):
        return _plot_cities(rows, path, label), len(rows)
    points = [p for r in rows for ring in r.rings for p in ring]
    path_of = lambda ring: "M" + "L".join(f"{p.x} {-p.y}" for p in ring) + "Z"
    shapes = [f'<path d="{"".join(map(path_of, r.rings))}" fill="{CITY_COLOURS[r.matched]}" stroke="#fff"/>' for r in rows]
    box = (min((p.x for p in points), default=0), min((p.y for p in points), default=0), max((p.x for p in points), default=1), max((p.y for p in points), default=1))
    return _svg(path, shapes, box, label), len(rows)


def _plot_cities(rows: list[Row], path: object, label: str) -> str:
    from matplotlib.figure import Figure
    from matplotlib.patches import Polygon

    axes = (figure := Figure(figsize=(10, 10))).subplots()
    for r in rows:
        for ring in r.rings:
            axes.add_patch(Polygon([(p.x, p.y) for p in ring], facecolor=CITY_COLOURS[r.matched], edgecolor="#fff"))
    axes.set_title(label)
    axes.autoscale()
    axes.set_aspect("equal")
    return _png(figure, path)
