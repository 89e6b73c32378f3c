"""Polygons onto grid cells by banded scan conversion, on rows of edges.

A polygon is a set of edges; each edge goes to the grid rows that it meets, so the work of a large polygon spreads
over its rows and no task holds one.  Within a row an edge touches a span of columns, and
the crossings of the row's middle, sorted, bound the spans inside by the even-odd rule over all
rings of a unit: holes are rings, and so are the parts of a multipolygon.

An edge whose ends are more than 180 degrees apart (but not the whole circle) crosses the date line.  It is cut there; what lies between such
cuts on the date line is inside as far as their number above is odd.  An edge of the whole circle runs along its
parallel, as polygons around a pole have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.scalar import missing_is_null
from isotherm.operators.zonal import last_wins

NORTH, WEST = 90.0, -180.0


def _vertices(ring: Column) -> Column:
    """A closed ring without points that lack a coordinate."""
    known = F.filter(ring, lambda p: missing_is_null(p["lon"]).isNotNull() & missing_is_null(p["lat"]).isNotNull())
    return F.when((F.size(known) > 1) & (F.element_at(known, 1) != F.element_at(known, -1)), F.concat(known, F.slice(known, 1, 1))).otherwise(known)


def edges_of(units: DataFrame, raster_id: str = "raster_id", rings: str = "rings") -> DataFrame:
    """``raster_id, x0, y0, x1, y1`` of every edge; null rings and rings of one point have none."""
    ring = units.select(raster_id, F.explode(rings).alias("_ring")).where("_ring is not null").select(raster_id, _vertices(F.col("_ring")).alias("_p"))
    n = F.greatest(F.size("_p") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("_p", F.lit(1), n).alias("a"), F.slice("_p", F.lit(2), n).alias("b"))
    each = ring.select(raster_id, F.explode(pairs).alias("e"))
    return each.select(raster_id, *[F.col(f"e.{end}.{axis}").cast("double").alias(f"{name}{i}") for i, end in enumerate("ab") for axis, name in (("lon", "x"), ("lat", "y"))])


def cut_at_date_line(edges: DataFrame, raster_id: str, south: float) -> DataFrame:
    """Edges that stay on one side, with ``outline``: false for those along the date line that only count for what is inside."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    dx = x1 - x0
    crosses = (F.abs(dx) > 180) & (F.abs(dx) < 360)
    side = F.when(dx > 180, F.lit(-180.0)).otherwise(F.lit(180.0))  # left to the west, or to the east
    there = dx - F.when(dx > 180, F.lit(360.0)).otherwise(F.lit(-360.0))
    y = F.when(there == 0, y0).otherwise(y0 + (y1 - y0) * (side - x0) / there)
    edge = lambda a, b, c, d, outline: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"), F.lit(outline).alias("outline"))
    along = [edge(F.lit(s), y, F.lit(s), F.lit(south), False) for s in (-180.0, 180.0)]
    parts = F.when(crosses, F.array(edge(x0, y0, side, y, True), edge(-side, y, x1, y1, True), *along)).otherwise(F.array(edge(x0, y0, x1, y1, True)))
    return edges.select(raster_id, F.explode(parts).alias("e")).select(raster_id, "e.*")


def rows_of(edges: DataFrame, raster_id: str, step: float, n_rows: int) -> DataFrame:
    """``raster_id, row, first, last, x``: the columns that an edge touches in a row, and where it crosses the row's middle."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    top = F.greatest(F.ceil((F.lit(NORTH) - high) / step - 0.5), F.lit(0)).cast("int")
    bottom = F.least(F.floor((F.lit(NORTH) - low) / step + 0.5), F.lit(n_rows - 1)).cast("int")
    each = edges.select("*", F.explode(F.when(top <= bottom, F.sequence(top, bottom))).alias("row"))
    middle, dy = F.lit(NORTH) - F.col("row") * F.lit(step), F.col("y1") - F.col("y0")
    at = lambda t: F.col("x0") + (F.col("x1") - F.col("x0")) * t
    ends = [F.when(dy != 0, (middle + half - F.col("y0")) / dy) for half in (-step / 2, step / 2)]
    enter = F.when(dy == 0, at(F.lit(0.0))).otherwise(at(F.greatest(F.least(*ends), F.lit(0.0))))
    leave = F.when(dy == 0, at(F.lit(1.0))).otherwise(at(F.least(F.greatest(*ends), F.lit(1.0))))
    column = lambda x: (x - F.lit(WEST)) / step
    crossing = F.when((low <= middle) & (middle < high), at((middle - F.col("y0")) / dy))
    touched = lambda c: F.when(F.col("outline"), c).cast("int")
    return each.select(
        raster_id, "row", touched(F.ceil(column(F.least(enter, leave)) - 0.5)).alias("first"), touched(F.floor(column(F.greatest(enter, leave)) + 0.5)).alias("last"), crossing.alias("x")
    )


def burn_edges(edges: DataFrame, raster_id: str = "raster_id", step: float = 0.1) -> DataFrame:
    """``lat_i, lon_i, raster_id`` of all cells that a unit touches with its area or outline; of several units the largest id stays."""
    n_rows, n_columns = round(180 / step) + 1, round(360 / step)
    met = rows_of(cut_at_date_line(edges, raster_id, NORTH - n_rows * step - 1), raster_id, step, n_rows)
    outline = met.where("first <= last").select(raster_id, "row", "first", "last")
    along = Window.partitionBy(raster_id, "row").orderBy("x")
    sorted_ = met.where("x is not null").select(raster_id, "row", "x", F.row_number().over(along).alias("k"), F.lead("x").over(along).alias("next")).where("k % 2 = 1")
    # a cell is inside if its middle is
    column = lambda c: F.ceil((F.col(c) - F.lit(WEST)) / step).cast("int")
    inside = sorted_.select(raster_id, "row", column("x").alias("first"), (column("next") - 1).alias("last")).where("first <= last")
    spans = outline.unionByName(inside)
    cells = spans.select(F.col("row").alias("lat_i"), F.explode(F.sequence("first", "last")).alias("lon_i"), raster_id)
    return last_wins(cells.withColumn("lon_i", F.pmod("lon_i", F.lit(n_columns))), ["lat_i", "lon_i"], raster_id)


def burn(units: DataFrame, raster_id: str = "raster_id", rings: str = "rings", step: float = 0.1) -> DataFrame:
    """``burn_edges`` of units with ``rings``: an array of rings, each an array of structs lon, lat, closed or not.

    A unit whose rings are null, empty or without two points burns nothing.
    """
    return burn_edges(edges_of(units, raster_id, rings), raster_id, step)


# ---- centroids ----------------------------------------------------------------------------


def centroid(polygons: Column) -> tuple[Column, Column]:
    """Planar centroid (lon, lat) of an array of polygons, each an outer ring and its holes; NULL where the area is 0.

    Rings may turn either way: the first counts for, the others against.
    """

    def moments(ring: Column, sign: int) -> Column:
        p = _vertices(ring)
        pairs = F.arrays_zip(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))).alias("a"), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))).alias("b"))
        zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def add(s: Column, e: Column) -> Column:
            cross = e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
            return F.struct((s["area"] + cross).alias("area"), (s["x"] + (e["a"]["lon"] + e["b"]["lon"]) * cross).alias("x"), (s["y"] + (e["a"]["lat"] + e["b"]["lat"]) * cross).alias("y"))

        turned = lambda s: F.struct(*[(s[c] * F.signum(s["area"]) * sign).alias(c) for c in ("area", "x", "y")])
        return F.aggregate(pairs, zero, add, turned)

    rings = F.transform(polygons, lambda p: F.concat(F.transform(F.slice(p, 1, 1), lambda r: moments(r, 1)), F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda r: moments(r, -1))))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("area", "x", "y")])
    both = lambda s, m: F.struct(*[(s[c] + m[c]).alias(c) for c in ("area", "x", "y")])
    middle = lambda s: F.struct(*[F.when(s["area"] != 0, s[c] / (s["area"] * 3)).alias(c) for c in ("x", "y")])
    at = F.aggregate(F.flatten(rings), zero, both, middle)
    return at["x"], at["y"]
