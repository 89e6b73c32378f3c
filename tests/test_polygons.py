"""Burning, centroids and binary geometry against plain loops."""

import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isotherm.operators import polygons
from isotherm.sources import geometry, tables

RINGS = "raster_id int, rings array<array<struct<lon:double,lat:double>>>"


def burnt(df, **how):
    return {(r.lat_i, r.lon_i): r.raster_id for r in polygons.burn(df, **how).collect()}


def touches(rings, west, south, step):
    """Brute force: middle inside all rings by even-odd, or an edge clipped to the closed cell."""
    x, y = west + step / 2, south + step / 2
    inside = hit = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                inside = not inside
            low, high = 0.0, 1.0
            for p, d, a, b in ((x0, x1 - x0, west, west + step), (y0, y1 - y0, south, south + step)):
                if d == 0:
                    low = 2.0 if p < a or p > b else low
                else:
                    low, high = max(low, min((a - p) / d, (b - p) / d)), min(high, max((a - p) / d, (b - p) / d))
            hit |= low <= high
    return inside or hit


def test_later_wins_and_touches(spark):
    square = lambda w, s, e, n: [[(w, s), (e, s), (e, n), (w, n), (w, s)]]
    df = spark.createDataFrame([(0, square(0.2, 0.2, 1.8, 1.8)), (1, square(1.6, 1.6, 2.4, 2.4))], RINGS)
    got = {(90 - a, o - 180): v for (a, o), v in burnt(df, step=1.0).items()}
    assert got == {(a, o): (1 if a == o == 2 else 0) for a in (0, 1, 2) for o in (0, 1, 2)}


@pytest.mark.parametrize("step", [1.0, 0.5])
def test_as_brute_force(spark, step):
    """Stars with holes and islands, open and closed rings."""
    g = np.random.default_rng(4)
    rows = []
    for i in range(6):
        lon, lat = g.uniform(-40, 40), g.uniform(-40, 40)
        rings = []
        for size in (6.0, 3.0, 1.1):  # outline, hole, island
            t = np.sort(g.uniform(0, 2 * math.pi, 23))
            r = size * g.uniform(0.75, 1, 23)
            ring = [(float(lon + a * math.cos(b)), float(lat + a * math.sin(b))) for a, b in zip(r, t, strict=True)]
            rings.append(ring if size == 3.0 else [*ring, ring[0]])
        rows.append((i, rings))
    got = burnt(spark.createDataFrame(rows, RINGS), step=step)
    want = {}
    for i, rings in rows:
        closed = [r if r[0] == r[-1] else [*r, r[0]] for r in rings]
        every = np.concatenate([np.array(r) for r in closed])
        for c in range(int((every[:, 0].min() + 180) / step) - 1, int((every[:, 0].max() + 180) / step) + 2):
            for k in range(int((90 - every[:, 1].max()) / step) - 1, int((90 - every[:, 1].min()) / step) + 2):
                if touches(closed, -180 + (c - 0.5) * step, 90 - (k + 0.5) * step, step):
                    want[k, c] = i
    assert got == want and len(set(got.values())) == 6


def test_over_the_date_line(spark):
    """Two degrees around 180, as a ring and with its longitudes beyond 180; its hole is not burnt."""
    ring = [(170.2, 10.2), (-170.2, 10.2), (-170.2, 19.8), (170.2, 19.8), (170.2, 10.2)]
    hole = [(175.6, 12.6), (-175.6, 12.6), (-175.6, 17.4), (175.6, 17.4), (175.6, 12.6)]
    beyond = [[(x + 360 if x < 0 else x, y) for x, y in r] for r in (ring, hole)]
    got = burnt(spark.createDataFrame([(1, [ring, hole])], RINGS), step=1.0)
    assert got == burnt(spark.createDataFrame([(1, beyond)], RINGS), step=1.0)
    columns = [*range(350, 360), *range(11)]
    want = {(90 - y, c) for y in range(10, 21) for c in columns} - {(90 - y, c) for y in range(14, 17) for c in (357, 358, 359, 0, 1, 2, 3)}
    assert set(got) == want
    assert len(burnt(spark.createDataFrame([(1, [ring])], RINGS), step=1.0)) == 11 * 21


def test_around_a_pole(spark):
    """A ring along the date line and the pole, as continents at a pole are drawn."""
    ring = [(-180.0, -90.0), (180.0, -90.0), (180.0, -80.2), (0.0, -79.8), (-180.0, -80.2), (-180.0, -90.0)]
    got = burnt(spark.createDataFrame([(1, [ring])], RINGS), step=1.0)
    assert {a for a, _ in got} == set(range(170, 181)) and len(got) == 11 * 360
    # one that goes round and crosses the date line once: what lies under the crossing is inside
    round_ = [(-90.0, -80.0), (0.0, -80.0), (90.0, -80.0), (-170.0, -80.0), (-90.0, -80.0)]
    assert len(burnt(spark.createDataFrame([(1, [round_])], RINGS), step=1.0)) == 11 * 360


def test_missing_rings_and_points(spark):
    full = [(0.2, 0.2), (1.8, 0.2), (1.8, 1.8), (0.2, 1.8)]
    rows = [(1, None), (2, []), (3, [None, []]), (4, [[(5.0, 5.0)]]), (5, [[(float("nan"), 7.0), *full, None]]), (6, [[(None, 1.0)]])]
    assert set(burnt(spark.createDataFrame(rows, RINGS), step=1.0).values()) == {5}
    assert burnt(spark.createDataFrame([], RINGS), step=1.0) == {}


def test_a_million_edges_spread_over_tasks(spark):
    n = 1_000_000
    t = lambda k: F.lit(2 * math.pi / n) * k
    radius = lambda a: F.lit(20.0) + F.lit(0.05) * F.sin(a * 20_000)
    point = lambda k, i: [(radius(t(k)) * F.cos(t(k))).alias(f"x{i}"), (radius(t(k)) * F.sin(t(k))).alias(f"y{i}")]
    edges = spark.range(0, n, 1, 8).select(F.lit(7).alias("raster_id"), *point(F.col("id"), 0), *point((F.col("id") + 1) % n, 1))
    cells = polygons.burn_edges(edges, step=0.1)
    got = {(r.lat_i, r.lon_i) for r in cells.collect()}
    lat, lon = np.meshgrid(np.arange(650, 1151), np.arange(1550, 2051), indexing="ij")
    far = np.hypot(90 - lat * 0.1, lon * 0.1 - 180)
    must, may = far < 19.9, far < 20.2
    assert {(int(a), int(o)) for a, o in zip(lat[must], lon[must], strict=True)} <= got <= {(int(a), int(o)) for a, o in zip(lat[may], lon[may], strict=True)}
    # the rows of one polygon are dealt by row: no task has most of the crossings
    met = polygons.rows_of(polygons.cut_at_date_line(edges, "raster_id", -91.0), "raster_id", 0.1, 1801).where("x is not null")
    shares = [r["count"] for r in met.repartition(8, "raster_id", "row").groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 8 and max(shares) < sum(shares) / 3


# ---- centroids and binary ------------------------------------------------------------------


def box(w, s, e, n):
    return [(float(x), float(y)) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]


SHAPES = [None, [], [[box(0, 0, 2, 1)]], [[box(0, 0, 4, 4), box(1, 1, 2, 2)[::-1]]], [[box(0, 0, 4, 4)[::-1], box(1, 1, 2, 2)[::-1]], [box(10, 10, 12, 12)]], [[[(1.0, 1.0), (1.0, 1.0)]]], [[]]]


def shapes(spark):
    return spark.createDataFrame(list(enumerate(SHAPES)), f"id int, polygons {geometry.POLYGONS}")


def test_centroids(spark):
    lon, lat = polygons.centroid(F.col("polygons"))
    got = {r.id: (r.lon, r.lat) for r in shapes(spark).select("id", lon.alias("lon"), lat.alias("lat")).collect()}
    assert got[2] == (1, 0.5) and got[3] == pytest.approx(((32 - 1.5) / 15,) * 2) and got[4] == pytest.approx(((32 - 1.5 + 44) / 19,) * 2)
    assert all(got[i] == (None, None) for i in (0, 1, 5, 6))


def plain(shape):
    return None if shape is None else [[[tuple(p) for p in ring] for ring in polygon] for polygon in shape]


@pytest.mark.parametrize("big", [False, True])
def test_binary_round_trip(spark, big, tmp_path):
    df = shapes(spark).repartition(2)
    held = df.select("id", geometry.binary_of("polygons", big).alias("geometry"))
    back = {r.id: plain(r.p) for r in held.select("id", geometry.polygons_of("geometry").alias("p")).collect()}
    assert back == {i: plain([p for p in s] if s is not None and s != [[]] else (None if s is None else [])) for i, s in enumerate(SHAPES)}
    tables.write_vectors(df, str(tmp_path / "v"))
    assert {r.id: plain(r.polygons) for r in tables.read_vectors(spark, str(tmp_path / "v")).collect()} == back
    assert tables.read_vectors(spark, str(tmp_path / "v"), ignore=["geometry"]).columns == ["id"]


def test_binary_of_others():
    """Bytes by hand: both orders, further dimensions marked in two ways, a reference system, the header of a feature file."""
    ring = [(0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 0.0)]
    want = [[ring]]

    def blob(order, code, points, extra=b""):
        return {"<": b"\1", ">": b"\0"}[order] + struct.pack(order + "I", code) + extra + struct.pack(order + "II", 1, len(points)) + b"".join(struct.pack(f"{order}{len(p)}d", *p) for p in points)

    deep, deeper = [(*p, 9.0) for p in ring], [(*p, 9.0, 8.0) for p in ring]
    blobs = [
        blob("<", 3, ring), blob(">", 3, ring), blob("<", 1003, deep), blob(">", 2003, deep), blob("<", 3003, deeper), blob("<", 0x80000003, deep), blob(">", 0x60000003, deep, struct.pack(">I", 4326)),
        b"GP\0" + bytes([1 | 1 << 1]) + struct.pack("<i", 4326) + bytes(32) + blob("<", 3, ring),
        b"\0" + struct.pack(">II", 6, 1) + blob("<", 3, ring),
    ]
    got = geometry.decode(pa.array([*blobs, b"GP\0" + bytes([16]) + bytes(4), None], pa.binary())).to_pylist()
    assert [None if x is None else [[[(p["lon"], p["lat"]) for p in r] for r in poly] for poly in x] for x in got] == [want] * 9 + [[], None]
    with pytest.raises(ValueError, match="no polygon"):
        geometry.decode(pa.array([b"\1" + struct.pack("<Idd", 1, 0, 0)], pa.binary()))
    sliced = pa.concat_arrays([geometry.decode(pa.array(blobs[:3], pa.binary()))])[1:]
    assert geometry.encode(sliced).to_pylist() == [blobs[0]] * 2
