from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from crashgrid.checks import queries as Q
from crashgrid.checks.fixtures import view
from crashgrid.functions import geo
from crashgrid.operators import spatial as X
from crashgrid.operators.joins import measured_join, restrict, salted_join

L_SHAPE = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 5), (0, 5)]
OUTER = [[0.0, 0.0], [6.0, 0.0], [6.0, 6.0], [0.0, 6.0], [0.0, 0.0]]
HOLE = [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]


def points(spark, pairs):
    return spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(pairs)],
        "id INT, longitude DOUBLE, latitude DOUBLE")


def ids(rows):
    return sorted(r["id"] for r in rows.select("id").collect())


def boundary(spark, polygons, key="A"):
    rows = spark.createDataFrame([(key, polygons)], f"place STRING, polygons {geo.POLYGONS}")
    return X.with_edges(rows)


GRID = [(x / 2, y / 2) for x in range(-2, 15) for y in range(-2, 15)]


def in_l(x, y):
    return (0 < x < 4 and 0 < y < 2) or (0 < x < 2 and 0 < y < 5)


def in_donut(x, y):
    return 0 < x < 6 and 0 < y < 6 and not (2 <= x <= 4 and 2 <= y <= 4)


def test_ring_is_strict_and_closed_automatically(spark):
    expected = [i for i, p in enumerate(GRID) if in_l(*p)]
    assert ids(X.within_ring(points(spark, GRID), L_SHAPE)) == expected
    assert ids(X.within_ring(points(spark, GRID), [*L_SHAPE, L_SHAPE[0]])) == expected
    with pytest.raises(ValueError):
        X.within_ring(points(spark, GRID), L_SHAPE[:2])


def test_long_ring_agrees_with_short_one(spark):
    """The same outline cut into many edges takes the gridded path."""
    ring = geo.close_ring(L_SHAPE)
    fine = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        fine += [(x1 + (x2 - x1) * k / 16, y1 + (y2 - y1) * k / 16) for k in range(16)]
    assert len(fine) > X.UNROLLED_EDGES
    assert ids(X.within_ring(points(spark, GRID), fine)) == [
        i for i, p in enumerate(GRID) if in_l(*p)]


@pytest.mark.parametrize("cell", [None, 0.3, 1.0, 2.5, 50.0])
@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_donut_join_for_any_grid_and_strategy(spark, cell, limit):
    donut = boundary(spark, [[OUTER, HOLE]])
    found = X.within_boundaries(points(spark, GRID), donut, cell=cell, broadcast_limit=limit)
    assert ids(found) == [i for i, p in enumerate(GRID) if in_donut(*p)]
    assert set(found.columns) == {"id", "longitude", "latitude", "place"}


def star(rng, cx, cy, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [[cx + rng.uniform(0.2, 1) * math.cos(a), cy + rng.uniform(0.2, 1) * math.sin(a)] for a in angles]
    return [*ring, ring[0]]


def crossing(x, y, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_overlapping_polygons_against_brute_force(spark, seed):
    rng = random.Random(seed)
    shapes = {f"s{k}": star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randint(3, 40)) for k in range(12)}
    pairs = [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(400)]
    places = spark.createDataFrame(
        [(k, [[r]]) for k, r in shapes.items()], f"place STRING, polygons {geo.POLYGONS}")
    found = X.within_boundaries(points(spark, pairs), X.with_edges(places), cell=rng.choice([0.1, 0.7, None]))
    got = {(r["id"], r["place"]) for r in found.collect()}
    want = {(i, k) for i, (x, y) in enumerate(pairs) for k, r in shapes.items() if crossing(x, y, r)}
    assert got == want


def vincenty(lon1, lat1, lon2, lat2):
    """Inverse geodesic on WGS84 by Vincenty's published iteration."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(v))) for v in (lat1, lat2))
    big_l = math.radians(lon2 - lon1)
    lam = big_l
    for _ in range(200):
        s = math.hypot(math.cos(u2) * math.sin(lam),
                       math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(s, c)
        sin_alpha = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        cos2 = 1 - sin_alpha**2
        cm = c - 2 * math.sin(u1) * math.sin(u2) / cos2
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        new = big_l + (1 - k) * f * sin_alpha * (sigma + k * s * (cm + k * c * (2 * cm**2 - 1)))
        if abs(new - lam) < 1e-13:
            break
        lam = new
    v = cos2 * (a**2 - b**2) / b**2
    big_a = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
    big_b = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
    delta = big_b * s * (cm + big_b / 4 * (c * (2 * cm**2 - 1)
                         - big_b / 6 * cm * (4 * s**2 - 3) * (4 * cm**2 - 3)))
    return b * big_a * (sigma - delta)


def test_distance_is_millimetre_exact_within_five_miles(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        lon, lat = rng.uniform(-87.95, -87.5), rng.uniform(41.6, 42.1)
        pairs.append((lon, lat, lon + rng.uniform(-0.07, 0.07), lat + rng.uniform(-0.05, 0.05)))
    rows = spark.createDataFrame(pairs, "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    got = rows.select("*", geo.distance_m(*map(F.col, "abcd")).alias("m")).collect()
    assert max(abs(r["m"] - vincenty(r["a"], r["b"], r["c"], r["d"])) for r in got) < 1e-3


def test_radius_box_never_cuts_the_circle(spark):
    rng = random.Random(6)
    center = (-87.7, 41.85)
    pairs = [(center[0] + rng.uniform(-0.12, 0.12), center[1] + rng.uniform(-0.09, 0.09)) for _ in range(2000)]
    found = ids(X.within_radius(points(spark, pairs), *center, 26_400.0))
    assert found == [i for i, p in enumerate(pairs) if vincenty(*center, *p) <= 26_400 * 0.3048]


@pytest.mark.parametrize("radius", [0.0, -1.0, 26_400.1])
def test_radius_range(spark, radius):
    with pytest.raises(ValueError):
        X.within_radius(points(spark, [(0, 0)]), 0.0, 0.0, radius)


@pytest.mark.parametrize("limit", [0, 1_000_000])
@pytest.mark.parametrize("latitude", [0.0, 41.8, 70.0])
def test_near_sites_against_brute_force(spark, limit, latitude):
    rng = random.Random(7)
    pairs = [(rng.uniform(0, 0.05), latitude + rng.uniform(0, 0.05)) for _ in range(300)]
    sites = [(k, rng.uniform(0, 0.05), latitude + rng.uniform(0, 0.05)) for k in range(40)]
    site_rows = spark.createDataFrame(sites, "site INT, site_longitude DOUBLE, site_latitude DOUBLE")
    found = X.near_sites(points(spark, pairs), site_rows, 700.0, broadcast_limit=limit).collect()
    want = {(i, k) for i, p in enumerate(pairs) for k, x, y in sites if vincenty(*p, x, y) <= 700.0}
    assert {(r["id"], r["site"]) for r in found} == want and len(found) == len(want)


def test_nearest_place(spark):
    places = X.with_edges(spark.createDataFrame(
        [("far", [[[[10.0, 10.0], [11.0, 10.0], [11.0, 11.0], [10.0, 10.0]]]]), ("donut", [[OUTER, HOLE]])],
        f"place STRING, polygons {geo.POLYGONS}"))

    def at(lon, lat):
        row = X.nearest_place(places, lon, lat, "place").first()
        return row["place"], row["distance"]

    assert at(1.0, 1.0) == ("donut", 0.0)
    assert at(3.0, 2.5) == ("donut", 0.5)
    assert at(9.0, 6.0) == ("donut", 3.0)
    assert at(12.0, 11.0) == ("far", 1.0)


def test_cells_of_an_area_drop_outside_and_mark_inside(spark):
    big = boundary(spark, [[[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]])
    cells = X.boundary_cells(big, 1.0)
    inner = cells.where("_inside")
    assert inner.count() == 64 and inner.where("edges IS NOT NULL").count() == 0
    rim = cells.where("NOT _inside")
    # A cell just outside the border may be listed: the border touches it.
    assert rim.agg(F.max(F.size("edges"))).first()[0] <= 3


def test_grid_bound_covers_the_cells(spark, sf):
    for places in (Q._ring_boundaries(spark, sf), X.with_edges(Q._zone_boundaries(spark, sf))):
        grid = X.fitting_grid(places)
        held = X.boundary_cells(places, grid.cell).agg(
            F.sum(1 + F.coalesce(F.size("edges"), F.lit(0)))).first()[0]
        assert held <= grid.edge_bound


def test_salted_join_equals_plain_join(spark):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(-1, "hot"), (1, "a"), (1, "b"), (7, "c"), (99, "none")], "k BIGINT, w STRING")
    plain = sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))
    for per_salt in (1, 40, 10_000):
        salted = salted_join(big, small, ["k"], ["v"], rows_per_salt=per_salt)
        assert sorted(map(tuple, salted.select("k", "v", "w").collect())) == plain
    for limit in (0, 100):
        joined = measured_join(big, small, ["k"], ["v"], limit=limit)
        assert sorted(map(tuple, joined.select("k", "v", "w").collect())) == plain
        kept = restrict(big, small.select("k"), ["k"], limit=limit).join(small, "k")
        assert kept.count() == len(plain)


def test_filters_reach_the_scan(spark, sf, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    view(spark, sf, "fx_crashes").write.parquet(folder)
    crashes = spark.read.parquet(folder)
    for rows in (
        X.within_radius(crashes, -87.7, 41.85, 5280.0),
        X.within_ring(crashes, Q.RING),
        X.within_edges(crashes, [(a, b, c, d) for a, b, c, d in
                                 geo.ring_edges(geo.close_ring(Q.RING))] * 8),
    ):
        plan = rows.select("crash_record_id")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(longitude," in plan and "LessThanOrEqual(latitude," in plan
        assert "injuries_total" not in plan


def test_literal_polygon_stays_in_generated_code(spark, sf, folder):
    view(spark, sf, "fx_crashes").write.parquet(folder)
    rows = X.within_ring(spark.read.parquet(folder), Q.RING).select("crash_record_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Filter" in plan and "aggregate(" not in plan


def test_geojson_and_wkt(spark):
    rows = spark.createDataFrame(
        [('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}',),
         ('{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}',),
         ('{"type":"Point","coordinates":[0,0]}',)], "g STRING")
    parsed = rows.select(geo.polygons_from_geojson(F.col("g")).alias("p"))
    sizes = parsed.select(F.size("p"), F.size(geo.edges_of(F.col("p")))).collect()
    assert [tuple(s) for s in sizes][:2] == [(1, 3), (2, 6)]
    assert parsed.collect()[2]["p"] is None
    wkt = spark.createDataFrame([("POINT(-87.5 41.6)",), ("POINT (1 2)",), ("LINE",)], "w STRING")
    got = [r[0] for r in wkt.select(geo.point_from_wkt(F.col("w"))).collect()]
    assert [tuple(p) for p in got] == [(-87.5, 41.6), (1.0, 2.0), (None, None)]


@pytest.mark.parametrize("cell, limit", [(None, 500_000), (0.05, 500_000), (0.05, 0), (0.013, 0)])
def test_counts_equal_pairs(spark, cell, limit):
    rng = random.Random(5)
    places = []
    for name in [*range(30), 3, 7, None]:
        x, y, r = rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(0.02, 0.4)
        ring = [(x, y - r), (x + r, y), (x + r / 3, y + r), (x, y + r / 4), (x - r, y + r), (x, y - r)]
        places.append((name, geo.ring_edges(ring)))
    boundaries = spark.createDataFrame(places, f"name int, edges array<struct<{geo.EDGE_DDL}>>")
    spots = [(rng.uniform(-0.2, 1.2), rng.uniform(-0.2, 1.2)) for _ in range(1500)] * 2 + [(None, 0.5), (0.5, None)]
    points = spark.createDataFrame(spots, "longitude double, latitude double")
    pairs = {r["name"]: r["count"] for r in X.within_boundaries(points, boundaries).groupBy("name").count().collect()}
    counted = X.count_within(points, boundaries, "name", cell=cell, broadcast_limit=limit)
    assert {r["name"]: r["points"] for r in counted.collect()} == pairs


def test_counting_joins_inner_points_as_one_row(spark, monkeypatch):
    """A boundary around all points meets their cells, not the points."""
    met = []
    join = X.salted_join
    monkeypatch.setattr(X, "salted_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    square = [(0, geo.ring_edges([(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0), (-1.0, -1.0)]))]
    boundaries = spark.createDataFrame(square, f"name int, edges array<struct<{geo.EDGE_DDL}>>")
    points = spark.range(5000).selectExpr("(id % 100) / 100D AS longitude", "(id % 77) / 77D AS latitude")
    counted = X.count_within(points, boundaries, "name", cell=0.1, broadcast_limit=0)
    assert [tuple(r) for r in counted.collect()] == [(0, 5000)]
    assert met[0].count() <= 121


def test_few_edges_are_tested_like_many(spark):
    rng = random.Random(7)
    corner = lambda: (rng.randrange(6) / 2, rng.randrange(6) / 2)
    rows = []
    for _ in range(300):
        edges = [(*corner(), *corner()) for _ in range(rng.randrange(geo.FEW_EDGES + 4))]
        rows += [(*corner(), edges) for _ in range(4)] + [(rng.random() * 3, rng.random() * 3, edges)]
    rows += [(1.0, 1.0, None), (None, 1.0, [(0.0, 0.0, 2.0, 2.0)]), (float("nan"), 1.0, [(0.0, 0.0, 2.0, 2.0)])]
    points = spark.createDataFrame(rows, f"x DOUBLE, y DOUBLE, edges ARRAY<STRUCT<{geo.EDGE_DDL}>>")
    args = [F.col(c) for c in ("x", "y", "edges")]
    few, many = geo.in_few_edges(*args).alias("few"), geo.in_edges(*args).alias("many")
    told = points.select(F.coalesce(few, F.lit(False)).alias("few"), F.coalesce(many, F.lit(False)).alias("many")).collect()
    assert [r["few"] for r in told] == [r["many"] for r in told]
    assert {r["few"] for r in told} == {True, False}


def test_cells_of_a_large_boundary_set_are_never_broadcast(spark, sf):
    zones = X.with_edges(Q._zone_boundaries(spark, sf))
    counted = X.count_within(view(spark, sf, "fx_crashes"), zones, "ward", broadcast_limit=0)
    rows = {r["ward"]: r["points"] for r in counted.collect()}
    final = counted._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final
    assert rows == {r["ward"]: r["points"] for r in X.count_within(view(spark, sf, "fx_crashes"), zones, "ward").collect()}
