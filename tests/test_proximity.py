"""Near pairs and containing regions against brute force, and their edge cases."""

import math
import random
import struct

from conftest import AREA, OSM, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from terramill.operators import proximity
from terramill.operators.triangulate import even_odd, signed_area, triangulate


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def wkb(x, y, order="<"):
    return struct.pack(f"{order}BI2d", 1 if order == "<" else 0, 1, x, y)


def total(triangles):
    return sum(abs(signed_area(list(t))) for t in triangles)


def star(n, rng):
    return ring(*[(math.cos(2 * math.pi * i / n) * r, math.sin(2 * math.pi * i / n) * r) for i in range(n) for r in [rng.uniform(20, 100)]])


def test_triangles_cover_random_stars_with_holes():
    rng = random.Random(3)
    for n in (3, 5, 17, 60):
        outer, hole = star(n, rng), ring((-5, -5), (-5, 5), (5, 5), (5, -5))
        triangles, plain = triangulate([outer, hole] if n > 5 else [outer])
        assert plain
        for _ in range(200):
            x, y = rng.uniform(-100, 100), rng.uniform(-100, 100)
            hit = any(all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(t, t[1:] + t[:1])) for t in triangles)
            assert hit == even_odd([outer, hole] if n > 5 else [outer], x, y)


def test_dirty_rings():
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    for points in (square, square + square[:1], square[::-1], [p for p in square for _ in (0, 1)]):
        triangles, plain = triangulate([ring(*points)])
        assert plain and total(triangles) == 100
    assert triangulate(None) == ([], True)
    assert triangulate([]) == ([], True)
    assert triangulate([ring((0, 0), (1, 1))]) == ([], True)
    assert triangulate([None, ring(*square)]) == ([], True)
    crossed, plain = triangulate([ring((0, 0), (10, 10), (10, 0), (0, 10))])
    assert not plain and len(crossed) == 2


@settings(max_examples=50, deadline=None)
@given(st.integers(3, 40), st.integers(0, 1000))
def test_triangle_area(n, seed):
    outer = star(n, random.Random(seed))
    triangles, plain = triangulate([outer])
    assert plain and math.isclose(total(triangles), abs(signed_area([(p["x"], p["y"]) for p in outer])), rel_tol=1e-9)


def test_found_equals_brute_force(tables):
    rng = random.Random(5)
    spots = [(i, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(400)]
    spots += [(1000 + i, 50.0, 50.0) for i in range(30)]
    areas = [(j, [[{"x": p["x"] + 150, "y": p["y"] + 150} for p in star(12, rng)], ring((140, 140), (160, 140), (160, 160))]) for j in range(6)]
    areas.append((99, [ring((0, 0), (50, 50), (50, 0), (0, 50))]))
    osm = [{"poi_id": i, "geometry": wkb(x, y, "<" if i % 2 else ">"), "x": 1.0, "y": 1.0} for i, x, y in spots]
    osm += osm[:20] + [{"poi_id": 5000, "x": 10.0, "y": 10.0}, {"poi_id": 5001, "x": 0.0, "y": 0.0}, {"poi_id": 5002, "x": None, "y": 3.0}, {"poi_id": None, "x": 1.0, "y": 1.0}, {"poi_id": 5003, "geometry": b"\x01", "x": float("nan"), "y": 1.0}]
    area_rows = [{"area_id": j, "rings": r} for j, r in areas] + [{"area_id": 0, "rings": areas[0][1]}, {"area_id": 77}, {"rings": areas[0][1]}]
    found = rows_of(proximity.proximity_found(tables.make(OSM, osm, True), tables.make(AREA, area_rows, True)))
    spots.append((5000, 10.0, 10.0))
    near = {("near", a, b) for a, ax, ay in spots for b, bx, by in spots if a < b and math.hypot(ax - bx, ay - by) < 25}
    inside = {("inside", i, j) for i, x, y in spots for j, r in areas if even_odd(r, x, y)}
    assert found == sorted(near | inside)


def test_crowded_cells_are_salted_without_loss(tables, monkeypatch):
    monkeypatch.setattr(proximity, "CELL_LIMIT", 10)
    points = tables.spark.createDataFrame([(i, 3.0 + i * 0.1, 4.0) for i in range(60)], "poi_id long, x double, y double")
    assert proximity.near_pairs(points, 25.0).count() == 60 * 59 // 2


def test_distance_is_strict_and_tables_may_be_empty(tables):
    osm = [{"poi_id": 1, "x": 100.0, "y": 100.0}, {"poi_id": 2, "x": 115.0, "y": 120.0}, {"poi_id": 3, "x": 100.0, "y": 124.99}]
    assert rows_of(proximity.proximity_found(tables.make(OSM, osm), tables.make(AREA))) == [("near", 1, 3), ("near", 2, 3)]
    assert proximity.proximity_found(tables.make(OSM), tables.make(AREA)).count() == 0


def test_shared_boundary_counts_once(tables):
    square = [ring((0, 0), (10, 0), (10, 10), (0, 10))]
    osm = [{"poi_id": 1, "x": 5.0, "y": 5.0}, {"poi_id": 2, "x": 10.0, "y": 5.0}]
    found = proximity.proximity_found(tables.make(OSM, osm), tables.make(AREA, [{"area_id": 1, "rings": square}]))
    assert rows_of(found) == [("inside", 1, 1), ("inside", 2, 1), ("near", 1, 2)]
