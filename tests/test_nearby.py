import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.operators.hierarchy import Hierarchy, Triangles, containing_region, points_in_circles
from waymark.operators.nearby import near_pairs
from waymark.operators.polygons import _points, clip_convex, crossings, ear_clip, even_odd

R = 6_371_000.0


def metres(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    return 2 * R * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))


def frame(spark, points, start=0):
    return spark.createDataFrame([(start + i, float(lat), float(lon)) for i, (lat, lon) in enumerate(points)], "image_id long, lat double, lon double")


def brute(p, q, r, start):
    return {(i, start + j) for i, a in enumerate(p) for j, b in enumerate(q) if metres(*a, *b) <= r}


@pytest.mark.parametrize("centre", [(52.28, 8.05), (69.0, 179.9999), (-69.0, -179.9999), (89.9997, 10.0), (-89.9999, 0.0), (0.0001, 0.0001)])
@pytest.mark.parametrize("radius", [5.0, 25.0, 100.0])
def test_same_pairs_as_brute_force(spark, centre, radius):
    rng = np.random.default_rng(7)

    def cloud(n):
        lat = np.clip(centre[0] + rng.normal(0, 0.0006, n), -90, 90)
        lon = centre[1] + rng.normal(0, 0.0006 / max(math.cos(math.radians(centre[0])), 1e-5), n)
        return list(zip(lat, (lon + 180) % 360 - 180))

    p, q = cloud(120), cloud(200)
    want = brute(p, q, radius, 1000)
    for rows in (near_pairs(frame(spark, p), frame(spark, q, 1000), radius), points_in_circles(frame(spark, p), frame(spark, q, 1000), radius)):
        found = [(r.left_id, r.right_id) for r in rows.collect()]
        assert set(found) == want and want and len(found) == len(want)


def test_edge_cases(spark):
    deg = math.degrees(1 / R)
    p = [(52.0, 8.0), (None or 0.0, 0.0), (91.0, 8.0), (52.0, 181.0)]
    q = [(52.0 + deg * 24.999, 8.0), (52.0 + deg * 25.001, 8.0), (52.0, 8.0), (52.0, 8.0), (0.0, 0.0)]
    nothing = spark.createDataFrame([], "image_id long, lat double, lon double")
    holes = spark.createDataFrame([(1, None, 8.0), (2, 52.0, None), (None, 52.0, 8.0)], "image_id long, lat double, lon double")
    for join in (near_pairs, points_in_circles):
        rows = join(frame(spark, p), frame(spark, q, 10), 25.0).collect()
        assert sorted((r.left_id, r.right_id) for r in rows) == [(0, 10), (0, 12), (0, 13)]
        assert join(nothing, frame(spark, q), 25.0).count() == 0 and join(frame(spark, q), nothing, 25.0).count() == 0
        assert [r.left_id for r in join(holes, frame(spark, q), 25.0).where("right_id = 2").collect()] == [None]


def test_pieces_and_crowded_cells_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    crowd = [(48.0, 11.0)] * 60
    p = crowd + list(zip(rng.uniform(47.99, 48.01, 300), rng.uniform(10.99, 11.01, 300)))
    q = crowd[:40] + list(zip(rng.uniform(47.99, 48.01, 300), rng.uniform(10.99, 11.01, 300)))
    rows = points_in_circles(frame(spark, p), frame(spark, q, 1000), 60.0, piece_items=40, cell_items=25, cell_points=30).collect()
    found = [(r.left_id, r.right_id) for r in rows]
    assert set(found) == brute(p, q, 60.0, 1000) and len(found) == len(set(found))


def test_clashing_columns_are_ignored_or_carried(spark):
    a = spark.createDataFrame([(1, 52.0, 8.0, "x", 1)], "image_id long, lat double, lon double, node string, row int")
    out = near_pairs(a, a, 25.0, carry=("node",))
    assert out.first().asDict() == {"left_id": 1, "right_id": 1, "d_m": 0.0, "left_node": "x", "right_node": "x"}


def test_radius_must_be_sensible(spark):
    with pytest.raises(ValueError):
        near_pairs(frame(spark, [(1, 1)]), frame(spark, [(1, 1)]), 0)


def area(ring):
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 14), st.integers(0, 10_000), st.booleans(), st.booleans())
def test_triangles_cover_the_polygon(n, seed, backwards, with_hole):
    rng = np.random.default_rng(seed)
    angles = np.sort(rng.uniform(0, 2 * np.pi, n) * 0.5 / np.pi + np.arange(n)) * 2 * np.pi / n
    radii = rng.uniform(2.0, 5.0, n)
    ring = [(float(r * np.cos(a)), float(r * np.sin(a))) for a, r in zip(angles, radii)]
    rings = [ring[::-1] + ring[-1:] if backwards else ring + ring[:1]]
    size = area(ring)
    if with_hole and n >= 6:
        hole = [(0.3, 0.3), (-0.3, 0.3), (-0.3, -0.3), (0.3, -0.3)]
        rings.append(hole + hole[:1])
        size -= area(hole)
    assert sum(area(list(t)) for t in ear_clip(rings)) == pytest.approx(size, rel=1e-9)


def test_odd_polygons():
    assert ear_clip([]) == [] and ear_clip(None) == []
    assert ear_clip([[(0, 0), (1, 1), (0, 0)]]) == []
    assert ear_clip([[(0, 0), None, (1, 0), (1, None), (1, 1), (0, 0)]]) != []
    assert len(ear_clip([[(0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 0)]])) == 2


def covered(triangles, points):
    x, y = points.T
    held = np.zeros(len(points), dtype=bool)
    if triangles:
        held[Triangles(np.array(triangles)).holding(x, y)[0]] = True
    return held


def parity(rings, points):
    odd = np.zeros(len(points), dtype=bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                odd ^= ((y1 > points[:, 1]) != (y2 > points[:, 1])) & (points[:, 0] < (x2 - x1) * (points[:, 1] - y1) / (y2 - y1) + x1)
    return odd


@settings(max_examples=80, deadline=None)
@given(st.integers(3, 12), st.integers(0, 3), st.integers(0, 100_000))
def test_crossing_outlines_lose_nothing(n, holes, seed):
    rng = np.random.default_rng(seed)
    rings = [[tuple(map(float, p)) for p in rng.uniform(-1, 1, (n if i == 0 else 4, 2))] for i in range(holes + 1)]
    points = rng.uniform(-1.1, 1.1, (400, 2))
    assert (covered(ear_clip(rings), points) == parity(rings, points)).all()


def test_bow_tie_has_both_wings():
    assert sum(area(list(t)) for t in ear_clip([[(0, 0), (2, 2), (2, 0), (0, 2)]])) == pytest.approx(2.0)


def test_many_vertices_and_holes_are_quick():
    import time

    rng = np.random.default_rng(0)
    n = 10_000
    angle, radius = np.arange(n) * 2 * np.pi / n, 10 + rng.uniform(0, 0.5, n)
    rings = [[(float(r * np.cos(a)), float(r * np.sin(a))) for a, r in zip(angle, radius)]]
    for x in range(-5, 6):
        for y in range(-5, 6):
            rings.append([(x + 0.3, y + 0.1), (x + 0.1, y + 0.4), (x - 0.2, y - 0.3)])
    began = time.perf_counter()
    found = ear_clip(rings)
    assert time.perf_counter() - began < 4
    assert sum(area(list(t)) for t in found) == pytest.approx(area(rings[0]) - sum(map(area, rings[1:])), rel=1e-9)


def test_slabs_and_ears_cover_the_same():
    star = [(float((3 + (i % 2) * 4) * np.cos(i * np.pi / 6)), float((3 + (i % 2) * 4) * np.sin(i * np.pi / 6))) for i in range(12)]
    hole = [(1.0, 0.0), (0.0, 1.0), (-1.0, -1.0)]
    rings = [_points(star), _points(hole)]
    assert not len(crossings(rings))
    points = np.random.default_rng(1).uniform(-8, 8, (2000, 2))
    assert (covered(ear_clip(rings), points) == covered(even_odd(rings, crossings(rings)), points)).all()


def test_convex_corners_are_ears():
    ring = np.array([[(0, 0), (4, 0), (5, 2), (3, 4), (-1, 3)]], dtype=float)
    assert sum(area([tuple(p) for p in t]) for t in clip_convex(ring)[0]) == pytest.approx(area([tuple(p) for p in ring[0]]))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 700), st.integers(0, 1000))
def test_hierarchy_finds_every_box(n, seed):
    rng = np.random.default_rng(seed)
    low = rng.uniform(-170, 170, (n, 2)) * [1, 0.5]
    boxes = np.concatenate([low, low + rng.exponential(3, (n, 2))], axis=1)
    x, y = rng.uniform(-170, 170, 50), rng.uniform(-85, 85, 50)
    want = {(i, j) for i in range(50) for j in range(n) if boxes[j, 0] <= x[i] <= boxes[j, 2] and boxes[j, 1] <= y[i] <= boxes[j, 3]}
    assert set(zip(*(a.tolist() for a in Hierarchy(boxes).holding(x, y)))) == want


SQUARE = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]]


def regions(spark, rows):
    kind = "district_id long, district_name string, area_km2 double, rings array<array<struct<lon: double, lat: double>>>"
    return spark.createDataFrame([(i, "n", a, None if r is None else [[(float(x), float(y)) for x, y in ring] for ring in r]) for i, a, r in rows], kind)


def test_regions(spark):
    where = regions(spark, [(1, 100.0, SQUARE), (2, 4.0, [[(4, 4), (6, 4), (6, 6), (4, 6)]]), (3, 4.0, [[(4, 4), (5, 4), (5, 5)]]), (4, None, [[(-5, -5), (20, -5), (20, 20), (-5, 20)]]), (5, 1.0, None)])
    points = [(2, 2), (5.5, 4.5), (4.5, 4.2), (4, 5), (10, 10), (15, 15), (50, 50), (3, 3), (0, 0)]
    here = frame(spark, [(y, x) for x, y in points])
    out = {r.image_id: r.district_id for r in containing_region(here, where).collect()}
    spread = containing_region(here, where, broadcast=0, piece_items=2, cell_items=2, cell_points=3)
    assert {r.image_id: r.district_id for r in spread.collect()} == out
    # An edge of a hole still belongs to the outer region, but the smaller inner one wins there.
    assert out == {0: 1, 1: 2, 2: 2, 3: 2, 4: 1, 5: 4, 6: None, 7: 1, 8: None}
    for most in (0, 100):
        nothing = containing_region(frame(spark, [(1.0, 1.0)]), regions(spark, []), broadcast=most)
        assert nothing.first().district_id is None
