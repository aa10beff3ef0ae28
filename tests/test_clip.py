"""Exact lengths and overlaps against fine sums and clipping by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest

from surveyspark.operators import spatial as G


def ring(points):
    return list(zip(points, [*points[1:], points[0]], strict=True))


def inside(x, y, points):
    odd = False
    for (x1, y1), (x2, y2) in ring(points):
        if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x:
            odd = not odd
    return odd


def clip(subject, window):
    """Area of a polygon inside a convex window that goes round to the left."""
    out = list(subject)
    for a, b in ring(window):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        kept = []
        for p, q in ring(out) if out else []:
            s, t = side(p), side(q)
            if s >= 0:
                kept.append(p)
            if s * t < 0:
                kept.append((p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1])))
        out = kept
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in ring(out))) / 2 if out else 0.0


def edges(spark, polygons, name):
    rows = [(k, *map(float, (*a, *b))) for k, pts in polygons.items() for a, b in ring(pts)]
    return spark.createDataFrame(rows, f"{name} string, x1 double, y1 double, x2 double, y2 double").repartition(3)


@pytest.mark.parametrize("cell", [0.7, 3.0, 50.0])
def test_overlap_area(spark, cell):
    rnd = np.random.default_rng(3)
    star = lambda x, y, r, n: [(x + r * d * math.cos(2 * math.pi * i / n), y + r * d * math.sin(2 * math.pi * i / n)) for i, d in enumerate(rnd.uniform(0.3, 1.0, n))]
    a = {f"a{i}": star(*rnd.uniform(-5, 8, 2), rnd.uniform(1, 4), 9) for i in range(8)} | {"square": [(0, 0), (4, 0), (4, 4), (0, 4)], "turned": [(0, 0), (0, 4), (4, 4), (4, 0)]}
    b = {f"b{i}": [(x, y), (x + w, y), (x + w / 2, y + h)] for i, (x, y, w, h) in enumerate(rnd.uniform(-4, 6, (8, 4)) * [1, 1, 0, 0] + rnd.uniform(1, 5, (8, 4)) * [0, 0, 1, 1])}
    b |= {"beside": [(4, 0), (6, 0), (6, 4), (4, 4)], "same": [(0, 0), (4, 0), (4, 4), (0, 4)], "corner": [(2, 2), (4, 2), (4, 4), (2, 4)], "far": [(90, 90), (91, 90), (91, 91)]}
    found = {(r.a, r.b): r.area for r in G.overlap_area(edges(spark, a, "a"), edges(spark, b, "b"), "a", "b", cell).collect()}
    expected = {(i, j): area for i, p in a.items() for j, q in b.items() if (area := clip(p, q)) > 1e-9}
    assert found == pytest.approx(expected) and ("square", "beside") not in found and found["square", "same"] == pytest.approx(16) and found["turned", "corner"] == pytest.approx(4)


def test_a_hole_goes_the_other_way(spark):
    whole, hole = [(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (2, 4), (4, 4), (4, 2)]
    a = edges(spark, {"a": whole}, "a").unionAll(edges(spark, {"a": hole}, "a"))
    got = G.overlap_area(a, edges(spark, {"b": [(1, 1), (5, 1), (5, 5), (1, 5)]}, "b"), "a", "b", 1.5).first()
    assert got.area == pytest.approx(12)


@pytest.mark.parametrize("cell", [0.6, 5.0])
def test_length_by_unit(spark, cell):
    rnd = np.random.default_rng(5)
    units = {"left": [(0, 0), (4, 0), (4, 4), (0, 4)], "right": [(4, 0), (8, 0), (8, 4), (4, 4)], "kite": [(2, 3), (6, 5), (2, 9), (1, 5)]}
    lines = [(i, *map(float, p)) for i, p in enumerate(rnd.uniform(-2, 10, (25, 4)))] + [(90, 1.0, 1.0, 7.0, 1.0), (91, 4.0, 1.0, 4.0, 3.0), (92, 1.0, 1.0, 2.0, 2.0), (93, 5.0, 5.0, 5.0, 5.0), (90, 1.0, 2.0, 3.0, 2.0)]
    found = {r.unit: r.length for r in G.length_by_unit(spark.createDataFrame(lines, "id int, x1 double, y1 double, x2 double, y2 double"), edges(spark, units, "unit"), "id", "unit", cell).collect()}
    for name, pts in units.items():
        total = 0.0
        for _, x1, y1, x2, y2 in lines:
            ts = {0.0, 1.0}
            for (a, b), (c, d) in ring(pts):
                det = (x2 - x1) * (d - b) - (y2 - y1) * (c - a)
                if det:
                    t, u = ((a - x1) * (d - b) - (b - y1) * (c - a)) / det, ((a - x1) * (y2 - y1) - (b - y1) * (x2 - x1)) / det
                    ts |= {t} if 0 < t < 1 and -1e-12 <= u <= 1 + 1e-12 else set()
            ts = sorted(ts)
            total += sum(v - u for u, v in zip(ts[:-1], ts[1:], strict=True) if inside(x1 + (u + v) / 2 * (x2 - x1), y1 + (u + v) / 2 * (y2 - y1), pts)) * math.hypot(x2 - x1, y2 - y1)
        assert found.get(name, 0.0) == pytest.approx(total)


@pytest.mark.parametrize("cell", [0.31, 1.0, 40.0])
def test_points_in_by_cell_cover(spark, cell):
    rnd = np.random.default_rng(8)
    units = {"left": [(0, 0), (4, 0), (4, 4), (0, 4)], "right": [(4, 0), (8, 0), (8, 4), (4, 4)], "kite": [(2, 3), (6, 5), (2, 9), (1, 5)], "big": [(-9, -9), (9, -9), (9, 12), (0, 11), (-9, 12)]}
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(rnd.uniform(-10, 13, (300, 2)))] + [(900, 4.0, 2.0), (901, 0.0, 0.0), (902, 8.0, 4.0), (903, 4.0, 4.0), (904, 2.0, 3.0), (905, None, 1.0)]
    points = spark.createDataFrame(spots, "id int, x double, y double")
    got = sorted(map(tuple, G.points_in(points, edges(spark, units, "unit"), "id", "unit", cell).collect()))
    assert got == sorted((i, name) for i, x, y in spots if x is not None for name, pts in units.items() if inside(x, y, pts))
    inner, border = G.cell_cover(edges(spark, units, "unit"), "unit", cell)
    assert cell > 1 or sum(cover.count() for _, cover in inner) > 0
    assert G.points_in(points.limit(0), edges(spark, units, "unit"), "id", "unit", cell).count() == 0


def test_equal_shapes_meet_once(spark):
    """Polygons of one shape meet as one and are listed at the end: pairs of polygons come after the sums over pairs of edges."""
    a = {f"a{i}": [(0, 0), (3, 0), (2.5, 2), (0.5, 3)] for i in range(20)} | {"other": [(0, 0), (3, 0), (2.5, 2), (0.5, 2.5)]}
    b = {f"b{i}": [(1, 1), (5, 1), (5, 5), (1, 5)] for i in range(15)} | {"small": [(1, 1), (2, 1), (2, 2), (1, 2)]}
    got = G.overlap_area(edges(spark, a, "a"), edges(spark, b, "b"), "a", "b", 1.5)
    assert {(r.a, r.b): r.area for r in got.collect()} == pytest.approx({(i, j): clip(p, q) for i, p in a.items() for j, q in b.items()})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Join") < plan.index("Aggregate")
