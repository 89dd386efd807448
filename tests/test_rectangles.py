import itertools
import random

import pytest

from dwellgrid.functions.geo import Rect
from dwellgrid.operators.area_counts import counts_in_rects
from dwellgrid.operators.cells import cell_bounds, count_in_rect
from dwellgrid.operators.numbering import running_total
from dwellgrid.operators.rectangles import points_in_rects, rectangle_cover

NAN, INF = float("nan"), float("inf")
RECTS = "rect_id long, x double, y double, x2 double, y2 double, name string"


def rectangles(rng, n, reach=60.0):
    rows = []
    for i in range(n):
        x, y = rng.uniform(-reach, reach), rng.uniform(-reach, reach)
        w, h = rng.choice([(0, 0), (0.5, 40), (90, 3), (7, 7), (200, 200)])
        if i % 3 == 0:
            x, y = float(round(x)), float(round(y))
        rows.append((i, x, y, x + w, y + h, None if i % 5 == 0 else f"r{i}"))
    odd = [(0.0, 0.0, -1.0, 5.0), (None, 0.0, 1.0, 1.0), (NAN, 0.0, 1.0, 1.0), (0.0, 0.0, NAN, 1.0), (-INF, -INF, INF, INF), (3.0, -INF, 9.0, 2.0)]
    return rows + [(n + i, *bounds, "odd") for i, bounds in enumerate(odd)] + [(0, *rows[0][1:])]


def holds(rect, x, y, strict=False):
    bounds = rect[1:5]
    if any(v is None or v != v for v in (*bounds, x, y)):
        return False
    x1, y1, x2, y2 = bounds
    return (x1 < x < x2 and y1 < y < y2) if strict else (x1 <= x <= x2 and y1 <= y <= y2)


@pytest.mark.parametrize("unit, splits, strict", [(1.0, 4, False), (0.37, 2, True), (25.0, 0, False), (1.0, 7, True)])
def test_points_in_rects(spark, unit, splits, strict):
    rng = random.Random(splits)
    rects = rectangles(rng, 40)
    points = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(300)]
    # Points on the bounds and corners of rectangles, in crowds, far away and nowhere.
    points += [(1000 + i, rects[i][1], rects[i][4]) for i in range(40)]
    points += [(2000, 1.5, 2.5)] * 20 + [(3000, 1e300, -1e300), (3001, INF, 0.0), (3002, NAN, 0.0), (3003, None, 0.0)]
    got = points_in_rects(
        spark.createDataFrame(points, "event_id long, x double, y double"),
        spark.createDataFrame(rects, RECTS),
        unit,
        splits,
        strict,
    )
    assert got.columns == ["event_id", "x", "y", "rect_id", "name", "rect_x", "rect_y", "rect_x2", "rect_y2"]
    found = sorted((r.event_id, r.rect_id) for r in got.collect())
    assert found == sorted((p[0], r[0]) for p, r in itertools.product(points, rects) if holds(r, p[1], p[2], strict))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cover_is_small_and_disjoint(spark):
    rect = spark.createDataFrame([(1, 10.5, 20.5, 1010.5, 490.5, "a")], RECTS)
    cells = rectangle_cover(rect).collect()
    assert 4 < len(cells) <= 128
    fine = [
        (x, y)
        for c in cells
        for x in range(c.cx << c.level, c.cx + 1 << c.level)
        for y in range(c.cy << c.level, c.cy + 1 << c.level)
    ]
    assert len(fine) == len(set(fine))
    assert set(fine) >= {(x, y) for x in range(10, 1011) for y in range(20, 491)}
    inner = [c for c in cells if c.inside]
    assert inner and all(10 < c.cx << c.level and (c.cx + 1 << c.level) - 1 < 1010 for c in inner)


def test_no_rectangles_no_points(spark):
    rects = spark.createDataFrame([], RECTS)
    points = spark.createDataFrame([(1, 0.0, 0.0)], "event_id long, x double, y double")
    assert points_in_rects(points, rects).collect() == []
    some = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, "a")], RECTS)
    assert points_in_rects(points.limit(0), some).collect() == []


@pytest.mark.parametrize("side, seed", [(1.0, 1), (0.3, 2), (200.0, 3)])
def test_counts_in_rects(spark, side, seed):
    rng = random.Random(seed)
    cells = {(rng.randint(-40, 40), rng.randint(-9, 60)): rng.randint(1, 5) for _ in range(250)}
    cells[-41, 3] = 7
    histogram = spark.createDataFrame([(x, y, n) for (x, y), n in cells.items()], "cx long, cy long, n_points long")
    rects = [
        (i, *(None if v is None else v * side for v in r[1:5]), r[5])
        for i, r in enumerate(rectangles(rng, 60))
        if all(v is None or v == v and abs(v) != INF for v in r[1:5])
    ]
    got = counts_in_rects(histogram, spark.createDataFrame(rects, RECTS), side)
    assert got.columns == ["rect_id", "x", "y", "x2", "y2", "name", "n_points"]
    want = {}
    for i, x, y, x2, y2, _ in rects:
        inside = None not in (x, y, x2, y2) and [
            n
            for (cx, cy), n in cells.items()
            if x <= cx * side and cx * side + side <= x2 and y <= cy * side and cy * side + side <= y2
        ]
        want[i] = sum(inside or [])
    assert {r.rect_id: r.n_points for r in got.collect()} == want
    # One of them by the operator for a single rectangle.
    one = max(want, key=want.get)
    bounded = cell_bounds(histogram, side)
    assert count_in_rect(bounded, Rect(*rects[one][1:5])).first().n_points == want[one]


def test_counts_without_cells(spark):
    none = spark.createDataFrame([], "cx long, cy long, n_points long")
    rects = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0, "a"), (2, -INF, -INF, INF, INF, "b")], RECTS)
    assert [r.n_points for r in counts_in_rects(none, rects, 1.0).collect()] == [0, 0]
    one = spark.createDataFrame([(4, 4, 3)], "cx long, cy long, n_points long")
    assert {r.rect_id: r.n_points for r in counts_in_rects(one, rects, 1.0).collect()} == {1: 3, 2: 3}


def test_running_total(spark):
    rows = [(i % 7, i, (i * i) % 11 - 3) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(6)
    got = {(r.k, r.i): r.upto for r in running_total(df, ["k", "i"], "v", "upto").collect()}
    total, want = 0, {}
    for k, i, v in sorted(rows):
        total += v
        want[k, i] = total
    assert got == want
    assert running_total(df.limit(0), ["k", "i"], "v", "upto").collect() == []
