"""Which rectangles hold which points, by cells of several sizes instead of a loop over the rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.geo import Rect

# Side of the finest cells, in the unit of the coordinates.
UNIT = 1.0
# How often border cells of a rectangle are split: a rectangle takes some 2 ** (SPLITS + 3) cells at most.
SPLITS = 4
# Indices of cells beyond this are cut to it; such cells are always border cells.
LIMIT = 1 << 44

_BOUNDS = ["x", "y", "x2", "y2"]


def _index(value: Column | str, unit: float) -> Column:
    """Finest cell of a coordinate; it never falls where the coordinate rises."""
    value = F.col(value) if isinstance(value, str) else value
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(value / F.lit(float(unit)))))


def rectangle_cover(rects: DataFrame, unit: float = UNIT, splits: int = SPLITS) -> DataFrame:
    """Cells (level, cx, cy, inside) of a quadtree that cover each rectangle, with the rectangle's own columns.

    A cell of level ``l`` is ``2 ** l`` finest cells wide. A rectangle starts with the level at which it touches four
    cells at most; cells that its border may cross are split ``splits`` times. ``inside`` cells lie strictly between
    the finest cells of the bounds, so all their points lie in the rectangle, whatever is rounded. Cells of one
    rectangle don't overlap. Rectangles with a missing bound, or whose bounds are swapped, hold nothing.
    """
    own = rects.columns
    valid = (F.col("x") <= F.col("x2")) & (F.col("y") <= F.col("y2"))
    for bound in _BOUNDS:
        valid = valid & ~F.isnan(bound)
    placed = rects.filter(valid).select(
        *own, *[_index(c, unit).alias(f"_{c}") for c in _BOUNDS]
    )
    # Any level whose cells are as wide as the rectangle will do, so the logarithm need not be exact.
    extent = F.greatest(F.col("_x2") - F.col("_x"), F.col("_y2") - F.col("_y"))
    cells = (
        placed.withColumn("level", (F.floor(F.log2(extent + 1.0)) + 1).cast("int"))
        .withColumn("cx", F.explode(F.expr("sequence(shiftright(_x, level), shiftright(_x2, level))")))
        .withColumn("cy", F.explode(F.expr("sequence(shiftright(_y, level), shiftright(_y2, level))")))
    )
    inside = F.expr(
        "shiftleft(cx, level) > _x AND shiftleft(cx + 1, level) - 1 < _x2"
        " AND shiftleft(cy, level) > _y AND shiftleft(cy + 1, level) - 1 < _y2"
    )
    quarters = F.expr(
        "filter(transform(sequence(0, 3), q -> named_struct('level', level - 1,"
        " 'cx', 2 * cx + q % 2, 'cy', 2 * cy + q div 2)),"
        " c -> shiftleft(c.cx + 1, c.level) - 1 >= _x AND shiftleft(c.cx, c.level) <= _x2"
        " AND shiftleft(c.cy + 1, c.level) - 1 >= _y AND shiftleft(c.cy, c.level) <= _y2)"
    )
    as_it_is = F.array(F.struct("level", "cx", "cy"))
    kept = [*own, *[f"_{c}" for c in _BOUNDS]]
    for _ in range(splits):
        cells = cells.select(*kept, F.inline(F.when(inside | (F.col("level") == 0), as_it_is).otherwise(quarters)))
    return cells.select(*own, "level", "cx", "cy", inside.alias("inside"))


def points_in_rects(
    points: DataFrame,
    rects: DataFrame,
    unit: float = UNIT,
    splits: int = SPLITS,
    strict: bool = False,
) -> DataFrame:
    """Rows of ``points`` (with x, y) and of ``rects`` (x, y, x2, y2 and others) of which the rectangle holds the point.

    Both tables' other columns are kept; the rectangle's bounds are returned as rect_x, rect_y, rect_x2, rect_y2. Bounds belong to
    the rectangle unless ``strict``. Points carry the cells around them on the levels that the cover uses, which
    are some fifty whatever the data, and meet the cover's cells by an equi-join: Spark sends the cover to the
    points where it is small and deals both by cell where it isn't. Only points in border cells are compared
    with bounds. A point meets a rectangle in one cell at most, so there is nothing to deduplicate.
    Points with a missing coordinate are nowhere.
    """
    others = [c for c in rects.columns if c not in _BOUNDS]
    cover = rectangle_cover(rects, unit, splits).select(
        *others, *[F.col(c).alias(f"rect_{c}") for c in _BOUNDS], "level", "cx", "cy", "inside"
    )
    levels = sorted(r.level for r in cover.select("level").distinct().collect())
    carried = (
        points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
        .withColumn("_ix", _index("x", unit))
        .withColumn("_iy", _index("y", unit))
        .withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels]).cast("array<int>")))
        .withColumn("cx", F.expr("shiftright(_ix, level)"))
        .withColumn("cy", F.expr("shiftright(_iy, level)"))
        .drop("_ix", "_iy")
    )
    rect = Rect("rect_x", "rect_y", "rect_x2", "rect_y2")
    holds = rect.contains_strictly("x", "y") if strict else rect.contains("x", "y")
    # Points of inner cells lie strictly inside.
    return carried.join(cover, ["level", "cx", "cy"]).filter(F.col("inside") | holds).drop("level", "cx", "cy", "inside")
