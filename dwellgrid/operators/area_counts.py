"""Counts in many rectangles from prefix sums of a cell histogram over both axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.lineage import cut
from dwellgrid.operators.numbering import running_total

# Cells lie well within these indices.
LIMIT = 1 << 44

_RANGE = ["lo_x", "hi_x", "lo_y", "hi_y"]


def _cut(index: Column) -> Column:
    """Indices of bounds far outside, or infinite, are cut to where no cell is."""
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), index))


def _first_cell(bound: str, side: float) -> Column:
    """Least cell index whose lower bound is not below ``bound``, decided by the product as ``contains_rect`` has it."""
    near = _cut(F.ceil(F.col(bound) / F.lit(side)))
    return (
        F.when((near - 1) * F.lit(side) >= F.col(bound), near - 1)
        .when(near * F.lit(side) < F.col(bound), near + 1)
        .otherwise(near)
    )


def _last_cell(bound: str, side: float) -> Column:
    """Greatest cell index whose upper bound is not above ``bound``."""
    near = _cut(F.floor(F.col(bound) / F.lit(side))) - 1
    upper = lambda cell: cell * F.lit(side) + F.lit(side)
    return (
        F.when(upper(near + 1) <= F.col(bound), near + 1)
        .when(upper(near) > F.col(bound), near - 1)
        .otherwise(near)
    )


def _corners(ranges: DataFrame) -> DataFrame:
    """Four look-ups of a range: cells below column ``until`` and up to row ``row``, with their sign."""
    return ranges.select(
        *_RANGE,
        F.inline(
            F.array(
                *[
                    F.struct(until.alias("until"), row.alias("row"), F.lit(sign).alias("sign"))
                    for until, row, sign in (
                        (F.col("hi_x") + 1, F.col("hi_y"), 1),
                        (F.col("lo_x"), F.col("hi_y"), -1),
                        (F.col("hi_x") + 1, F.col("lo_y") - 1, -1),
                        (F.col("lo_x"), F.col("lo_y") - 1, 1),
                    )
                ]
            )
        ),
    )


def counts_in_rects(cells: DataFrame, rects: DataFrame, side: float) -> DataFrame:
    """All rows of ``rects`` (x, y, x2, y2 and others) with n_points of the cells (cx, cy, n_points) wholly inside.

    A rectangle is four sums over all cells left of and below a corner. Along x, cells belong to stripes of 1, 2,
    4, … columns; the columns left of a corner are one stripe for each set bit of their number. Along y, a running
    total over the sorted rows of each stripe, dealt in ranges over all tasks, gives the sums; corners stand in
    the same order as rows of no weight. A cell takes half as many rows as there are bits in the number of columns,
    a rectangle four times as many at most, however large it is. Cells are sparse: empty ones cost nothing.

    Rectangles with a missing bound, swapped bounds or no cell inside count 0. Repeated rectangles are looked up once.
    """
    side = float(side)
    span = cells.agg(F.min("cx").alias("least"), F.max("cx").alias("most")).first()
    ranged = rects.withColumns(
        {
            "lo_x": _first_cell("x", side),
            "hi_x": _last_cell("x2", side),
            "lo_y": _first_cell("y", side),
            "hi_y": _last_cell("y2", side),
        }
    )
    if span.least is None:
        return rects.withColumn("n_points", F.lit(0).cast("bigint"))
    columns = span.most - span.least + 1
    bits = columns.bit_length()
    ranges = ranged.filter("lo_x <= hi_x AND lo_y <= hi_y AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(x2) AND NOT isnan(y2)")
    corners = _corners(ranges.select(*_RANGE).distinct())
    until = F.greatest(F.lit(0), F.least(F.lit(columns), F.col("until") - span.least))
    levels = F.sequence(F.lit(0), F.lit(bits - 1))
    asked = corners.withColumn("until", until).select(
        *_RANGE,
        "sign",
        F.col("row").alias("cy"),
        F.explode(F.filter(levels, lambda b: F.call_function("bit_get", F.col("until"), b) == 1)).alias("level"),
        "until",
    ).withColumn("stripe", F.expr("shiftright(until, level) - 1"))
    # Only stripes with an even number end at a set bit.
    stripes = (
        cells.withColumn("ix", F.col("cx") - span.least)
        .withColumn("level", F.explode(F.filter(levels, lambda b: F.call_function("bit_get", F.col("ix"), b) == 0)))
        .groupBy("level", F.expr("shiftright(ix, level)").alias("stripe"), "cy")
        .agg(F.sum("n_points").alias("n"))
    )
    nothing = F.lit(None).cast("bigint")
    both = stripes.select(
        "level", "stripe", "cy", F.lit(0).alias("asks"), "n", *[nothing.alias(c) for c in _RANGE], F.lit(0).alias("sign")
    ).unionByName(
        asked.select("level", "stripe", "cy", F.lit(1).alias("asks"), F.lit(0).cast("bigint").alias("n"), *_RANGE, "sign")
    )
    summed = cut(running_total(both, ["level", "stripe", "cy", "asks"], "n", "upto"))
    before = summed.groupBy("level", "stripe").agg(F.min(F.col("upto") - F.col("n")).alias("before"))
    found = (
        summed.filter("asks = 1")
        .join(before, ["level", "stripe"])
        .groupBy(*_RANGE)
        .agg(F.sum(F.col("sign") * (F.col("upto") - F.col("before"))).alias("n_points"))
    )
    return (
        ranged.join(found, _RANGE, "left")
        .withColumn("n_points", F.coalesce("n_points", F.lit(0).cast("bigint")))
        .drop(*_RANGE)
    )
