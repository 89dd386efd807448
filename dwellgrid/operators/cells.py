"""Planar points, grid cells and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.geo import Rect, grid_index, miller_x, miller_y


def to_plane(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumn("x", miller_x(lon)).withColumn("y", miller_y(lat))


def cell_histogram(planar: DataFrame, side: float) -> DataFrame:
    """Points per square cell: cx, cy, n_points."""
    return planar.groupBy(
        grid_index("x", side).alias("cx"), grid_index("y", side).alias("cy")
    ).agg(F.count(F.lit(1)).alias("n_points"))


def cell_bounds(cells: DataFrame, side: float) -> DataFrame:
    """Histogram rows with the cell's planar bounds x, y, x2, y2."""
    return (
        cells.withColumn("x", F.col("cx") * F.lit(float(side)))
        .withColumn("y", F.col("cy") * F.lit(float(side)))
        .withColumn("x2", F.col("x") + side)
        .withColumn("y2", F.col("y") + side)
    )


def bounding_box(bounded: DataFrame) -> DataFrame:
    """One row with the rectangle around all given rectangles."""
    return bounded.agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )


def count_in_rect(bounded: DataFrame, rect: Rect) -> DataFrame:
    """One row: points of the cells that lie wholly inside ``rect``."""
    inside = rect.contains_rect(Rect("x", "y", "x2", "y2"))
    return bounded.filter(inside).agg(
        F.coalesce(F.sum("n_points"), F.lit(0).cast("bigint")).alias("n_points")
    )
