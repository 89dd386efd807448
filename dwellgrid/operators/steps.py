"""What lies between one point of a trajectory and the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.geo import between_seconds, distance_m
from dwellgrid.operators.numbering import GROUP_ROWS, with_previous

_ROW = ["uid", "traj_id", "seq"]


def step_distances(points: DataFrame, exact: bool = False, limit: int = GROUP_ROWS) -> DataFrame:
    """uid, traj_id, seq, metres from the point before (NULL for the first)."""
    pairs = with_previous(points, ["uid", "traj_id"], "seq", ["lat", "lon"], limit)
    return pairs.select(*_ROW, distance_m("prev_lat", "prev_lon", "lat", "lon", exact).alias("metres"))


def step_seconds(points: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """uid, traj_id, seq, seconds since the point before (0 for the first)."""
    pairs = with_previous(points, ["uid", "traj_id"], "seq", ["ts"], limit)
    return pairs.select(*_ROW, between_seconds("prev_ts", "ts").alias("seconds"))
