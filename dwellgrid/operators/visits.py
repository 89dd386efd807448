"""Stays with region labels, and the visits they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.text import LINE_ITEMS, STEP_SEP, joined_lines, keyed_lines
from dwellgrid.operators.dbscan import STAY_KEY
from dwellgrid.operators.numbering import (
    GROUP_ROWS,
    number_in_groups,
    runs_short,
    with_previous,
)

TRAJECTORY = ["uid", "traj_id"]


def label_lookup(stays: DataFrame, labels: DataFrame, by: str = "key") -> DataFrame:
    """Stay key and cluster_id; stays without a label get 0.

    ``by="coordinate"`` looks labels up by (lat, lon) instead of the stay key, which is
    unique; coordinates are made so first.
    """
    on = {"key": STAY_KEY, "coordinate": ["lat", "lon"]}[by]
    if by == "key":
        found = labels.select(*on, F.col("cluster_id").alias("found"))
    else:
        found = labels.groupBy(*on).agg(F.min("cluster_id").alias("found"))
    return stays.join(found, on, "left").select(
        *STAY_KEY, F.coalesce("found", F.lit(0)).alias("cluster_id")
    )


def collapse_runs(
    labelled: DataFrame, limit: int = GROUP_ROWS, fits: bool | None = None
) -> DataFrame:
    """One visit per run of equal labels in a trajectory: visit_seq counts from 0.

    Noise takes part in runs, so A,A is one visit of A and A,0,A is two. ``fits`` says
    whether every trajectory is within ``limit`` stays, if the caller knows.
    """
    if fits is None:
        fits = runs_short(labelled, "stay_seq", limit)
    after = with_previous(labelled, TRAJECTORY, "stay_seq", ["cluster_id"], limit, fits)
    begins = after.filter(~F.col("cluster_id").eqNullSafe(F.col("prev_cluster_id")))
    # Visits are no more than stays, so they fit whenever the stays do.
    return number_in_groups(begins, TRAJECTORY, ["stay_seq"], "nth", limit, fits or None).select(
        *TRAJECTORY, (F.col("nth") - 1).cast("int").alias("visit_seq"), "cluster_id"
    )


def location_visits(stays: DataFrame, labels: DataFrame, by: str = "key") -> DataFrame:
    """uid, traj_id, visit_seq, cluster_id of every visit, noise (0) included."""
    fits = runs_short(stays, "stay_seq")
    return collapse_runs(label_lookup(stays, labels, by), fits=fits)


def location_lines(visits: DataFrame, line_items: int = LINE_ITEMS) -> DataFrame:
    """uid, traj_id, part, line: ``uid<TAB>c1->c2->...``."""
    return keyed_lines(joined_lines(visits, TRAJECTORY, "visit_seq", F.col("cluster_id"), STEP_SEP, line_items))
