"""Named queries over the event-derived trajectories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.functions.geo import Rect
from dwellgrid.operators import dbscan, itemsets, regions, stays, steps, visits
from dwellgrid.operators.area_counts import counts_in_rects
from dwellgrid.operators.cells import (
    bounding_box,
    cell_bounds,
    cell_histogram,
    count_in_rect,
    to_plane,
)
from dwellgrid.operators.asof import as_of
from dwellgrid.operators.components import ONE_TASK_EDGES, connected_components
from dwellgrid.operators.maximal_sets import frequent_maximal_sets
from dwellgrid.operators.presence import co_presence
from dwellgrid.operators.rectangles import points_in_rects
from dwellgrid.operators.table_functions import register_table_functions
from dwellgrid.plans.event_view import EVENT_ORDER, event_points, event_positions, micro_mean
from dwellgrid.plans.pipeline import Params, TrajectoryPipeline
from dwellgrid.sources import stages
from dwellgrid.sources.tracks import parse_track_lines, parse_trajectory_lines, points_file_plan, trajectory_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Planar rectangle of the rectangle queries and the margin it is shrunk or grown by.
RECT = (32985000.0, 6812500.0, 32988500.0, 6814900.0)
RECT_MARGIN = 100.0
CELL_SIDE = 200.0
MARKER_CLUSTER = 4
PIECE_ROWS = 12
PARSED_LINE_ITEMS = 16
PLAN_BYTES = 1 << 14

# A rectangle for each nation: neighbours overlap, and those of a region are of one size.
NATION_RECTS = """
SELECT n_nationkey AS rect_id, 32982000.0 + 300 * n_nationkey AS x, 6811000.0 + 170 * n_nationkey AS y,
       32982000.0 + 300 * n_nationkey + 900 * (n_regionkey + 1) AS x2,
       6811000.0 + 170 * n_nationkey + 500 * (n_regionkey + 1) AS y2
FROM {nation}
"""

_STAY = ["uid", "traj_id", "stay_seq"]


def query(fn):
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def _pipeline(spark: SparkSession, sf_dir: str, **params) -> TrajectoryPipeline:
    return TrajectoryPipeline(event_positions(spark, sf_dir), Params(**params), EVENT_ORDER)


def _in_micro_degrees(found: DataFrame) -> DataFrame:
    return found.withColumn("lat", F.expr(f"{micro_mean('lat')} / 1e6")).withColumn(
        "lon", F.expr(f"{micro_mean('lon')} / 1e6")
    )


@query
def traj_points(spark, sf_dir):
    return event_points(spark, sf_dir).select("uid", "traj_id", "seq", "lat", "lon", "ts")


@query
def trajectory_text(spark, sf_dir):
    return trajectory_lines(event_points(spark, sf_dir)).select("uid", "traj_id", "part", "line")


@query
def trajectory_text_parsed(spark, sf_dir):
    """Points read back from their text, with parts of a few items where trajectories are long."""
    lines = trajectory_lines(event_points(spark, sf_dir), line_items=PARSED_LINE_ITEMS)
    return parse_trajectory_lines(lines.select("traj_id", F.col("line").alias("value")))


@query
def track_lines_parsed(spark, sf_dir):
    """Points as lines of track files under six header lines, read back."""
    points = event_points(spark, sf_dir)
    line = F.concat_ws(
        ",", "lat", "lon", F.lit("0,492,39744.1"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    )
    body = points.select("uid", "traj_id", (F.col("seq") + 7).alias("line_no"), line.alias("value"))
    head = points.select("uid", "traj_id").distinct().select(
        "uid", "traj_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("line_no"), F.lit("1,2,3,4,5,6,7").alias("value")
    )
    return parse_track_lines(head.unionByName(body))


@query
def stay_text_parsed(spark, sf_dir):
    found = _in_micro_degrees(_pipeline(spark, sf_dir).stays)
    return stages.stay_coordinates(stages.stay_lines(found)).groupBy("lat", "lon").agg(F.count("*").alias("n_stays"))


@query
def labelled_text_parsed(spark, sf_dir):
    run = _pipeline(spark, sf_dir)
    labels = run.labels.select(*_STAY, "cluster_id", "flag")
    lines = stages.labelled_lines(_in_micro_degrees(run.stays).join(labels, _STAY))
    parsed = stages.parse_labelled(lines.withColumnRenamed("line", "value"))
    return parsed.groupBy("lat", "lon", "cluster_id", "flag").agg(F.count("*").alias("n_lines"))


@query
def step_distance(spark, sf_dir):
    return steps.step_distances(event_points(spark, sf_dir))


@query
def dwell_gap_seconds(spark, sf_dir):
    return steps.step_seconds(event_points(spark, sf_dir))


@query
def miller_xy(spark, sf_dir):
    return to_plane(event_positions(spark, sf_dir)).select(
        "event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")
    )


@query
def points_in_rect(spark, sf_dir):
    rect = Rect(*RECT)
    grown = rect.inset(-RECT_MARGIN)
    return (
        to_plane(event_positions(spark, sf_dir))
        .filter(grown.contains("x", "y"))
        .select(
            "event_id",
            rect.contains("x", "y").alias("inside"),
            rect.contains_strictly("x", "y").alias("strictly_inside"),
            rect.inset(RECT_MARGIN).contains_strictly("x", "y").alias("inside_inset"),
        )
    )


@query
def cell_histogram_query(spark, sf_dir):
    return cell_histogram(to_plane(event_positions(spark, sf_dir)), CELL_SIDE)


@query
def bounding_box_query(spark, sf_dir):
    cells = cell_histogram(to_plane(event_positions(spark, sf_dir)), CELL_SIDE)
    return bounding_box(cell_bounds(cells, CELL_SIDE))


@query
def rect_count(spark, sf_dir):
    cells = cell_histogram(to_plane(event_positions(spark, sf_dir)), CELL_SIDE)
    return count_in_rect(cell_bounds(cells, CELL_SIDE), Rect(*RECT))


def _nation_rects(spark, sf_dir):
    rects = spark.sql(NATION_RECTS, nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return rects.select("rect_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "x2", "y2")])


@query
def points_in_rects_query(spark, sf_dir):
    """Every point of every nation's rectangle."""
    planar = to_plane(event_positions(spark, sf_dir)).select("event_id", "x", "y")
    return points_in_rects(planar, _nation_rects(spark, sf_dir)).select("rect_id", "event_id")


@query
def rect_counts(spark, sf_dir):
    """Points of the cells wholly inside every nation's rectangle."""
    cells = cell_histogram(to_plane(event_positions(spark, sf_dir)), CELL_SIDE)
    return counts_in_rects(cells, _nation_rects(spark, sf_dir), CELL_SIDE).select("rect_id", "n_points")


@query
def points_file_plan_query(spark, sf_dir):
    """Bytes of each user in each file, files rolling at user boundaries."""
    plan = points_file_plan(event_points(spark, sf_dir), PLAN_BYTES)
    return plan.groupBy("uid", "file_no").agg(F.sum("n_bytes").alias("n_bytes"))


@query
def stay_points_sql(spark, sf_dir):
    """Stay points by the table function."""
    register_table_functions(spark)
    found = spark.sql(
        "SELECT * FROM stay_points(TABLE(SELECT uid, traj_id, sec, event_id, lat, lon, ts FROM {points})"
        " PARTITION BY (uid, traj_id) ORDER BY (sec, event_id), 200.0, 1200)",
        points=event_positions(spark, sf_dir),
    )
    return _in_micro_degrees(found)


@query
def stay_points(spark, sf_dir):
    return _in_micro_degrees(_pipeline(spark, sf_dir).stays)


@query
def stay_points_exact(spark, sf_dir):
    """Without whole-metre rounding, and with thresholds of its own."""
    return _in_micro_degrees(_pipeline(spark, sf_dir, exact=True, distance=350.5, dwell=7200).stays)


@query
def stay_points_in_pieces(spark, sf_dir):
    """The way of trajectories too long for one task, with a limit most exceed."""
    points = event_positions(spark, sf_dir)
    return _in_micro_degrees(stays.stay_points(points, order=EVENT_ORDER, max_rows=PIECE_ROWS))


def _bad_clock(spark, sf_dir):
    """Points whose clock is two hours slow at every eleventh event."""
    slow = "timestampadd(SECOND, CASE WHEN event_id % 11 = 0 THEN -7200 ELSE 0 END, ts)"
    return event_positions(spark, sf_dir).withColumn("ts", F.expr(slow))


@query
def stay_points_bad_clock(spark, sf_dir):
    return _in_micro_degrees(stays.stay_points(_bad_clock(spark, sf_dir), order=EVENT_ORDER))


@query
def stay_points_bad_clock_in_pieces(spark, sf_dir):
    points = _bad_clock(spark, sf_dir)
    return _in_micro_degrees(stays.stay_points(points, order=EVENT_ORDER, max_rows=PIECE_ROWS))


@query
def stay_points_text(spark, sf_dir):
    found = _in_micro_degrees(_pipeline(spark, sf_dir).stays)
    return stages.stay_lines(found).select("uid", "traj_id", "part", "line")


@query
def eps_neighbour_counts(spark, sf_dir):
    return dbscan.neighbour_counts(_pipeline(spark, sf_dir).stays, Params.eps, evaluated=True)


@query
def core_points(spark, sf_dir):
    return dbscan.core_points(_pipeline(spark, sf_dir).stays, Params.eps, Params.min_pts, evaluated=True)


@query
def dbscan_labels(spark, sf_dir):
    return _pipeline(spark, sf_dir).labels.select(
        *_STAY, F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "cluster_id", "flag"
    )


@query
def cluster_summary(spark, sf_dir):
    """Mean positions in micro-degrees."""
    run = _pipeline(spark, sf_dir)
    micro = run.stays.withColumn("lat", F.expr(micro_mean("lat"))).withColumn(
        "lon", F.expr(micro_mean("lon"))
    )
    labels = run.labels.select(*_STAY, "cluster_id", "flag")
    return dbscan.cluster_summary(micro.join(labels, _STAY))


@query
def labelled_text(spark, sf_dir):
    run = _pipeline(spark, sf_dir)
    labels = run.labels.select(*_STAY, "cluster_id", "flag")
    lines = stages.labelled_lines(_in_micro_degrees(run.stays).join(labels, _STAY))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def cluster_markers(spark, sf_dir):
    run = _pipeline(spark, sf_dir)
    labels = run.labels.select(*_STAY, "cluster_id")
    markers = stages.map_markers(_in_micro_degrees(run.stays).join(labels, _STAY), MARKER_CLUSTER)
    return markers.groupBy("marker").agg(F.count(F.lit(1)).alias("n_markers"))


@query
def location_visits(spark, sf_dir):
    run = _pipeline(spark, sf_dir)
    return visits.location_visits(run.stays, run.labels)


@query
def location_visits_by_coordinate(spark, sf_dir):
    run = _pipeline(spark, sf_dir)
    return visits.location_visits(run.stays, run.labelled_stays, by="coordinate")


@query
def location_text(spark, sf_dir):
    return visits.location_lines(_pipeline(spark, sf_dir).visits)


@query
def region_at(spark, sf_dir):
    """Region of the last stay that a user had begun at each of their points; NULL before the first one."""
    run = _pipeline(spark, sf_dir)
    begun = run.stays.select(*_STAY, "arrive").join(run.labels.select(*_STAY, "cluster_id"), _STAY)
    history = begun.select("uid", F.col("arrive").alias("ts"), "cluster_id")
    points = event_positions(spark, sf_dir).select("event_id", "uid", "ts")
    return as_of(points, history, ["uid"], "ts", ["cluster_id"]).select("event_id", "cluster_id")


@query
def co_presence_query(spark, sf_dir):
    """All periods in which someone stays in a region, with how many do."""
    run = _pipeline(spark, sf_dir)
    return co_presence(run.stays.join(run.labels.select(*_STAY, "cluster_id"), _STAY), least=1)


@query
def user_region_ranked(spark, sf_dir):
    return _pipeline(spark, sf_dir).user_region


@query
def user_region_text(spark, sf_dir):
    return regions.user_region_lines(_pipeline(spark, sf_dir).user_region).drop("place")


@query
def region_user_text(spark, sf_dir):
    return regions.region_user_lines(_pipeline(spark, sf_dir).region_user).drop("place")


@query
def transaction_counts(spark, sf_dir):
    return regions.transaction_counts(_pipeline(spark, sf_dir).region_user)


@query
def frequent_items(spark, sf_dir):
    return itemsets.frequent_items(_pipeline(spark, sf_dir).region_user, Params.min_support)


@query
def frequent_pairs(spark, sf_dir):
    return _pipeline(spark, sf_dir).pairs


@query
def frequent_triples(spark, sf_dir):
    found = itemsets.frequent_itemsets(
        _pipeline(spark, sf_dir).region_user, Params.min_support, max_len=3
    )
    return found.filter(F.size("items") == 3).select(
        F.array_join("items", ",").alias("items"), "freq"
    )


@query
def frequent_maximal_sets_query(spark, sf_dir):
    sets = frequent_maximal_sets(_pipeline(spark, sf_dir).region_user, Params.min_support, in_blocks=True)
    members = F.array_join(F.sort_array(F.flatten(F.collect_list("uids"))), ",")
    return sets.groupBy("set_id").agg(members.alias("items"), F.first("support").alias("freq")).drop("set_id")


@query
def users_within_hops(spark, sf_dir):
    """Users that the first user of each region reaches by similar users, and in how many steps."""
    run = _pipeline(spark, sf_dir)
    starts = run.region_user.groupBy("cluster_id").agg(F.min("uid").alias("uid")).select("uid")
    return run.users_reached(starts)


@query
def similar_users(spark, sf_dir):
    return _pipeline(spark, sf_dir).similar


@query
def similar_users_text(spark, sf_dir):
    return _pipeline(spark, sf_dir).similar_lines.drop("place")


@query
def connected_components_query(spark, sf_dir):
    return connected_components(_pipeline(spark, sf_dir).similar_links, "uid", "other_uid", ONE_TASK_EDGES)


@query
def recommend_regions(spark, sf_dir):
    return _pipeline(spark, sf_dir).recommended


@query
def recommend_regions_compat(spark, sf_dir):
    return _pipeline(spark, sf_dir, exclude="region_and_count").recommended


@query
def recommend_text(spark, sf_dir):
    return _pipeline(spark, sf_dir).recommendation_lines


@query
def recommend_text_compat(spark, sf_dir):
    return _pipeline(spark, sf_dir, exclude="region_and_count").recommendation_lines
