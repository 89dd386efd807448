"""Density clustering of stay points on a grid of small cells.

The cell diagonal is a little under ``eps``, so all points of a cell are neighbours:
a cell with ``min_pts`` points is *dense* and all its points are core, and the core
points of one cell belong to one cluster. Point pairs are only looked at around sparse
cells, which hold fewer than ``min_pts`` points each; clusters are components of cells.

Where many points meet many others (``_meetings``), boxes around cells decide first and
undecided cells are split into quarters, so that no step lists all pairs of two cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.geo import grid_index, planar_distance_sq
from dwellgrid.lineage import cut
from dwellgrid.operators.cells import to_plane
from dwellgrid.operators.components import ONE_TASK_EDGES, component_roots
from dwellgrid.operators.numbering import number_all

STAY_KEY = ["uid", "traj_id", "stay_seq"]

# Point pairs of two boxes that are compared directly rather than split further.
DIRECT_PAIRS = 1 << 16

_ROW = 1 << 32
_REACH = range(-2, 3)
_BOX = ("x1", "x2", "y1", "y2")
_NODE = ("cell", "sx", "sy")


def _cell_side(eps: float) -> float:
    # The margin keeps the diagonal below eps despite rounding of large coordinates.
    return eps / math.sqrt(2) * (1 - 1e-6)


def _cell_id(x: str, y: str, side: float) -> Column:
    return grid_index(x, side) * F.lit(_ROW) + grid_index(y, side)


def _cell_stripes(cell: str) -> tuple[Column, Column]:
    """Grid indexes of x and y that a cell id was made of."""
    gx = F.floor((F.col(cell) + _ROW // 2) / F.lit(_ROW))
    return gx, F.col(cell) - gx * _ROW


def _later_cells(cell: str) -> Column:
    """Explode those cells around a cell, with larger ids, that eps can reach."""
    steps = [dx * _ROW + dy for dx in _REACH for dy in _REACH]
    return F.explode(F.array(*[F.col(cell) + s for s in steps if s > 0]))


def _box() -> list[Column]:
    return [F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2")]


def _gap_sq() -> Column:
    """Squared distance between boxes a and b at their closest."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, F.col("b_x1") - F.col("a_x2"), F.col("a_x1") - F.col("b_x2"))
    dy = F.greatest(zero, F.col("b_y1") - F.col("a_y2"), F.col("a_y1") - F.col("b_y2"))
    return dx * dx + dy * dy


def _span_sq() -> Column:
    """Squared distance between boxes a and b at their farthest."""
    dx = F.greatest(F.col("b_x2") - F.col("a_x1"), F.col("a_x2") - F.col("b_x1"))
    dy = F.greatest(F.col("b_y2") - F.col("a_y1"), F.col("a_y2") - F.col("b_y1"))
    return dx * dx + dy * dy


def _prefixed(df: DataFrame, end: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{end}_{c}") for c in df.columns])


def _placed(stays: DataFrame, key: list[str], evaluated: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with coordinates, and those that lack one: they have no neighbours, not even themselves."""
    points = stays.select(*key, "lat", "lon")
    points = points if evaluated else cut(points)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return points.filter(known), points.filter(~known)


def _coordinates(points: DataFrame, key: list[str], side: float, min_pts: int):
    """Distinct coordinates with weights, and the cells they fall in."""
    coords = to_plane(
        points.groupBy("lat", "lon").agg(
            F.count(F.lit(1)).alias("w"), F.min(F.struct(*key)).alias("first_key")
        )
    ).withColumn("cell", _cell_id("x", "y", side))
    weights = coords.groupBy("cell").agg((F.sum("w") >= min_pts).alias("dense"))
    coords = cut(coords.join(weights, "cell"))
    cells = cut(
        coords.groupBy("cell", "dense").agg(
            F.sum("w").alias("w"),
            F.count(F.lit(1)).alias("n"),
            F.min("first_key").alias("cell_key"),
            *_box(),
        )
    )
    return coords, cells


def _as_nodes(cells: DataFrame) -> DataFrame:
    """Whole cells as the first level of boxes."""
    zero = F.lit(0).cast("bigint")
    return cells.select("cell", zero.alias("sx"), zero.alias("sy"), "n", "w", *_BOX, "dense")


def _near_cells(cells: DataFrame, eps: float) -> DataFrame:
    """Occupied cells a and b, a's id smaller, whose boxes are within eps.

    Points find their neighbours through this table, so that only cells, not points, are
    multiplied by the places around them, and most of those turn out empty here.
    """
    nodes = _as_nodes(cells)
    around = _prefixed(nodes, "a").withColumn("b_cell", _later_cells("a_cell"))
    return cut(around.join(_prefixed(nodes, "b"), "b_cell").filter(_gap_sq() <= eps * eps))


def _both_ways(near: DataFrame) -> DataFrame:
    other = {"a": "b", "b": "a"}
    swapped = near.select(*[F.col(c).alias(other[c[0]] + c[1:]) for c in near.columns])
    return near.unionByName(swapped)


def _quarters(coords: DataFrame, side: float, level: int) -> DataFrame:
    """Points with their box (sx, sy) after halving cells ``level`` times."""
    gx, gy = _cell_stripes("cell")
    scale = float(2**level)
    return coords.select(
        "cell",
        F.floor((F.col("x") - gx * side) / side * scale).alias("sx"),
        F.floor((F.col("y") - gy * side) / side * scale).alias("sy"),
        "lat", "lon", "x", "y", "w",
    )


def _open(pairs: DataFrame, parts: DataFrame, end: str) -> DataFrame:
    """Replace box ``end`` of every pair by the quarters of it that hold points."""
    kids = parts.withColumn("ux", F.shiftright("sx", 1)).withColumn("uy", F.shiftright("sy", 1))
    kids = _prefixed(kids, end).withColumnRenamed(f"{end}_cell", f"{end}_of")
    match = (
        (F.col(f"{end}_cell") == F.col(f"{end}_of"))
        & (F.col(f"{end}_sx0") == F.col(f"{end}_ux"))
        & (F.col(f"{end}_sy0") == F.col(f"{end}_uy"))
    )
    gone = [f"{end}_{c}" for c in ("n", "w", *_BOX)]
    renamed = pairs.drop(*gone).withColumnsRenamed({f"{end}_{c}": f"{end}_{c}0" for c in ("sx", "sy")})
    return renamed.join(kids, match).drop(*[f"{end}_{c}" for c in ("of", "sx0", "sy0", "ux", "uy")])


def _meetings(
    pairs: DataFrame, coords: DataFrame, eps: float, side: float, points_a: bool, once: bool
) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Settle box pairs level by level: (level, box pairs in reach, point pairs in reach).

    ``pairs`` has boxes a and b. A pair wholly within eps is reported as it is and one
    wholly beyond is dropped; a pair of few points is compared point by point; others
    are split. With ``points_a`` the a-boxes are single points and only b is split. With
    ``once``, cells that have met are not looked at again.
    """
    eps_sq = eps * eps
    level = 0
    while True:
        settled = cut(pairs.filter(_gap_sq() <= eps_sq).withColumn("sure", _span_sq() <= eps_sq))
        sure = settled.filter("sure").drop("sure")
        rest = settled.filter(~F.col("sure")).drop("sure")
        small = F.col("a_n") * F.col("b_n") <= DIRECT_PAIRS
        inside = _quarters(coords, side, level)
        at_b = _prefixed(inside, "b")
        compared = rest.filter(small).drop("b_w")
        if points_a:
            compared = compared.withColumnsRenamed({"a_x1": "a_x", "a_y1": "a_y"})
        else:
            compared = compared.select("a_cell", "a_sx", "a_sy", "b_cell", "b_sx", "b_sy")
            compared = compared.join(_prefixed(inside, "a"), ["a_cell", "a_sx", "a_sy"])
        met = compared.join(at_b, ["b_cell", "b_sx", "b_sy"]).filter(
            planar_distance_sq("a_x", "a_y", "b_x", "b_y") <= eps_sq
        )
        large = rest.filter(~small)
        last = large.isEmpty()
        if once and not last:
            cells = ["a_cell", "b_cell"]
            met = cut(met.select(*cells).distinct())
            large = large.join(sure.select(*cells).unionByName(met).distinct(), cells, "left_anti")
        elif once:
            met = met.select("a_cell", "b_cell").distinct()
        yield level, sure, met
        if last:
            return
        level += 1
        busy = F.array("b_cell") if points_a else F.array("a_cell", "b_cell")
        busy = large.select(F.explode(busy).alias("cell")).distinct()
        parts = cut(
            _quarters(coords.join(busy, "cell", "left_semi"), side, level)
            .groupBy(*_NODE)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *_box())
        )
        pairs = _open(large, parts, "b")
        if not points_a:
            pairs = _open(pairs, parts, "a")


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _around_sparse(coords: DataFrame, cells: DataFrame, near: DataFrame, eps: float, side: float):
    """Neighbours of the points in sparse cells.

    Returns (pairs, reach): neighbour pairs of sparse-cell points, each cell holding
    fewer than ``min_pts`` of them, and per sparse-cell point the weight it reaches in
    each dense cell nearby.
    """
    sparse = coords.filter(~F.col("dense"))
    own = sparse.select(
        F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("cell").alias("a_cell"),
        F.lit(1).alias("a_n"),
        F.col("x").alias("a_x1"), F.col("x").alias("a_x2"),
        F.col("y").alias("a_y1"), F.col("y").alias("a_y2"),
    )
    around = _both_ways(near).filter(~F.col("a_dense"))
    itself = cells.filter(~F.col("dense")).select(
        F.col("cell").alias("a_cell"), F.col("cell").alias("b_cell")
    )
    meet = around.filter(~F.col("b_dense")).select("a_cell", "b_cell").unionByName(itself)
    pairs = (
        own.join(meet, "a_cell")
        .join(_prefixed(sparse.select("cell", "lat", "lon", "x", "y", "w"), "b"), "b_cell")
        .filter(planar_distance_sq("a_x1", "a_y1", "b_x", "b_y") <= eps * eps)
        .select("a_lat", "a_lon", "a_cell", "b_lat", "b_lon", "b_cell", F.col("b_w").alias("w"))
    )
    dense = around.filter("b_dense").select(
        "a_cell", *[c for c in around.columns if c.startswith("b_") and c != "b_dense"]
    )
    columns = ["a_lat", "a_lon", "a_cell", "b_cell", F.col("b_w").alias("w")]
    found = []
    for _, whole, points in _meetings(
        own.join(dense, "a_cell"), coords.filter("dense"), eps, side, points_a=True, once=False
    ):
        found += [whole.select(*columns), points.select(*columns)]
    reach = _all(found).groupBy("a_lat", "a_lon", "a_cell", "b_cell").agg(F.sum("w").alias("w"))
    return cut(pairs), cut(reach)


def _dense_links(coords: DataFrame, near: DataFrame, eps: float, side: float) -> DataFrame:
    """(a_cell, b_cell) for dense cells with points within eps of each other."""
    pairs = near.filter("a_dense AND b_dense").drop("a_dense", "b_dense")
    found = []
    for _, whole, points in _meetings(
        pairs, coords.filter("dense"), eps, side, points_a=False, once=True
    ):
        found += [whole.select("a_cell", "b_cell"), points]
    return _all(found)


def _sparse_cores(pairs: DataFrame, reach: DataFrame, min_pts: int) -> DataFrame:
    """Core points among those in sparse cells."""
    spot = ["a_lat", "a_lon", "a_cell"]
    near = pairs.select(*spot, "w").unionByName(reach.select(*spot, "w"))
    return near.groupBy(*spot).agg(F.sum("w").alias("w")).filter(F.col("w") >= min_pts).select(*spot)


def dbscan(
    stays: DataFrame,
    eps: float = 100.0,
    min_pts: int = 4,
    key: list[str] | None = None,
    evaluated: bool = False,
) -> DataFrame:
    """Key columns, x, y, cluster_id and flag (Core, Border or Noise) for every row.

    A point is core if at least ``min_pts`` rows, itself included, lie within ``eps``
    of it in the projected plane. Clusters are connected core points, numbered from 1
    by their smallest core key; a border point takes the smallest cluster in reach;
    noise has cluster 0. A row without a coordinate is noise with NULL x and y. The result depends neither on row order nor on partitions.
    ``evaluated`` says that ``stays`` is a table or checkpoint, which need not be
    evaluated into one here.
    """
    key = list(key or STAY_KEY)
    side = _cell_side(eps)
    points, unplaced = _placed(stays, key, evaluated)
    coords, cells = _coordinates(points, key, side, min_pts)
    near = _near_cells(cells, eps)
    pairs, reach = _around_sparse(coords, cells, near, eps, side)

    cores = cut(_sparse_cores(pairs, reach, min_pts))
    spot = ["a_lat", "a_lon"]
    ends = cores.select(F.col("a_lat").alias("b_lat"), F.col("a_lon").alias("b_lon"))
    to_core = pairs.join(ends, ["b_lat", "b_lon"], "left_semi")

    links = (
        reach.select(*spot, "a_cell", "b_cell")
        .unionByName(to_core.select(*spot, "a_cell", "b_cell"))
        .join(cores.select(*spot), spot, "left_semi")
        .select("a_cell", "b_cell")
        .unionByName(_dense_links(coords, near, eps, side))
    )
    roots = component_roots(links, "a_cell", "b_cell", ONE_TASK_EDGES)

    # Cells with core points and each one's smallest core key.
    sparse_keys = (
        cores.withColumnsRenamed({"a_lat": "lat", "a_lon": "lon", "a_cell": "cell"})
        .join(coords.select("lat", "lon", "first_key"), ["lat", "lon"])
        .groupBy("cell")
        .agg(F.min("first_key").alias("cell_key"))
    )
    core_cells = cut(
        cells.filter("dense")
        .select("cell", "cell_key")
        .unionByName(sparse_keys)
        .join(roots.withColumnRenamed("node", "cell"), "cell", "left")
        .select("cell", "cell_key", F.coalesce("root", "cell").alias("root"))
    )
    heads = core_cells.groupBy("root").agg(F.min("cell_key").alias("head"))
    ids = number_all(heads, ["head"], "cluster_id")
    cell_ids = core_cells.join(ids, "root").select("cell", F.col("cluster_id").cast("int"))

    # Sparse-cell points that are not core, with the clusters they reach.
    reached = (
        reach.select(*spot, "b_cell")
        .unionByName(to_core.select(*spot, "b_cell"))
        .join(cores.select(*spot), spot, "left_anti")
        .join(cell_ids.withColumnRenamed("cell", "b_cell"), "b_cell")
        .groupBy(*spot)
        .agg(F.min("cluster_id").alias("border_id"))
    )
    at = {"a_lat": "lat", "a_lon": "lon"}
    sparse = (
        coords.filter(~F.col("dense"))
        .join(cores.select(*spot, F.lit(True).alias("core")).withColumnsRenamed(at), ["lat", "lon"], "left")
        .join(reached.withColumnsRenamed(at), ["lat", "lon"], "left")
        .select("lat", "lon", "x", "y", "cell", F.coalesce("core", F.lit(False)).alias("core"), "border_id")
    )
    labelled = (
        coords.filter("dense")
        .select("lat", "lon", "x", "y", "cell", F.lit(True).alias("core"), F.lit(None).cast("int").alias("border_id"))
        .unionByName(sparse)
        .join(cell_ids, "cell", "left")
        .select(
            "lat",
            "lon",
            "x",
            "y",
            F.when(F.col("core"), F.col("cluster_id"))
            .otherwise(F.coalesce("border_id", F.lit(0)))
            .alias("cluster_id"),
            F.when(F.col("core"), "Core")
            .when(F.col("border_id").isNotNull(), "Border")
            .otherwise("Noise")
            .alias("flag"),
        )
    )
    nowhere = F.lit(None).cast("double")
    return (
        points.join(labelled, ["lat", "lon"])
        .select(*key, "x", "y", "cluster_id", "flag")
        .unionByName(
            unplaced.select(
                *key, nowhere.alias("x"), nowhere.alias("y"), F.lit(0).alias("cluster_id"), F.lit("Noise").alias("flag")
            )
        )
    )


def neighbour_counts(
    stays: DataFrame, eps: float = 100.0, key: list[str] | None = None, evaluated: bool = False
) -> DataFrame:
    """Rows within eps of each row, itself included: key columns and ``n_neighbours``.

    A row without a coordinate has none.
    """
    key = list(key or STAY_KEY)
    side = _cell_side(eps)
    points, unplaced = _placed(stays, key, evaluated)
    coords, cells = _coordinates(points, key, side, 1)
    itself = _prefixed(_as_nodes(cells), "a")
    itself = itself.select("*", *[F.col(c).alias("b" + c[1:]) for c in itself.columns])
    pairs = _both_ways(_near_cells(cells, eps)).unionByName(itself).drop("a_dense", "b_dense")
    found = []
    for level, whole, met in _meetings(pairs, coords, eps, side, points_a=False, once=False):
        # What a whole box reaches is added up per box before its points share it.
        box = [F.col(f"a_{c}").alias(c) for c in _NODE]
        per_box = whole.groupBy(*box).agg(F.sum("b_w").alias("reached"))
        found.append(
            _quarters(coords, side, level).join(per_box, list(_NODE)).select("lat", "lon", "reached")
        )
        found.append(
            met.select(
                F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), F.col("b_w").alias("reached")
            )
        )
    counts = _all(found).groupBy("lat", "lon").agg(F.sum("reached").alias("n_neighbours"))
    return (
        points.join(counts, ["lat", "lon"])
        .select(*key, "n_neighbours")
        .unionByName(unplaced.select(*key, F.lit(0).cast("bigint").alias("n_neighbours")))
    )


def core_points(
    stays: DataFrame,
    eps: float = 100.0,
    min_pts: int = 4,
    key: list[str] | None = None,
    evaluated: bool = False,
) -> DataFrame:
    """Key columns of the rows with at least ``min_pts`` rows within eps."""
    key = list(key or STAY_KEY)
    side = _cell_side(eps)
    points, _ = _placed(stays, key, evaluated)
    coords, cells = _coordinates(points, key, side, min_pts)
    near = _near_cells(cells, eps)
    pairs, reach = _around_sparse(coords, cells, near, eps, side)
    cores = _sparse_cores(pairs, reach, min_pts).select(
        F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")
    )
    core = coords.filter("dense").select("lat", "lon").unionByName(cores)
    return points.join(core, ["lat", "lon"], "left_semi").select(*key)


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """cluster_id, n_stays, n_core, n_border, mean lat and lon per cluster; 0 is noise."""
    return labelled.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_stays"),
        F.count_if(F.col("flag") == "Core").alias("n_core"),
        F.count_if(F.col("flag") == "Border").alias("n_border"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
    )
