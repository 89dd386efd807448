"""Stay points: greedy dwell windows inside each trajectory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dwellgrid.lineage import cut
from dwellgrid.operators.numbering import oversized_groups, runs_short
from dwellgrid.operators.windows import Track, mean_degrees

# Longest trajectory that one task scans in memory.
TRAJECTORY_ROWS = 1_000_000

STAY_SCHEMA = (
    "uid string, traj_id string, stay_seq int, lat double, lon double, "
    "arrive timestamp_ntz, leave timestamp_ntz, n_points int"
)

TRAJECTORY = ["uid", "traj_id"]


def clock(ts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Whole seconds (rounded down) of a microsecond column, and where they are known."""
    known = ts.is_valid().to_numpy()
    return ts.cast(pa.int64()).fill_null(0).to_numpy() // 1_000_000, known


def _changes(table: pa.Table) -> np.ndarray:
    """Rows whose trajectory differs from that of the row before."""
    n = table.num_rows
    changed = np.zeros(n, dtype=bool)
    if n > 1:
        for name in TRAJECTORY:
            col = table.column(name).combine_chunks()
            changed[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.nonzero(changed)[0]


def _whole_trajectories(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no trajectory is cut between two tables."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        breaks = _changes(table)
        begins = held and any(
            held[-1].column(c)[-1].as_py() != table.column(c)[0].as_py() for c in TRAJECTORY
        )
        if len(breaks):
            ready = pa.concat_tables([*held, table.slice(0, int(breaks[-1]))])
            held = [table.slice(int(breaks[-1]))]
            yield ready
        elif begins:
            ready = pa.concat_tables(held)
            held = [table]
            yield ready
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)


def stays_of(table: pa.Table, reach: float, dwell: float, exact: bool) -> pa.Table:
    """Stays of whole trajectories whose rows stand one behind the other, in order."""
    lat = table.column("lat").to_numpy()
    lon = table.column("lon").to_numpy()
    firsts = np.append(0, _changes(table))
    track = Track(lat, lon, *clock(table.column("ts")), reach, dwell, exact)
    starts, ends = track.stays(firsts)
    owner = np.searchsorted(firsts, starts, side="right")
    order = np.arange(len(starts)) - np.searchsorted(owner, owner, side="left")
    columns = {
        "uid": table.column("uid").take(starts),
        "traj_id": table.column("traj_id").take(starts),
        "stay_seq": pa.array(order, pa.int32()),
        "lat": pa.array(mean_degrees(lat, starts, ends), pa.float64()),
        "lon": pa.array(mean_degrees(lon, starts, ends), pa.float64()),
        "arrive": table.column("ts").take(starts),
        "leave": table.column("ts").take(ends - 1),
        "n_points": pa.array(ends - starts, pa.int32()),
    }
    return pa.table(columns)


def scan_whole(points: DataFrame, reach: float, dwell: float, order: Sequence[str], exact: bool) -> DataFrame:
    """Stays of trajectories that each fit one task."""

    def scan(batches):
        for table in _whole_trajectories(batches):
            yield from stays_of(table, reach, dwell, exact).to_batches()

    return (
        points.select("uid", "traj_id", *order, "lat", "lon", *(["ts"] if "ts" not in order else []))
        .repartition(*TRAJECTORY)
        .sortWithinPartitions(*TRAJECTORY, *order)
        .mapInArrow(scan, STAY_SCHEMA)
    )


def stay_points(
    points: DataFrame,
    distance: float = 200.0,
    dwell: float = 1200,
    order: Sequence[str] = ("seq",),
    exact: bool = False,
    max_rows: int = TRAJECTORY_ROWS,
) -> DataFrame:
    """Places where a trajectory keeps within ``distance`` metres for ``dwell`` seconds.

    From an anchor row the window grows while rows stay within reach of it. A window of
    two or more rows that lasts long enough is a stay at its mean position, and the
    search goes on behind it; otherwise the next row within reach of the one that closed
    the window becomes the anchor (while time rises, that finds what trying every row
    would). Means are exact sums of whole pico-degrees. ``order`` names the columns that order a trajectory's rows.

    Trajectories are counted first, or recognised by ``seq`` where that is the order: it
    counts rows from 0, so the filter can skip whole files. Trajectories above
    ``max_rows`` are cut into pieces that are scanned in parallel and joined up exactly.
    """
    if tuple(order) == ("seq",) and runs_short(points, "seq", max_rows):
        return scan_whole(points, distance, dwell, order, exact)
    long_ones = cut(oversized_groups(points, TRAJECTORY, max_rows))
    if long_ones.isEmpty():
        return scan_whole(points, distance, dwell, order, exact)
    from dwellgrid.operators.long_stays import scan_pieces

    keys = long_ones.select(*TRAJECTORY)
    return scan_whole(
        points.join(keys, TRAJECTORY, "left_anti"), distance, dwell, order, exact
    ).unionByName(
        scan_pieces(points.join(keys, TRAJECTORY, "left_semi"), distance, dwell, order, exact, max_rows)
    )
