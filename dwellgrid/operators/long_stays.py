"""Stay points of trajectories too long for one task.

A trajectory is cut into pieces of equal length. All pieces are searched at once, each
as if it began with an anchor, and so are all *seams*: the search goes on from a piece's
first undecided anchor into the next piece until it meets an anchor of that piece's own
search; from there both are the same. Pieces and seams put together give the exact
result. Only a window that covers a whole piece leaves a seam undecided; such a window is
closed by an aggregate over the trajectory's rows, however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.geo import EARTH_RADIUS, between_seconds, distance_m
from dwellgrid.lineage import cut
from dwellgrid.operators.numbering import number_in_groups
from dwellgrid.operators.stays import TRAJECTORY, clock
from dwellgrid.operators.windows import _SURELY, PICO, Run, Track, mean_degrees

# kind: "stay" (start to stop), "open" (undecided at anchor start) or
# "met" (goes on with the search of piece ``piece`` at row start; NULL piece: ended).
_FOUND = (
    "uid string, traj_id string, job bigint, kind string, piece bigint, start bigint, stop bigint, "
    "lat double, lon double, arrive timestamp_ntz, leave timestamp_ntz, n_points int, sure boolean"
)
_STAY = ["lat", "lon", "arrive", "leave", "n_points"]


def _found(table: pa.Table, run: Run, base: int, marks: list[tuple]) -> pa.Table:
    """Stays of ``run`` and (kind, piece, row, sure) marks as rows of ``_FOUND``."""
    lat, lon = table.column("lat").to_numpy(), table.column("lon").to_numpy()
    ts = table.column("ts").to_pylist
    rows = []
    times = None
    for a, b, sure in run:
        times = times or ts()
        span = np.array([a]), np.array([b])
        mean = mean_degrees(lat, *span)[0], mean_degrees(lon, *span)[0]
        rows.append(("stay", None, a + base, b + base, *mean, times[a], times[b - 1], b - a, sure))
    for kind, piece, row, sure in marks:
        rows.append((kind, piece, row + base, None, None, None, None, None, None, sure))
    uid, traj_id, job = (table.column(c)[0].as_py() for c in ("uid", "traj_id", "job"))
    names = [field.split()[0] for field in _FOUND.split(", ")]
    types = [
        pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
        pa.float64(), pa.float64(), pa.timestamp("us"), pa.timestamp("us"), pa.int32(), pa.bool_(),
    ]
    whole = [(uid, traj_id, job, *row) for row in rows]
    columns = list(zip(*whole)) if whole else [()] * len(names)
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, columns, types)})


def scan_pieces(
    points: DataFrame,
    reach: float,
    dwell: float,
    order: Sequence[str],
    exact: bool,
    max_rows: int,
) -> DataFrame:
    """Stays as ``stay_points`` gives them, for trajectories above ``max_rows`` rows."""

    def opened(table: pa.Table) -> tuple[pa.Table, Track]:
        table = table.sort_by("pos")
        track = Track(
            table.column("lat").to_numpy(),
            table.column("lon").to_numpy(),
            *clock(table.column("ts")),
            reach,
            dwell,
            exact,
        )
        return table, track

    def search_piece(table: pa.Table) -> pa.Table:
        table, track = opened(table)
        n = table.num_rows
        ended, going = Run(track, 0, n, True), Run(track, 0, n, False)
        stays = [(int(a), int(b), bool(a < going.open)) for a, b in zip(ended.starts, ended.ends)]
        base = table.column("pos")[0].as_py()
        return _found(table, stays, base, [("open", None, going.open, False)])

    def search_on(table: pa.Table) -> pa.Table:
        """From row ``begin`` until an anchor of a piece at or behind ``meet_from`` is met."""
        table, track = opened(table)
        base = table.column("pos")[0].as_py()
        begin = table.column("begin")[0].as_py() - base
        meet_from = table.column("meet_from")[0].as_py()
        last_piece = table.column("last_piece")[0].as_py()
        pieces = table.column("piece").to_numpy()
        n = table.num_rows
        final = int(pieces[-1]) == last_piece
        run = Run(track, begin, n, final)
        mine = np.zeros(n, dtype=bool)
        mine[begin:] = run.anchors()
        for piece in np.unique(pieces):
            if piece < meet_from:
                continue
            lo, hi = np.searchsorted(pieces, [piece, piece + 1])
            theirs = Run(track, int(lo), int(hi), int(piece) == last_piece)
            both = np.nonzero(mine[lo:hi] & theirs.anchors())[0]
            if len(both):
                met = int(lo + both[0])
                mark = ("met", int(piece), met, True)
                break
        else:
            met = run.open
            mark = ("met", None, met, True) if final else ("open", None, met, False)
        stays = [(int(a), int(b), True) for a, b in zip(run.starts, run.ends) if a < met]
        return _found(table, stays, base, [mark])

    place = "_place_in_trajectory"
    rows = cut(
        number_in_groups(points, TRAJECTORY, list(order), place, max_rows)
        .withColumn("pos", F.col(place).cast("bigint") - 1)
        .withColumn("piece", F.expr(f"pos DIV {int(max_rows)}"))
        .select(*TRAJECTORY, "pos", "piece", "lat", "lon", "ts")
    )
    pieces = cut(
        rows.withColumn("job", F.col("piece"))
        .groupBy(*TRAJECTORY, "job")
        .applyInArrow(search_piece, _FOUND)
    )
    last = pieces.groupBy(*TRAJECTORY).agg(F.max("job").alias("last_piece"))

    def follow(jobs: DataFrame) -> DataFrame:
        """Run searches (job: first piece they see, begin, meet_from) over two pieces each."""
        seen = rows.withColumn("job", F.explode(F.array(F.col("piece"), F.col("piece") - 1)))
        return cut(
            seen.join(jobs.join(last, TRAJECTORY), [*TRAJECTORY, "job"])
            .groupBy(*TRAJECTORY, "job")
            .applyInArrow(search_on, _FOUND)
        )

    seams = follow(
        pieces.filter("kind = 'open'")
        .join(last, TRAJECTORY)
        .filter(F.col("job") < F.col("last_piece"))
        .select(*TRAJECTORY, "job", F.col("start").alias("begin"), (F.col("job") + 1).alias("meet_from"))
    )
    seam_ends = seams.filter("kind <> 'stay'").select(*TRAJECTORY, "job", "kind", "piece", "start")

    # Pieces the search passes through, with the row where it joins the piece's own one.
    entered = pieces.select(*TRAJECTORY).distinct().select(
        *TRAJECTORY, F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("from_row")
    )
    passed, extra = [], []
    while True:
        stuck = (
            seam_ends.filter("kind = 'open'")
            .join(entered.select(*TRAJECTORY, F.col("piece").alias("k")), TRAJECTORY)
            .filter(F.col("job") >= F.col("k"))
            .groupBy(*TRAJECTORY)
            .agg(F.min(F.struct("job", "start")).alias("at"))
        )
        on_the_way = (
            entered.select(*TRAJECTORY, F.col("piece").alias("k"))
            .join(stuck, TRAJECTORY, "left")
            .join(seam_ends.filter("kind = 'met' AND piece IS NOT NULL"), TRAJECTORY)
            .filter((F.col("job") >= F.col("k")) & (F.col("at").isNull() | (F.col("job") < F.col("at.job"))))
            .select(*TRAJECTORY, "piece", F.col("start").alias("from_row"))
        )
        passed.append(cut(entered.unionByName(on_the_way)))
        anchors = cut(stuck.select(*TRAJECTORY, F.col("at.start").alias("anchor")))
        if anchors.isEmpty():
            break
        entered, found = _past_long_windows(rows, anchors, follow, reach, dwell, exact, max_rows)
        extra.append(found)

    entries = passed[0]
    for more in passed[1:]:
        entries = entries.unionByName(more)
    on_piece = entries.withColumnRenamed("piece", "job")
    own = (
        pieces.filter("kind = 'stay'")
        .join(last, TRAJECTORY)
        .join(on_piece, [*TRAJECTORY, "job"])
        .filter((F.col("start") >= F.col("from_row")) & (F.col("sure") | (F.col("job") == F.col("last_piece"))))
        .select(*TRAJECTORY, "start", *_STAY)
    )
    whole = own.unionByName(
        seams.filter("kind = 'stay'")
        .join(on_piece.select(*TRAJECTORY, "job"), [*TRAJECTORY, "job"], "left_semi")
        .select(*TRAJECTORY, "start", *_STAY)
    )
    for found in extra:
        whole = whole.unionByName(found)
    return number_in_groups(cut(whole), TRAJECTORY, ["start"], "nth").select(
        *TRAJECTORY, (F.col("nth") - 1).cast("int").alias("stay_seq"), *_STAY
    )


def _past_long_windows(rows, anchors, follow, reach, dwell, exact, max_rows):
    """Close windows at ``anchors`` and search on until every trajectory is back on a piece.

    Returns (entered, stays): where each trajectory joins a piece's own search (none if
    it has ended), and the stays on the way.
    """
    size = int(max_rows)
    entered, stays = [], []

    def out_of_reach() -> Column:
        return distance_m("a_lat", "a_lon", "lat", "lon", exact) > F.lit(float(reach))

    while True:
        at = rows.join(anchors, TRAJECTORY).filter(F.col("pos") == F.col("anchor")).select(
            *TRAJECTORY,
            "anchor",
            F.col("lat").alias("a_lat"),
            F.col("lon").alias("a_lon"),
            F.col("ts").alias("a_ts"),
        )
        at = cut(at)
        after = rows.join(at, TRAJECTORY).filter(F.col("pos") >= F.col("anchor"))
        ends = after.groupBy(*TRAJECTORY, "anchor", "a_lat", "a_lon", "a_ts").agg(
            F.min(F.when(out_of_reach(), F.struct("pos", "lat", "lon"))).alias("left"),
            (F.max("pos") + 1).alias("n"),
            F.max(F.struct("pos", "lat", "lon", "ts")).alias("tail"),
        )
        ends = cut(
            ends.select(
                *TRAJECTORY, "anchor", "a_ts", "n",
                F.coalesce("left.pos", "n").alias("stop"),
                # The row that closes the window; at the end of the trajectory its last row.
                F.coalesce("left.lat", "tail.lat").alias("l_lat"),
                F.coalesce("left.lon", "tail.lon").alias("l_lon"),
                F.col("tail.ts").alias("t_ts"),
            )
        )
        within = rows.join(ends, TRAJECTORY).filter(
            (F.col("pos") >= F.col("anchor")) & (F.col("pos") < F.col("stop"))
        )
        windows = within.groupBy(*TRAJECTORY, "anchor", "a_ts", "stop", "n", "t_ts").agg(
            *(
                (F.sum(F.rint(F.col(c) * PICO).cast("decimal(20,0)")).cast("double") / F.count("*") / PICO).alias(c)
                for c in ("lat", "lon")
            ),
            F.max(F.struct("pos", "ts")).alias("final"),
            F.count(F.lit(1)).cast("int").alias("n_points"),
            # Whether any two rows are a dwell apart; rows that all lie together and the first of
            # them that is a dwell from the last row.
            (between_seconds(F.max("ts"), F.min("ts")) >= F.lit(float(dwell))).alias("hope"),
            (
                F.lit(EARTH_RADIUS)
                * (F.radians(F.max("lat") - F.min("lat")) + F.radians(F.max("lon") - F.min("lon")))
                <= F.lit(float(reach) - _SURELY)
            ).alias("together"),
            F.min(
                F.when(
                    (F.col("pos") > F.col("anchor"))
                    & (F.col("pos") < F.col("n") - 1)
                    & (between_seconds("ts", "t_ts") >= F.lit(float(dwell))),
                    F.col("pos"),
                )
            ).alias("late"),
            # First later anchor that also holds the row which closed this window.
            F.min(
                F.when(
                    (F.col("pos") > F.col("anchor"))
                    & (distance_m("lat", "lon", "l_lat", "l_lon", exact) <= F.lit(float(reach))),
                    F.col("pos"),
                )
            ).alias("retry"),
        )
        windows = cut(
            windows.withColumn(
                "stay",
                (F.col("n_points") > 1)
                & (between_seconds("a_ts", "final.ts") >= F.lit(float(dwell))),
            )
        )
        stays.append(
            windows.filter("stay").select(
                *TRAJECTORY,
                F.col("anchor").alias("start"),
                "lat",
                "lon",
                F.col("a_ts").alias("arrive"),
                F.col("final.ts").alias("leave"),
                "n_points",
            )
        )
        following = F.when(F.col("stay"), F.col("stop")).otherwise(F.coalesce("retry", "stop"))
        # At the end of the trajectory the search goes on only if a later window may last long enough;
        # where all rows lie together, every such window runs to the end, so it is known which one.
        at_end = (F.col("stop") == F.col("n")) & ~F.col("stay") & F.coalesce("hope", F.lit(False))
        jobs = (
            windows.filter(
                (F.col("stop") < F.col("n")) | (at_end & ~F.col("together") & (F.col("retry") < F.col("n") - 1))
            )
            .withColumn("begin", following)
            .withColumn("job", F.expr(f"begin DIV {size}"))
            .select(*TRAJECTORY, "job", "begin", F.col("job").alias("meet_from"))
        )
        found = follow(jobs)
        stays.append(found.filter("kind = 'stay'").select(*TRAJECTORY, "start", *_STAY))
        entered.append(
            found.filter("kind = 'met' AND piece IS NOT NULL").select(
                *TRAJECTORY, "piece", F.col("start").alias("from_row")
            )
        )
        anchors = cut(
            found.filter("kind = 'open'")
            .select(*TRAJECTORY, F.col("start").alias("anchor"))
            .unionByName(
                windows.filter(at_end & F.col("together") & F.col("late").isNotNull()).select(
                    *TRAJECTORY, F.col("late").alias("anchor")
                )
            )
        )
        if anchors.isEmpty():
            break

    def together(frames):
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        return cut(whole)

    return together(entered), together(stays)
