"""Stay points of a stream of track points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dwellgrid.operators.stays import STAY_SCHEMA
from dwellgrid.operators.windows import Track, mean_degrees

# What is kept of a trajectory between micro-batches: rows not settled yet, and how many stays it has given.
STATE = "lat array<double>, lon array<double>, us array<bigint>, n_stays int"


def search_open(track: Track, n: int, over: bool) -> tuple[list[tuple[int, int]], int]:
    """(stays, first row still needed) of the first ``n`` rows of a trajectory in order of time.

    A window is settled once a row has left it, or the trajectory is over. The rest starts with the first anchor whose
    window no row has left.
    """
    found, anchor = [], 0
    while anchor < n:
        stop = track.leaves_at(anchor, anchor + 1, n)
        if stop == n and not over:
            break
        if track.lasts(anchor, stop):
            found.append((anchor, stop))
            anchor = stop
        else:
            anchor += 1
    return found, anchor


def streamed_stay_points(
    points: DataFrame, distance: float = 200.0, dwell: float = 1200.0, exact: bool = False, delay: str = "1 hour"
) -> DataFrame:
    """Stays of streamed points (uid, traj_id, lat, lon, ts timestamp), in append mode, each once it is certain.

    Points may come late by ``delay``; later ones are dropped by the watermark. A trajectory's rows wait until the
    watermark has passed them, so they are searched in order of time whatever the micro-batches are. A window that a
    later row has left gives its stay at once. When the watermark passes a trajectory's last row, no row having come
    for ``delay`` of the stream's time, the trajectory is over: its open window is settled and its state removed; rows
    that come after such a gap count as a new trajectory. The state is the rows of the open window and those that
    wait. Without longer gaps the stays are those that ``stay_points`` finds in whole trajectories ordered by time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over = state.hasTimedOut
        lat, lon, us, n_stays = state.get if state.exists else ([], [], [], 0)
        parts = [pd.DataFrame({"lat": list(lat), "lon": list(lon), "us": list(us)}, dtype=object)]
        for frame in [] if over else frames:
            times = frame["ts"].to_numpy("datetime64[us]").astype(np.int64)
            parts.append(pd.DataFrame({"lat": frame["lat"], "lon": frame["lon"], "us": times}))
        rows = pd.concat(parts, ignore_index=True).astype({"lat": float, "lon": float, "us": np.int64})
        rows = rows.sort_values(["us", "lat", "lon"], kind="stable", ignore_index=True)
        watermark = state.getCurrentWatermarkMs()
        us = rows["us"].to_numpy()
        sure = len(us) if over else int(np.searchsorted(us, watermark * 1000))
        lat, lon = rows["lat"].to_numpy(), rows["lon"].to_numpy()
        known = np.ones(sure, bool)
        track = Track(lat[:sure], lon[:sure], us[:sure] // 1_000_000, known, distance, dwell, exact)
        found, needed = search_open(track, sure, over)
        if over:
            state.remove()
        else:
            state.update((lat[needed:].tolist(), lon[needed:].tolist(), us[needed:].tolist(), n_stays + len(found)))
            state.setTimeoutTimestamp(max(int(us[-1]) // 1000, watermark) + 1)
        if found:
            starts, ends = (np.array(x) for x in zip(*found, strict=True))
            yield pd.DataFrame(
                {
                    "uid": key[0],
                    "traj_id": key[1],
                    "stay_seq": np.arange(n_stays, n_stays + len(found), dtype=np.int32),
                    "lat": mean_degrees(lat, starts, ends),
                    "lon": mean_degrees(lon, starts, ends),
                    "arrive": us[starts].astype("datetime64[us]"),
                    "leave": us[ends - 1].astype("datetime64[us]"),
                    "n_points": (ends - starts).astype(np.int32),
                }
            )

    return (
        points.select("uid", "traj_id", "lat", "lon", "ts")
        .filter("lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL")
        .withWatermark("ts", delay)
        .groupBy("uid", "traj_id")
        .applyInPandasWithState(step, STAY_SCHEMA, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
