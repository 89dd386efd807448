import datetime as dt
import random
import time

import brute
import numpy as np
import pytest
from dwellgrid.operators.stays import stay_points
from dwellgrid.operators.windows import Track

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "uid string, traj_id string, seq int, lat double, lon double, ts timestamp_ntz"
METRE = 1 / 111319.49079327358  # degrees of latitude


def frame(spark, tracks):
    rows = [
        (uid, "00", i, lat, lon, None if s is None else T0 + dt.timedelta(seconds=s))
        for uid, track in tracks.items()
        for i, (lat, lon, s) in enumerate(track)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def found(df):
    return sorted(
        (r.uid, r.stay_seq, round(r.lat, 9), round(r.lon, 9), r.arrive, r.leave, r.n_points)
        for r in df.collect()
    )


def expected(tracks, **kw):
    rows = []
    for uid, track in tracks.items():
        for k, (a, b) in enumerate(brute.stays(track, **kw)):
            lat = round(sum(p[0] for p in track[a:b]) / (b - a), 9)
            lon = round(sum(p[1] for p in track[a:b]) / (b - a), 9)
            when = [T0 + dt.timedelta(seconds=track[i][2]) for i in (a, b - 1)]
            rows.append((uid, k, lat, lon, *when, b - a))
    return sorted(rows)


def wander(rng, n, step, rest, pace=60):
    """Random walk in metres that rests with probability ``rest``."""
    x = y = t = 0.0
    track = []
    for _ in range(n):
        track.append((39.9 + y * METRE, 116.3 + x * METRE, int(t)))
        if rng.random() > rest:
            x += rng.uniform(-step, step)
            y += rng.uniform(-step, step)
        else:
            x += rng.uniform(-2, 2)
        t += rng.randint(1, pace)
    return track


def many_tracks(seed, n=150):
    rng = random.Random(seed)
    return {
        "walk": wander(rng, n, 150, 0.3, 400),
        "creep": wander(rng, n, 40, 0.5, 300),
        "still": wander(rng, n, 3, 1.0, 30),
        "fast": wander(rng, n, 2000, 0.1, 60),
        "dense": wander(rng, n, 60, 0.9, 4),
        "slow": [(39.9 + 9 * i * METRE, 116.3, 70 * i) for i in range(n)],
        "pause": wander(rng, n // 3, 900, 0.1) + [
            (lat, lon, s + 10**5) for lat, lon, s in wander(rng, n // 2, 2, 1.0, 90)
        ] + [(lat + 1, lon, s + 10**6) for lat, lon, s in wander(rng, n // 3, 300, 0.5, 500)],
        "short": wander(rng, 5, 100, 0.5),
        "one": [(39.9, 116.3, 0)],
    }


def test_matches_brute_force(spark):
    tracks = many_tracks(1)
    assert found(stay_points(frame(spark, tracks))) == expected(tracks)


def test_long_trajectories_in_pieces(spark):
    tracks, max_rows = many_tracks(3, 120), 20
    got = found(stay_points(frame(spark, tracks), max_rows=max_rows))
    assert got == expected(tracks)


def test_long_window_that_is_too_short_in_time(spark):
    # 60 rows within reach but within seconds, then a move: several pieces, no stay there.
    still = [(39.9 + (i % 5) * METRE, 116.3, i) for i in range(30)]
    later = [(39.9 + 3000 * METRE, 116.3, 100 + 200 * i) for i in range(15)]
    tracks = {"burst": still + later, "drift": [(39.9 + 12 * i * METRE, 116.3, i) for i in range(40)]}
    assert found(stay_points(frame(spark, tracks), max_rows=8)) == expected(tracks)


def test_whole_metres_admit_a_fraction_more(spark):
    near, far = 200.9999 * METRE, 201.0001 * METRE
    tracks = {
        "a": [(0.0, 0.0, 0), (near, 0.0, 1300)],
        "b": [(0.0, 0.0, 0), (far, 0.0, 1300)],
    }
    assert [r[0] for r in found(stay_points(frame(spark, tracks)))] == ["a"]
    assert found(stay_points(frame(spark, tracks), exact=True)) == []


def test_dwell_threshold_and_last_point(spark):
    tracks = {
        "a": [(0.0, 0.0, 0), (0.0, 0.0, 600), (0.0, 0.0, 1199)],
        "b": [(0.0, 0.0, 0), (0.0, 0.0, 600), (0.0, 0.0, 1200)],
    }
    assert [(r[0], r[6]) for r in found(stay_points(frame(spark, tracks)))] == [("b", 3)]


def test_clock_running_backwards_or_missing(spark):
    back = [(0.0, 0.0, 5000), (0.0, 0.0, 0), (0.0, 0.0, 100), (1.0, 0.0, 200), (1.0, 0.0, 2000)]
    assert found(stay_points(frame(spark, {"a": back}))) == expected({"a": back})
    holes = [(0.0, 0.0, 0), (0.0, 0.0, None), (5.0, 0.0, 100), (5.0, 0.0, 2000)]
    # The first window ends at a missing time, which gives no gap.
    assert [r[6] for r in found(stay_points(frame(spark, {"a": holes})))] == [2]


def bad_clocks(seed, n):
    """Tracks whose clocks step back or are missing here and there."""
    rng = random.Random(seed)
    tracks = {}
    for name, track in many_tracks(seed, n).items():
        shift, out = 0, []
        for lat, lon, s in track:
            if rng.random() < 0.05:
                shift -= rng.randint(1, 3000)
            out.append((lat, lon, None if rng.random() < 0.04 else s + shift))
        tracks[name] = out
    last = [(lat, lon, s) for lat, lon, s in many_tracks(seed, n)["still"]]
    tracks["no end"] = [*last[:-1], (*last[-1][:2], None)]
    tracks["falling"] = [(lat, lon, -s) for lat, lon, s in many_tracks(seed, n)["creep"]]
    return tracks


def whens(tracks):
    out = []
    for uid, track in tracks.items():
        for k, (a, b) in enumerate(brute.stays(track)):
            when = [None if track[i][2] is None else T0 + dt.timedelta(seconds=track[i][2]) for i in (a, b - 1)]
            out.append((uid, k, b - a, *when))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, max_rows", [(1, 10**6), (2, 2), (3, 5), (4, 13), (5, 50)])
def test_bad_clocks_give_one_result_whole_and_in_pieces(spark, seed, max_rows):
    tracks = bad_clocks(seed, 60)
    whole = sorted(map(tuple, stay_points(frame(spark, tracks)).collect()), key=str)
    pieces = sorted(map(tuple, stay_points(frame(spark, tracks), max_rows=max_rows).collect()), key=str)
    assert whole == pieces
    assert sorted(((r[0], r[2], r[7], r[5], r[6]) for r in whole), key=str) == whens(tracks)


def test_walk_equals_brute_force_over_many_seeds():
    for seed in range(10, 40):
        for track in bad_clocks(seed, 50).values():
            lat, lon, s = zip(*track)
            known = np.array([x is not None for x in s])
            rows = Track(np.array(lat), np.array(lon), np.array([x or 0 for x in s]), known, 200.0, 1200, False)
            assert rows.walk(0, len(track))[0] == brute.stays(track)


def test_standing_track_without_a_last_time_is_not_quadratic():
    n = 1_000_000
    rng = np.random.default_rng(4)
    known = np.ones(n, bool)
    known[-1] = False
    rows = Track(39.9 + rng.normal(0, 3, n) * METRE, 116.3 + rng.normal(0, 3, n) * METRE, np.arange(n), known, 200.0, 1200, False)
    began = time.monotonic()
    assert len(rows.stays([0])[0]) == 0
    assert time.monotonic() - began < 60


def test_empty_input(spark):
    assert found(stay_points(spark.createDataFrame([], SCHEMA))) == []
