import random

import brute
import pytest
from dwellgrid.operators import dbscan as db
from dwellgrid.operators.components import connected_components

SCHEMA = "uid string, traj_id string, stay_seq int, lat double, lon double"


def frame(spark, points, parts=3, seed=0):
    rows = [("u", "00", i, *p) for i, p in enumerate(points)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def labels(df):
    return [(r.cluster_id, r.flag) for r in sorted(df.collect(), key=lambda r: r.stay_seq)]


def east(metres, north=0.0):
    """A point at planar offsets from a fixed spot on the equator, where both scales are known."""
    return (north / 76023.0, metres / 111319.49079327358)


def blobs(rng, centres, size, spread):
    return [
        (lat + rng.gauss(0, spread), lon + rng.gauss(0, spread))
        for lat, lon in centres
        for _ in range(size)
    ]


def shuffled_scene(rng):
    """Blobs of different density, a line of dots, scattered noise and exact copies."""
    points = blobs(rng, [(39.90, 116.30), (39.91, 116.305)], 60, 0.0008)
    points += blobs(rng, [(39.903, 116.303)], 120, 0.0004)
    points += [(39.95, 116.30 + i * 0.0007) for i in range(15)]
    points += [(39.9 + rng.uniform(0, 0.03), 116.3 + rng.uniform(0, 0.03)) for _ in range(60)]
    points += [points[0]] * 5 + [(39.99, 116.4)] * 4
    rng.shuffle(points)
    return points


def test_matches_brute_force_with_splitting(spark, monkeypatch):
    monkeypatch.setattr(db, "DIRECT_PAIRS", 6)
    points = shuffled_scene(random.Random(5))
    want = brute.dbscan(points, 100, 4)
    assert labels(db.dbscan(frame(spark, points), 100, 4)) == want
    xy = [brute.plane(*p) for p in points]
    near = [sum((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 10000 for b in xy) for a in xy]
    counts = db.neighbour_counts(frame(spark, points), 100).collect()
    assert [r.n_neighbours for r in sorted(counts, key=lambda r: r.stay_seq)] == near


def test_other_thresholds_and_layouts(spark):
    points = shuffled_scene(random.Random(6))
    for parts, seed, eps, min_pts in ((1, 1, 60, 6), (7, 2, 60, 6)):
        got = labels(db.dbscan(frame(spark, points, parts, seed), eps, min_pts))
        assert got == brute.dbscan(points, eps, min_pts)
    got = {r.stay_seq for r in db.core_points(frame(spark, points), 60, 6).collect()}
    want = {i for i, (_, flag) in enumerate(brute.dbscan(points, 60, 6)) if flag == "Core"}
    assert got == want


def test_copies_border_tie_and_distant_dense_cells(spark):
    left = [east(0), east(-30), east(-60), east(-60)]
    right = [east(180), east(210), east(240), east(240)]
    between = [east(90)]  # within 100 of the nearest core point on both sides
    copies = [east(5000)] * 4
    lone = [east(9000)]
    points = right + left + between + copies + lone
    got = labels(db.dbscan(frame(spark, points), 100, 4))
    assert got == brute.dbscan(points, 100, 4)
    assert got[8] == (1, "Border")
    assert got[9:13] == [(3, "Core")] * 4
    assert got[13] == (0, "Noise")


def test_components_of_chain_hub_and_pairs(spark):
    chain = [(i, i + 1) for i in range(64)]
    hub = [(1000, i) for i in range(1001, 1050)]
    edges = chain + hub + [(2001, 2000), (7, 7)] + [(3000, 3000)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = {i: 0 for i in range(65)} | {i: 1000 for i in range(1000, 1050)}
    assert got == want | {2000: 2000, 2001: 2000, 3000: 3000}


def test_rows_without_coordinates_stay_as_noise(spark):
    points = [(39.9, 116.3)] * 4 + [(None, 116.3), (39.9, None), (None, None)]
    df = frame(spark, points)
    want = [(1, "Core")] * 4 + [(0, "Noise")] * 3
    assert labels(db.dbscan(df, 100, 4)) == want
    assert labels(db.dbscan(df.checkpoint(), 100, 4, evaluated=True)) == want
    counts = {r.stay_seq: r.n_neighbours for r in db.neighbour_counts(df).collect()}
    assert counts == {0: 4, 1: 4, 2: 4, 3: 4, 4: 0, 5: 0, 6: 0}
    assert db.core_points(df).count() == 4


@pytest.mark.parametrize("kind", ["string", "int", "bigint"])
def test_components_in_one_task_equal_those_in_rounds(spark, kind):
    rng = random.Random(5)
    ends = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 264)]
    rng.shuffle(ends)
    edges = spark.createDataFrame(ends, "src int, dst int").selectExpr(
        *[f"cast({c} - 60 as {kind}) AS {c}" for c in ("src", "dst")]
    )
    rounds = sorted(tuple(r) for r in connected_components(edges).collect())
    assert sorted(tuple(r) for r in connected_components(edges, one_task=1000).collect()) == rounds
    assert sorted(tuple(r) for r in connected_components(edges, one_task=10).collect()) == rounds
    assert connected_components(edges.limit(0), one_task=10).collect() == []
