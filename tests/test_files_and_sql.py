import datetime
import glob
import random

import pytest

from dwellgrid.operators.stays import stay_points
from dwellgrid.operators.table_functions import register_table_functions
from dwellgrid.sources.tracks import points_file_plan, prepare_points, write_points

POINTS = "uid string, traj_id string, seq int, lat double, lon double, ts timestamp_ntz"
START = datetime.datetime(2024, 1, 1)


def points_of(spark, sizes, seed=0):
    """Points of users {uid: [rows of each trajectory]}."""
    rng = random.Random(seed)
    rows = []
    for uid, trips in sizes.items():
        for t, n in enumerate(trips):
            for i in range(n):
                ts = None if i % 50 == 49 else START + datetime.timedelta(seconds=300 * i)
                rows.append((uid, f"{t:02d}", i, 39.9 + rng.randrange(40) / 1e4, 116.3 + (i // 9) / 1e3, ts))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, POINTS).repartition(4)


def line_bytes(uid, rows):
    steps = [",".join(str(v) for v in (r.lat, r.lon, r.ts) if v is not None) for r in rows]
    return len(f"{uid}\t{'->'.join(steps)}\n".encode())


SIZES = {"a": [3, 5], "bé": [40], "c": [10, 10, 10], "d": [1], "e": [200, 2, 90], "f": [4], "g": [700], "h": [2]}


def test_file_plan(spark):
    points = points_of(spark, SIZES)
    trips = {}
    for r in points.collect():
        trips.setdefault((r.uid, r.traj_id), []).append(r)
    sizes = {k: line_bytes(k[0], sorted(v, key=lambda r: r.seq)) for k, v in sorted(trips.items())}
    limit = 3000
    at, start = 0, {}
    for k, n in sizes.items():
        start[k] = at
        at += n
    plan = {(r.uid, r.traj_id): r for r in points_file_plan(points, limit).collect()}
    assert {k: r.n_bytes for k, r in plan.items()} == sizes
    for k, r in plan.items():
        whole = sum(n for (u, _), n in sizes.items() if u == k[0])
        first = min(s for (u, _), s in start.items() if u == k[0])
        assert r.file_no == (first if whole <= limit else start[k]) // limit
        assert (r.row_bytes is not None) == (sizes[k] > limit)


@pytest.mark.parametrize("limit", [3000, 1 << 30])
def test_files_roll_at_users(spark, tmp_path, limit):
    points = points_of(spark, SIZES)
    path = str(tmp_path / "points")
    write_points(points, path, file_bytes=limit)
    back = spark.read.parquet(path)
    assert back.columns == points.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, points.collect()))
    files_of, bytes_of = {}, []
    for file in sorted(glob.glob(f"{path}/*.parquet")):
        rows = spark.read.parquet(file).collect()
        assert [(r.uid, r.traj_id, r.seq) for r in rows] == sorted((r.uid, r.traj_id, r.seq) for r in rows)
        if not rows:
            continue
        bytes_of.append(sum(line_bytes("", [r]) for r in rows))
        for r in rows:
            files_of.setdefault(r.uid, set()).add(file)
    small = [u for u, trips in SIZES.items() if sum(trips) < 50]
    assert all(len(files_of[u]) == 1 for u in small)
    if limit == 3000:
        assert len(files_of["g"]) > 8 and len(files_of["e"]) > 3
        assert max(bytes_of) < 2 * limit
    else:
        assert len(bytes_of) == 1
    assert sorted(map(str, prepare_points(spark, "/nowhere", path).collect())) == sorted(map(str, points.collect()))


def test_no_points(spark, tmp_path):
    none = spark.createDataFrame([], POINTS)
    assert points_file_plan(none).collect() == []
    write_points(none, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


CALL = "SELECT * FROM stay_points(TABLE(SELECT {columns} FROM {points}) PARTITION BY (uid, traj_id) ORDER BY (seq){more})"


def test_table_function(spark):
    points = points_of(spark, SIZES)
    register_table_functions(spark)

    def by_sql(more="", columns="*"):
        found = spark.sql(CALL.format(columns=columns, points="{points}", more=more), points=points)
        assert found.schema.simpleString() == stay_points(points).schema.simpleString()
        return sorted(map(str, found.collect()))

    assert by_sql() == sorted(map(str, stay_points(points).collect())) != []
    # Columns in another order, with one more; thresholds by place and by name.
    odd = "1 AS more, ts, lon, lat, seq, traj_id, uid"
    assert by_sql(", 500, 600", odd) == sorted(map(str, stay_points(points, 500.0, 600).collect()))
    exact = sorted(map(str, stay_points(points, 300.5, 1200, exact=True).collect()))
    assert by_sql(", exact => true, distance => 300.5D") == exact
    with pytest.raises(Exception, match="may not be negative"):
        by_sql(", -1")


def test_table_function_in_a_query(spark):
    points_of(spark, SIZES).createOrReplaceTempView("pts")
    register_table_functions(spark, "dwells")
    counted = spark.sql(
        "SELECT uid, count(*) AS n FROM dwells(TABLE(pts) PARTITION BY (uid, traj_id) ORDER BY seq)"
        " WHERE n_points > 3 GROUP BY uid"
    )
    want = {r.uid: r["count"] for r in stay_points(spark.table("pts")).filter("n_points > 3").groupBy("uid").count().collect()}
    assert {r.uid: r.n for r in counted.collect()} == want
    nothing = spark.sql("SELECT * FROM dwells(TABLE(SELECT * FROM pts WHERE uid = 'nobody') PARTITION BY (uid, traj_id) ORDER BY seq)")
    assert nothing.collect() == []
