import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwellgrid.functions import geo
from dwellgrid.functions.text import natural_key, natural_sorted, numeric_sorted
from dwellgrid.operators import regions
from dwellgrid.plans.pipeline import Params, TrajectoryPipeline, run
from dwellgrid.sources import stages, tracks

HEADER = "Track file\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n"


def track_line(lat, lon, when):
    return f"{lat},{lon},0,492,39744.1,{when:%Y-%m-%d},{when:%H:%M:%S}"


@pytest.fixture
def tree(tmp_path):
    """Four users who rest at the same three places on three days, one also elsewhere."""
    root = tmp_path / "tracks"
    start = dt.datetime(2008, 10, 23, 2, 0, 0)
    for u in range(4):
        folder = root / f"{u:03d}" / "Trajectory"
        folder.mkdir(parents=True)
        (root / f"{u:03d}" / "labels.txt").write_text("not a track\n" * 9)
        for day in range(3):
            lines = []
            for stop, place in enumerate([0, 1, 2] if u else [3, 0, 3, 1, 2]):
                for k in range(5):
                    when = start + dt.timedelta(days=day, hours=3 * stop, minutes=10 * k)
                    lines.append(track_line(39.9 + 0.01 * place + 1e-5 * k, 116.3 + 1e-5 * u, when))
            end = "\r\n" if day == 1 else "\n"
            text = (HEADER + "\n".join(lines) + "\n").replace("\n", end)
            (folder / f"2008102{day}.plt").write_bytes(text.encode())
    (root / "003" / "Trajectory" / "empty.plt").write_text(HEADER)
    return root


def test_track_reader(spark, tree):
    points = tracks.read_tracks(spark, str(tree))
    assert points.select("uid", "traj_id").distinct().count() == 12
    assert points.count() == 3 * (25 + 3 * 15)
    first = points.filter("uid = '001' AND traj_id = '20081021.plt'").orderBy("seq").collect()
    assert [r.seq for r in first] == list(range(15))
    assert first[0].ts == dt.datetime(2008, 10, 24, 2, 0, 0)
    assert (first[1].lat, first[1].lon) == (39.90001, 116.30001)
    big_files = tracks.read_tracks(spark, str(tree), max_bytes=100)
    assert sorted(map(tuple, big_files.collect())) == sorted(map(tuple, points.collect()))


def test_compact_points_and_text_round_trip(spark, tree, tmp_path):
    path = str(tmp_path / "points")
    points = tracks.prepare_points(spark, str(tree), path)
    again = tracks.prepare_points(spark, "/nowhere", path)  # exists, so tracks are not read
    assert again.count() == points.count() == 210
    text = str(tmp_path / "text")
    tracks.write_trajectory_text(points, text)
    lines = spark.read.text(text).collect()
    assert len(lines) == 12
    assert any(r.value.startswith("001\t39.9,116.30001,2008-10-23 02:00:00->39.90001,") for r in lines)
    back = tracks.read_trajectory_text(spark, text)
    columns = ["uid", "seq", "lat", "lon", "ts"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, points.select(columns).collect()))


def test_whole_job(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    recommended = run(spark, str(tree), str(tmp_path / "points"), out, text=True)
    # User 000 alone goes to the fourth place, more often than elsewhere, so the others are told of it.
    assert sorted((r.uid, r.position) for r in recommended.collect()) == [("001", 1), ("002", 1), ("003", 1)]
    stays = spark.read.parquet(f"{out}/stays")
    assert stays.count() == 3 * (5 + 3 * 3)
    labels = stages.read_labelled(spark, f"{out}/text/labels")
    assert labels.groupBy("flag").count().count() >= 1 and labels.count() == 42
    assert labels.filter("lat IS NULL OR cluster_id IS NULL").isEmpty()
    similar = {r.value for r in spark.read.text(f"{out}/text/similar").collect()}
    assert "000\t001,002,003" in similar
    text = {r.value.split("\t")[0] for r in spark.read.text(f"{out}/text/recommended").collect()}
    assert text == {"000", "001", "002", "003"}
    coordinates = stages.stay_coordinates(spark.read.text(f"{out}/text/stays").withColumnRenamed("value", "line"))
    assert coordinates.count() == 42
    # A second run replaces the stages.
    again = TrajectoryPipeline(spark.read.parquet(str(tmp_path / "points")))
    again.create_views("job_")
    top = spark.sql("SELECT uid, cluster_id FROM job_user_region WHERE uid = '000' AND rank = 1").collect()
    assert [tuple(r) for r in top] == [("000", 1)]
    TrajectoryPipeline(spark.read.parquet(str(tmp_path / "points")), Params(dwell=10**6), out=out).stays
    assert spark.read.parquet(f"{out}/stays").isEmpty()


def test_texts_in_parts_are_read_back(spark, tree, tmp_path):
    points = tracks.read_tracks(spark, str(tree))
    path = str(tmp_path / "text")
    tracks.write_trajectory_text(points, path, line_items=4)
    assert spark.read.text(path).count() > 12
    back = tracks.read_trajectory_text(spark, path)
    columns = ["uid", "traj_id", "seq", "lat", "lon", "ts"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, points.select(columns).collect()))
    pairs = spark.createDataFrame([(f"{u}", r) for u in range(5) for r in range(7)], "uid string, cluster_id int")
    listed = str(tmp_path / "listed")
    stages.write_lines(regions.region_user_lines(pairs, 2), listed, ["cluster_id"])
    got = stages.read_listed(spark.read.text(listed), "region", "uid").collect()
    assert sorted(map(tuple, got)) == [(str(r), u, f"{u}") for r in range(7) for u in range(5)]


def test_odd_track_trees(spark, tree, tmp_path):
    spaced = tree / "user 1+%" / "Trajectory"
    spaced.mkdir(parents=True)
    line = track_line(39.9, 116.3, dt.datetime(2008, 10, 23))
    (spaced / "a b.plt").write_text(HEADER + line + "\n")
    deep = tree / "000" / "Trajectory" / "deep" / "er"
    deep.mkdir(parents=True)
    (deep / "x.plt").write_text(HEADER + line + "\n")
    (deep.parent / "y.plt").write_text(HEADER + line + "\n")
    points = tracks.read_tracks(spark, str(tree))
    assert points.count() == 211
    odd = points.filter("uid = 'user 1+%'").collect()
    assert [(r.traj_id, r.seq) for r in odd] == [("a b.plt", 0)]
    (spaced / "_hidden.plt").write_text(HEADER + line + "\n")
    with pytest.raises(ValueError, match="_hidden"):
        tracks.read_tracks(spark, str(tree))


def test_unfinished_points_table_is_written_anew(spark, tree, tmp_path):
    path = tmp_path / "points"
    (path / "_temporary").mkdir(parents=True)
    assert tracks.prepare_points(spark, str(tree), str(path)).count() == 210


def test_command(spark, tree, tmp_path, monkeypatch):
    from dwellgrid import __main__ as command

    out = tmp_path / "out"
    (out / "text" / "old").mkdir(parents=True)
    text = str(tmp_path / "text")
    tracks.write_trajectory_text(tracks.read_tracks(spark, str(tree)), text)
    command.main(["/nowhere", str(tmp_path / "points"), str(out), "--trajectories", text, "--dwell", "1200.5", "--markers", "1"])
    assert not (out / "text").exists() and not (tmp_path / "out-checkpoints").exists()
    assert spark.read.parquet(str(out / "stays")).count() == 42
    markers = [r.value for r in spark.read.text(str(out / "markers")).collect()]
    assert markers and all(m.startswith('{"position":[116.3') for m in markers)
    with pytest.raises(ValueError, match="replaced"):
        run(spark, str(tree), str(out / "points"), str(out))


def test_markers(spark):
    df = spark.createDataFrame([(39.9, 116.3, 4), (39.8, 116.2, 5)], "lat double, lon double, cluster_id int")
    assert [r.marker for r in stages.map_markers(df, 4).collect()] == ['{"position":[116.3,39.9]}']


def test_text_orders(spark):
    words = spark.createDataFrame([(["10", "9", "2", "100"],)], "a array<string>")
    row = words.select(natural_sorted(F.col("a")).alias("n"), numeric_sorted(F.col("a")).alias("i")).first()
    assert row.n == row.i == ["2", "9", "10", "100"]
    ordered = words.select(F.explode("a").alias("v")).orderBy(*natural_key(F.col("v"))).collect()
    assert [r.v for r in ordered] == row.n


def test_scalar_functions(spark):
    one = spark.range(1)
    row = one.select(
        geo.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
        geo.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.0)).alias("whole"),
        geo.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.0), exact=True).alias("exact"),
        geo.between_seconds_text(F.lit("2024-01-01 00:00:10"), F.lit("2024-01-01 00:00:00")).alias("gap"),
        geo.between_seconds_text(F.lit("never"), F.lit("2024-01-01 00:00:00")).alias("no_gap"),
        geo.between_seconds(
            F.expr("timestamp_ntz'1969-12-31 23:59:59.9'"), F.expr("timestamp_ntz'1970-01-01 00:00:00.1'")
        ).alias("floored"),
        geo.grid_index(F.lit(-400.0), 200).alias("edge"),
        geo.Rect(0.0, 0.0, 4.0, 4.0).contains(4.0, 0.0).alias("on_edge"),
        geo.Rect(0.0, 0.0, 4.0, 4.0).contains_strictly(4.0, 1.0).alias("strict"),
        geo.Rect(0.0, 0.0, 4.0, 4.0).contains_rect(geo.Rect(0.0, 0.0, 4.0, 4.0).inset(1)).alias("shrunk"),
        geo.Rect(0.0, 0.0, 4.0, 4.0).contains_rect(geo.Rect(0.0, 0.0, 4.0, 4.0).inset(-1)).alias("grown"),
        geo.planar_distance_sq(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)).alias("sq"),
    ).first()
    assert abs(row.half - 20037508) <= 1
    assert row.whole == 111.0 and abs(row.exact - 111.319) < 1e-3
    assert (row.gap, row.no_gap, row.floored, row.edge) == (10, 0, 1, -2)
    assert (row.on_edge, row.strict, row.shrunk, row.grown, row.sq) == (True, False, True, False, 25.0)
