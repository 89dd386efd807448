import datetime
import random

from dwellgrid.operators.stays import stay_points
from dwellgrid.streaming.stay_stream import streamed_stay_points

SCHEMA = "uid string, traj_id string, lat double, lon double, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def tracks(seed=4, n_users=9):
    """Users who dwell and move, with points every few minutes over the same days."""
    rng = random.Random(seed)
    rows = []
    for u in range(n_users):
        at, lat, lon = rng.randrange(600), 39.9, 116.3
        for i in range(150):
            at += rng.choice([60, 200, 290, 700])
            if rng.random() < 0.25:
                lat, lon = lat + rng.uniform(-0.01, 0.01), lon + rng.uniform(-0.01, 0.01)
            jitter = rng.uniform(-6e-4, 6e-4)
            rows.append((f"u{u}", f"t{u % 2}", lat + jitter, lon - jitter, START + datetime.timedelta(seconds=at)))
    return rows


def test_stream_gives_the_stays_of_whole_trajectories(spark, tmp_path):
    rows = tracks()
    rng = random.Random(1)
    # Rows come in rough order of time: late by less than the delay, in micro-batches that cut trajectories anywhere.
    arrival = sorted(rows, key=lambda r: r[4] + datetime.timedelta(seconds=rng.uniform(0, 3000)))
    end = max(r[4] for r in rows)
    batches = [arrival[i : i + 170] for i in range(0, len(arrival), 170)]
    # Time goes on for others, so the watermark passes all rows, and a row that is far too late is left out.
    batches.append([("later", "t", 0.0, 0.0, end + datetime.timedelta(days=2))])
    batches.append([("u0", "t0", 1.0, 1.0, START), ("later", "t", 0.0, 0.0, end + datetime.timedelta(days=2, seconds=5))])
    source = str(tmp_path / "source")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/part={i:03d}")
    stream = (
        spark.readStream.schema(SCHEMA + ", part int")
        .option("maxFilesPerTrigger", 1)
        .parquet(source)
        .select("uid", "traj_id", "lat", "lon", "ts")
    )
    query = (
        streamed_stay_points(stream, distance=300.0, dwell=1500)
        .writeStream.format("memory")
        .queryName("streamed_stays")
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive
    whole = spark.createDataFrame(rows, SCHEMA).withColumn("ts", spark_ts())
    want = stay_points(whole, 300.0, 1500, order=("ts",))
    found = spark.table("streamed_stays")
    assert found.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert found.count() > 40
    many = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(many) >= len(batches) - 1


def spark_ts():
    from pyspark.sql import functions as F

    return F.col("ts").cast("timestamp_ntz")
