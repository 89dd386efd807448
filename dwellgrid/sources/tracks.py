"""GPS track files, trajectory text and the compact points table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.functions.geo import parse_ts
from dwellgrid.functions.text import FIELD_SEP, KEY_SEP, LINE_ITEMS, STEP_SEP, TS_FORMAT, joined_lines, keyed_lines
from dwellgrid.lineage import cut
from dwellgrid.operators.numbering import number_in_groups, running_total

# Header lines of a track file and the fields that are kept.
HEADER_LINES = 6
LAT_FIELD, LON_FIELD, DATE_FIELD, TIME_FIELD = 0, 1, 5, 6

# Largest track file whose lines one task numbers.
TRACK_BYTES = 64 << 20

# Bytes of trajectory text whose points go to one file of the compact table.
FILE_BYTES = 256 << 20

_IN_TREE = r"/([^/]+)/[^/]+/([^/]+)$"


def _file_system(spark: SparkSession, path: str):
    """(file system, path) in the session's Hadoop configuration."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds, if it exists."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def _plain_path(path: Column) -> Column:
    """The path of a file as it is named: Spark gives it URL-encoded, with ``+`` left as it is."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _ordered_lines(lines: DataFrame) -> DataFrame:
    """Text lines with columns that order the lines of a file.

    Files stay splittable: lines follow each other by the start of their split, and
    inside a split by the running id, which only ever grows there.
    """
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("running"),
    )


def read_tracks(spark: SparkSession, root: str, max_bytes: int = TRACK_BYTES) -> DataFrame:
    """Points of all ``root/<uid>/<folder>/<file>`` track files; seq counts from 0.

    Files at other depths are ignored, as are a file's header lines and blank lines. Spark's readers
    skip files whose names begin with ``_`` or ``.``; a track file named so is an error.
    Lines are numbered per file by a window while every file is within ``max_bytes``,
    which the file listing tells; else over range partitions.
    """
    fs, top = _file_system(spark, root)
    hidden = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/*/[_.]*"))
    tracks = [str(f.getPath()) for f in hidden or () if f.isFile() and not f.getPath().getName().endswith(".crc")]
    if tracks:
        raise ValueError(f"Spark does not read files named like {tracks[0]}; rename them")
    base = fs.makeQualified(top).toUri().getPath().rstrip("/")
    files = f"{root.rstrip('/')}/*/*/*"
    fits = spark.read.format("binaryFile").load(files).filter(F.col("length") > max_bytes).isEmpty()
    numbered = number_in_groups(
        _ordered_lines(spark.read.text(files)), ["path"], ["split_start", "running"], "line_no", fits=fits
    )
    inside = r"\Q" + base + r"\E" + _IN_TREE
    named = numbered.withColumn("path", _plain_path(F.col("path"))).select(
        F.regexp_extract("path", inside, 1).alias("uid"),
        F.regexp_extract("path", inside, 2).alias("traj_id"),
        "line_no",
        "value",
    )
    return parse_track_lines(named.filter("uid != ''"))


def parse_track_lines(lines: DataFrame) -> DataFrame:
    """Points of the lines (uid, traj_id, line_no from 1, value) of track files."""
    fields = F.split("value", FIELD_SEP)
    return (
        lines.filter((F.col("line_no") > HEADER_LINES) & (F.trim("value") != ""))
        .withColumn("fields", fields)
        .select(
            "uid",
            "traj_id",
            (F.col("line_no") - HEADER_LINES - 1).cast("int").alias("seq"),
            F.col("fields")[LAT_FIELD].cast("double").alias("lat"),
            F.col("fields")[LON_FIELD].cast("double").alias("lon"),
            parse_ts(F.concat_ws(" ", F.col("fields")[DATE_FIELD], F.col("fields")[TIME_FIELD])).alias("ts"),
        )
    )


def _step(lat: str = "lat", lon: str = "lon", ts: str = "ts") -> Column:
    return F.concat_ws(FIELD_SEP, F.col(lat), F.col(lon), F.date_format(ts, TS_FORMAT))


def points_file_plan(points: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """uid, traj_id, n_bytes, file_no, start, row_bytes: the file of each trajectory when files roll at user boundaries.

    Sizes are those of the trajectories' text lines. Users follow each other in text order; a user goes
    to the file in which their first byte falls, as a whole, so a file exceeds ``file_bytes`` by its last user
    at most. Only a user larger than a file is divided, by trajectories, and only a trajectory larger than a file
    is divided by rows: row ``seq`` goes to the file of byte ``start + seq * row_bytes``. For others ``row_bytes`` is NULL.
    Sizes are summed per trajectory before anything is sorted; the running sum is dealt in ranges.
    """
    trips = points.groupBy("uid", "traj_id").agg(
        F.sum(F.octet_length(_step()) + 2).alias("steps"), F.count(F.lit(1)).alias("n_rows")
    )
    sized = trips.select("uid", "traj_id", "n_rows", (F.col("steps") + F.octet_length("uid")).alias("n_bytes"))
    placed = cut(running_total(sized, ["uid", "traj_id"], "n_bytes", "upto"))
    users = placed.groupBy("uid").agg(
        F.min(F.col("upto") - F.col("n_bytes")).alias("user_start"), F.sum("n_bytes").alias("user_bytes")
    )
    start = F.when(F.col("user_bytes") <= file_bytes, F.col("user_start")).otherwise(F.col("upto") - F.col("n_bytes"))
    return placed.join(users, "uid").select(
        "uid",
        "traj_id",
        "n_bytes",
        F.floor(start / F.lit(file_bytes)).cast("int").alias("file_no"),
        start.alias("start"),
        F.when(F.col("n_bytes") > file_bytes, F.col("n_bytes") / F.col("n_rows")).alias("row_bytes"),
    )


def write_points(points: DataFrame, path: str, mode: str = "overwrite", file_bytes: int = FILE_BYTES) -> None:
    """Compact table: rows sorted by trajectory, in files that roll at user boundaries as ``points_file_plan`` has it.

    A file's number is the number of the task that writes it. The points are evaluated twice: for sizes, and to be written.
    """
    plan = cut(points_file_plan(points, file_bytes))
    at = F.col("start") + F.col("seq") * F.coalesce("row_bytes", F.lit(0.0))
    dealt = points.join(plan.select("uid", "traj_id", "start", "row_bytes"), ["uid", "traj_id"]).withColumn(
        "file_no", F.floor(at / F.lit(file_bytes)).cast("int")
    )
    end = F.col("start") + F.when(F.col("row_bytes").isNotNull(), F.col("n_bytes")).otherwise(0)
    last = plan.agg(F.floor(F.max(end) / F.lit(file_bytes)).cast("int").alias("last")).first().last or 0
    (
        dealt.repartitionById(last + 1, F.col("file_no"))
        .sortWithinPartitions("uid", "traj_id", "seq")
        .select(*points.columns)
        .write.mode(mode)
        .parquet(path)
    )


def prepare_points(spark: SparkSession, root: str, path: str) -> DataFrame:
    """Points table at ``path``; track files are only read if no finished table is there yet."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_points(read_tracks(spark, root), path)
    return spark.read.parquet(path)


def trajectory_lines(points: DataFrame, line_items: int = LINE_ITEMS) -> DataFrame:
    """uid, traj_id, part, line: ``uid<TAB>lat,lon,time->...``; seq must have no gaps.

    Lines of a trajectory that takes more than one end in ``<TAB>place,traj_id``.
    """
    return keyed_lines(joined_lines(points, ["uid", "traj_id"], "seq", _step(), STEP_SEP, line_items))


def write_trajectory_text(
    points: DataFrame, path: str, mode: str = "overwrite", line_items: int = LINE_ITEMS
) -> None:
    """One text line per trajectory (or part of a very long one), users kept together."""
    (
        trajectory_lines(points, line_items)
        .hint("rebalance", "uid")
        .sortWithinPartitions("uid", "traj_id", "part")
        .select("line")
        .write.mode(mode)
        .text(path)
    )


def parse_trajectory_lines(lines: DataFrame) -> DataFrame:
    """Points of the lines (traj_id, value) of trajectory text; lines that go on others name their trajectory."""
    parts = F.split("value", KEY_SEP)
    more = F.split(F.get(parts, F.lit(2)), FIELD_SEP, 2)
    step = F.split("step", FIELD_SEP)
    return (
        lines.filter(F.trim("value") != "")
        .select(
            parts[0].alias("uid"),
            F.coalesce(F.get(more, F.lit(1)), F.col("traj_id")).alias("traj_id"),
            F.coalesce(F.get(more, F.lit(0)).cast("int"), F.lit(0)).alias("first"),
            F.posexplode(F.split(parts[1], STEP_SEP)).alias("at", "step"),
        )
        .select(
            "uid",
            "traj_id",
            (F.col("first") + F.col("at")).alias("seq"),
            step[0].cast("double").alias("lat"),
            step[1].cast("double").alias("lon"),
            parse_ts(F.get(step, F.lit(2))).alias("ts"),
        )
    )


def read_trajectory_text(spark: SparkSession, path: str) -> DataFrame:
    """Points of trajectory text; a line is a trajectory, named by file and place, unless it names one itself."""
    place = F.concat_ws(
        "-", F.element_at(F.split("path", "/"), -1), F.col("split_start"), F.col("running")
    )
    return parse_trajectory_lines(_ordered_lines(spark.read.text(path)).select(place.alias("traj_id"), "value"))
