"""Stage tables, their text forms and map markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.functions.text import FIELD_SEP, KEY_SEP, LINE_ITEMS, STEP_SEP, TS_FORMAT, joined_lines, keyed_lines

# The text form of a labelled point, "(lat,lon)<TAB>cluster,flag".
_LABELLED = r"^\(([^,]+),([^)]+)\)\t(-?\d+),(\w+)$"


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage table, replacing an earlier one, and go on from the written table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_lines(lines: DataFrame, path: str, keys: list[str] | None = None, files: int | None = None) -> None:
    """Text form of a stage: the ``line`` column, led by tab-separated keys if given.

    A line that is full or goes on another one ends in the place of its first item.
    """
    place = [F.col("place").cast("string")] if "place" in lines.columns else []
    line = F.concat_ws(KEY_SEP, *[F.col(k).cast("string") for k in keys or []], F.col("line"), *place)
    out = lines.select(line.alias("value"))
    if files:
        out = out.repartition(files)
    out.write.mode("overwrite").text(path)


def stay_lines(stays: DataFrame, line_items: int = LINE_ITEMS) -> DataFrame:
    """uid, traj_id, part, line: ``uid<TAB>lat,lon,arrive,leave->...``."""
    step = F.concat_ws(
        FIELD_SEP,
        F.col("lat"),
        F.col("lon"),
        F.date_format("arrive", TS_FORMAT),
        F.date_format("leave", TS_FORMAT),
    )
    return keyed_lines(joined_lines(stays, ["uid", "traj_id"], "stay_seq", step, STEP_SEP, line_items))


def stay_coordinates(lines: DataFrame) -> DataFrame:
    """lat, lon of every stay in stay text lines (column ``line``)."""
    steps = F.explode(F.split(F.split("line", KEY_SEP)[1], STEP_SEP)).alias("step")
    fields = F.split("step", FIELD_SEP)
    return lines.select(steps).select(
        fields[0].cast("double").alias("lat"), fields[1].cast("double").alias("lon")
    )


def labelled_lines(labelled: DataFrame) -> DataFrame:
    """line: ``(lat,lon)<TAB>cluster,flag`` per labelled stay."""
    spot = F.concat(F.lit("("), F.concat_ws(FIELD_SEP, "lat", "lon"), F.lit(")"))
    return labelled.select(
        F.concat_ws(KEY_SEP, spot, F.concat_ws(FIELD_SEP, "cluster_id", "flag")).alias("line")
    )


def read_listed(lines: DataFrame, key: str, item: str, sep: str = FIELD_SEP) -> DataFrame:
    """(key, position from 0, item) of lines ``key<TAB>item,item...`` (column ``value``), parts put together."""
    parts = F.split("value", KEY_SEP)
    first = F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0))
    return lines.select(
        parts[0].alias(key), first.alias("first"), F.posexplode(F.split(parts[1], sep)).alias("at", item)
    ).select(key, (F.col("first") + F.col("at")).alias("position"), item)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, cluster_id, flag of labelled-point text."""
    return parse_labelled(spark.read.text(path))


def parse_labelled(lines: DataFrame) -> DataFrame:
    """lat, lon, cluster_id, flag of labelled-point lines (column ``value``)."""
    return lines.select(
        F.regexp_extract("value", _LABELLED, 1).cast("double").alias("lat"),
        F.regexp_extract("value", _LABELLED, 2).cast("double").alias("lon"),
        F.regexp_extract("value", _LABELLED, 3).cast("int").alias("cluster_id"),
        F.regexp_extract("value", _LABELLED, 4).alias("flag"),
    )


def map_markers(labelled: DataFrame, cluster_id: int) -> DataFrame:
    """One JSON map marker per point of a cluster, position as [lon, lat]."""
    return labelled.filter(F.col("cluster_id") == cluster_id).select(
        F.to_json(F.struct(F.array("lon", "lat").alias("position"))).alias("marker")
    )
