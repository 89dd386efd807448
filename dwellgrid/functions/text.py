"""Text orders and line codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of the stage text formats.
KEY_SEP = "\t"
STEP_SEP = "->"
FIELD_SEP = ","
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Most items one text line carries before the next ``part`` goes on. A line that is full or goes on another one
# says in a last field which key's and from which place, so that any reader can put the parts together.
LINE_ITEMS = 1_000_000


def natural_key(c: Column) -> list[Column]:
    """Sort columns for "shorter first, then by text"."""
    text = c.cast("string")
    return [F.length(text), text]


def natural_sorted(arr: Column) -> Column:
    """Array of text in natural order."""
    pairs = F.transform(arr, lambda v: F.struct(F.length(v).alias("len"), v.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def numeric_sorted(arr: Column) -> Column:
    """Array of numeric text in numeric order (equal numbers by text)."""
    pairs = F.transform(arr, lambda v: F.struct(v.cast("bigint").alias("num"), v.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def joined_lines(
    df: DataFrame,
    keys: list[str],
    position: str,
    item: Column,
    sep: str,
    line_items: int = LINE_ITEMS,
) -> DataFrame:
    """One text per key holding its items in ``position`` order (0-based, gap-free).

    A key with more than ``line_items`` items gets several rows, numbered by ``part``,
    so that no task ever holds an unbounded group. ``place`` is NULL on the only line of
    a key; on lines that are full or go on another one it is the position of the first item.
    """
    pieces = df.select(
        *keys,
        F.expr(f"CAST({position} DIV {int(line_items)} AS INT)").alias("part"),
        F.struct(F.col(position).alias("p"), item.cast("string").alias("v")).alias("piece"),
    )
    return (
        pieces.groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
        .select(
            *keys,
            "part",
            F.array_join(F.transform("pieces", lambda p: p["v"]), sep).alias("line"),
            F.when(
                (F.col("part") > 0) | (F.size("pieces") == int(line_items)),
                F.col("part").cast("bigint") * int(line_items),
            ).alias("place"),
        )
    )


def keyed_lines(lines: DataFrame) -> DataFrame:
    """uid, traj_id, part, line with the user ahead of the line; of a key with several lines each names its place."""
    goes_on = F.when(F.col("place").isNotNull(), F.concat_ws(FIELD_SEP, "place", "traj_id"))
    return lines.withColumn("line", F.concat_ws(KEY_SEP, "uid", "line", goes_on)).drop("place")
