"""Regions per user and users per region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.text import FIELD_SEP, LINE_ITEMS, joined_lines
from dwellgrid.operators.numbering import number_in_groups


def visit_counts(visits: DataFrame) -> DataFrame:
    """uid, cluster_id, visits; noise does not count."""
    return (
        visits.filter(F.col("cluster_id") != 0)
        .groupBy("uid", "cluster_id")
        .agg(F.count(F.lit(1)).alias("visits"))
    )


def user_region(visits: DataFrame) -> DataFrame:
    """uid, cluster_id, visits, rank; most visited first, then by cluster_id."""
    counts = visit_counts(visits)
    return number_in_groups(counts, ["uid"], [F.desc("visits"), F.asc("cluster_id")], "rank")


def user_region_lines(ranked: DataFrame) -> DataFrame:
    """uid, part, line: the user's regions, most visited first."""
    placed = ranked.withColumn("place", F.col("rank") - 1)
    return joined_lines(placed, ["uid"], "place", F.col("cluster_id"), FIELD_SEP)


def region_user(ranked: DataFrame) -> DataFrame:
    """cluster_id, uid: the same relation the other way round."""
    return ranked.select("cluster_id", "uid")


def region_user_lines(pairs: DataFrame, line_items: int = LINE_ITEMS) -> DataFrame:
    """cluster_id, part, line: a region's users in numeric order."""
    numbered = number_in_groups(
        pairs, ["cluster_id"], [F.col("uid").cast("bigint"), F.col("uid")], "place"
    ).withColumn("place", F.col("place") - 1)
    return joined_lines(numbered, ["cluster_id"], "place", F.col("uid"), FIELD_SEP, line_items)


def transaction_counts(pairs: DataFrame, line_items: int = LINE_ITEMS) -> DataFrame:
    """Regions with exactly the same users, counted: set_id (their least region), part, users, freq.

    Equal user sets are recognised by the digests of their lines, so that big sets need
    not be compared or shuffled as a whole.
    """
    lines = region_user_lines(pairs, line_items)
    digest = F.struct("part", F.sha2("line", 256).alias("sha"))
    signed = lines.groupBy("cluster_id").agg(F.array_sort(F.collect_list(digest)).alias("signature"))
    same = signed.groupBy("signature").agg(
        F.min("cluster_id").alias("cluster_id"), F.count(F.lit(1)).alias("freq")
    )
    return lines.join(same, "cluster_id").select(
        F.col("cluster_id").alias("set_id"), "part", F.col("line").alias("users"), "freq"
    )
