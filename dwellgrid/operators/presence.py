"""When several users are in one region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.lineage import cut
from dwellgrid.operators.numbering import number_all, running_total


def co_presence(labelled: DataFrame, least: int = 2) -> DataFrame:
    """cluster_id, begins, ends, n_stays: the periods in which at least ``least`` stays of a region last, and how many.

    ``labelled`` has cluster_id, arrive and leave. A stay lasts from its arrival to just before it ends, so one that
    begins when another ends doesn't meet it; noise, stays without length and rows with a missing time don't count. A period ends
    where the number changes. Stays are not paired: arrivals and departures are put in order, a
    running total over ranges gives the number present after each, and the next moment is found by an equi-join on row
    numbers. So a region of any size is spread over tasks. All departures of a region follow its arrivals, so the total
    starts anew at each region by itself.
    """
    moves = F.array(
        F.struct(F.col("arrive").alias("at"), F.lit(1).alias("step")), F.struct(F.col("leave").alias("at"), F.lit(-1).alias("step"))
    )
    moments = (
        labelled.filter("cluster_id <> 0 AND arrive < leave")
        .select("cluster_id", F.inline(moves))
        .groupBy("cluster_id", "at")
        .agg(F.sum("step").alias("step"))
        .filter("step <> 0")
    )
    totals = running_total(moments, ["cluster_id", "at"], "step", "n_stays")
    numbered = cut(number_all(totals, ["cluster_id", "at"], "nth"))
    following = numbered.select(
        (F.col("nth") - 1).alias("nth"), F.col("cluster_id").alias("next_cluster"), F.col("at").alias("ends")
    )
    return (
        numbered.filter(F.col("n_stays") >= least)
        .join(following, "nth")
        .filter("cluster_id = next_cluster")
        .select("cluster_id", F.col("at").alias("begins"), "ends", "n_stays")
    )
