"""What can be reached from given nodes of a graph, and in how many steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.lineage import cut


def reached(
    edges: DataFrame, starts: DataFrame, max_hops: int | None = None, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """(start, node, hops) of the nodes other than ``start`` that edges lead to from it, and their least distance.

    ``starts`` has one column; edges are followed from ``src`` to ``dst``. Each round takes the nodes found by the last
    one a step further and keeps what is new, so only edges of reached nodes are touched, and the number of rounds is
    the greatest distance. Every round ends in a reliable checkpoint. Missing ends lead nowhere; starts
    without edges reach nothing; repeated starts and edges count once.
    """
    start = F.col(starts.columns[0])
    ways = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).filter(
        "node IS NOT NULL AND next IS NOT NULL AND node != next"
    )
    begin = starts.filter(start.isNotNull()).select(start.alias("start"), start.alias("node")).distinct()
    last = begin
    seen = begin
    rounds: list[DataFrame] = []
    while max_hops is None or len(rounds) < max_hops:
        found = (
            last.join(ways, "node")
            .select("start", F.col("next").alias("node"))
            .distinct()
            .join(seen, ["start", "node"], "left_anti")
        )
        last = cut(found)
        if last.isEmpty():
            break
        rounds.append(last.withColumn("hops", F.lit(len(rounds) + 1)))
        seen = seen.unionByName(last)
    if not rounds:
        return begin.withColumn("hops", F.lit(0)).limit(0)
    whole = rounds[0]
    for more in rounds[1:]:
        whole = whole.unionByName(more)
    return whole
