"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from dwellgrid.lineage import cut

# Edges that one task may join, for callers that allow it: some 20 MB.
ONE_TASK_EDGES = 200_000


def _with_least_neighbour(edges: DataFrame) -> DataFrame:
    """Attach to each (u, v) the smallest of u and all its neighbours.

    The minimum is pre-aggregated before the shuffle, and the join's right side has one
    row per node, so a hub's edges can be split over many tasks.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").withColumn("least", F.least("u", "least"))


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("u"), F.col("v")),
        F.struct(F.col("v").alias("u"), F.col("u").alias("v")),
    )
    return edges.select(F.inline(ends))


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of edges a–b that are not their component's smallest."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            break
        # The root of the larger label goes below the smaller one, then every node to its root.
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = least[least]
            if (above == least).all():
                break
            least = above
    inner = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[inner], nodes[least[inner]]


def _in_one_task(state: DataFrame) -> DataFrame:
    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, arrow)
        if rows.num_rows:
            ends = (rows.column(c).to_numpy() for c in ("u", "v"))
            found = (pa.array(x, arrow.field("u").type) for x in roots_of(*ends))
            yield pa.RecordBatch.from_arrays(list(found), schema=arrow)

    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[state.schema["u"].dataType.simpleString()]
    arrow = pa.schema([("u", kind), ("v", kind)])
    return state.coalesce(1).mapInArrow(join, state.schema)


def component_roots(
    edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int = 0
) -> DataFrame:
    """(node, root) for every node that is not itself its component's smallest node.

    A graph of at most ``one_task`` different edges between numbers or texts, which are counted, is joined by one
    task at once; any other in rounds, as follows.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until only
    stars are left: each hangs neighbours on the least node around them. A logarithmic
    number of rounds suffices in practice, also for long chains. Every round ends in a
    reliable checkpoint.
    """
    state = cut(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    plain = isinstance(state.schema["u"].dataType, (IntegerType, LongType, StringType))
    if one_task and plain and state.limit(one_task + 1).count() <= one_task:
        state = _in_one_task(state)
        return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while not _settled(state):
        # Large star: every larger neighbour of u moves to u's least neighbour.
        spread = _with_least_neighbour(_both_ways(state))
        large = (
            spread.filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .distinct()
        )
        # Small star: u and its smaller neighbours move to the least of them.
        small = (
            _with_least_neighbour(large)
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        state = cut(small)
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int = 0
) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the component's smallest node."""
    nodes = edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()
    return nodes.join(component_roots(edges, src, dst, one_task), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads straight to a root: one edge per node, no root has one."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()
