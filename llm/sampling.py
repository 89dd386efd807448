"""Bounded, repeatable samples of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled_ids(rows: DataFrame, most: int, id_col: str = "doc_id") -> list[int]:
    """At most ``most`` ids: those with the least hashes among the least of each of ``16 * most`` hash buckets.

    Every task takes the least of its own rows first, so a group of any size costs one row a bucket and task.
    """
    h = F.xxhash64(F.col(id_col).cast("long"), F.lit("sample"))
    ids = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), h.alias("h"))
    found = ids.groupBy(F.pmod("h", F.lit(16 * most)).alias("bucket")).agg(F.min(F.struct("h", "i")).alias("least"))
    least = sorted((r.least.h, r.least.i) for r in found.select("least").collect())
    return sorted({i for _, i in least[:most]})


def rows_of(docs: DataFrame, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """The rows of a bounded list of ids."""
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i,) for i in ids], "__chosen long")
    return docs.join(F.broadcast(chosen), docs[id_col] == chosen["__chosen"], "left_semi")


