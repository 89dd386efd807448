"""Row numbers that survive one group holding most of the rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from dwellgrid.lineage import cut

# Most rows of one group that a single window task is given.
GROUP_ROWS = 1_000_000


def oversized_groups(df: DataFrame, keys: list[str], limit: int = GROUP_ROWS) -> DataFrame:
    """Keys with more than ``limit`` rows (there are at most rows/limit of them)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > limit)


def number_all(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """1-based number of every row in ``order``, without gathering rows in one task.

    Rows are range-partitioned and sorted; a row's number is its place inside its
    partition plus the sizes of the partitions before it (one count per partition).
    """
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # Bits above 33 of the generated id are the partition, those below count rows in it.
    part = F.shiftrightunsigned("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition: bounded by the partition count, whatever the data size.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_place", "_part", "_before")
    )


def number_in_groups(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    name: str,
    limit: int = GROUP_ROWS,
    fits: bool | None = None,
) -> DataFrame:
    """1-based row number inside each group.

    Group sizes are counted first, unless the caller knows whether all fit. While all groups fit ``limit``, a window does it in
    one shuffle; otherwise rows are numbered over range partitions, which split big
    groups, and each group's first number is subtracted.
    """
    if fits is None:
        fits = oversized_groups(df, keys, limit).isEmpty()
    if fits:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    numbered = cut(number_all(df, [*keys, *order], "_overall"))
    starts = numbered.groupBy(*keys).agg(F.min("_overall").alias("_start"))
    return (
        numbered.join(starts, keys)
        .withColumn(name, (F.col("_overall") - F.col("_start") + 1).cast("int"))
        .drop("_overall", "_start")
    )


def runs_short(df: DataFrame, seq: str, limit: int = GROUP_ROWS) -> bool:
    """Whether no group is above ``limit`` rows, seen from numbers that count from 0."""
    return df.filter(F.col(seq) >= limit).isEmpty()


def with_previous(
    df: DataFrame,
    keys: list[str],
    seq: str,
    columns: list[str],
    limit: int = GROUP_ROWS,
    fits: bool | None = None,
) -> DataFrame:
    """Each row with ``prev_<column>`` of the row before it in its group.

    ``seq`` counts a group's rows from 0, gaps allowed. If some group is above ``limit``
    rows, predecessors are found by an equi-join on the row number, which spreads a big
    group, instead of a window over it.
    """
    if runs_short(df, seq, limit) if fits is None else fits:
        inside = W.partitionBy(*keys).orderBy(seq)
        return df.select("*", *[F.lag(c).over(inside).alias(f"prev_{c}") for c in columns])
    rows = cut(number_in_groups(df, keys, [seq], "_nth", limit, fits=False))
    before = rows.select(
        *keys, (F.col("_nth") + 1).alias("_nth"), *[F.col(c).alias(f"prev_{c}") for c in columns]
    )
    return rows.join(before, [*keys, "_nth"], "left").drop("_nth")

def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` (whole numbers) over all rows up to each row in ``order``, without gathering rows in one task.

    Rows are range-partitioned and sorted; a row's total is the sum inside its partition plus the sums of the
    partitions before it (one number per partition). Rows that are equal in ``order`` follow each other in any order.
    """

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False)) + total
            total = int(sums[-1]) if len(sums) else total
            parts = pa.array(np.full(len(sums), part, np.int64))
            yield batch.append_column("_part", parts).append_column(name, pa.array(sums, pa.int64()))

    schema = StructType([*df.schema.fields, StructField("_part", LongType()), StructField(name, LongType())])
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema))
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    # One row per partition, as in ``number_all``.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_part", "_before")
    )
