"""As-of join: for each probe the last row of a history at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dwellgrid.lineage import cut
from dwellgrid.operators.numbering import GROUP_ROWS, oversized_groups


def as_of(
    probes: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Sequence[str],
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Rows of ``probes`` with ``values`` of the last row of ``history`` with equal ``keys`` and ``at`` not later.

    Both tables have ``keys`` and ``at``. History and probes are put in one order, and each probe takes what was
    last seen before it: one shuffle, no pairs. Of history rows with equal keys and time the one with the largest
    values counts. While no key has more than ``limit`` rows, which is counted, a window does it; else rows are
    dealt in ranges, which divide a large key, and each range starts with the last history row of those before it,
    one row per range. Probes without a predecessor, a key or a time get NULLs; history without one is never found.
    """
    keys = list(keys)
    told = [c for c in probes.columns]
    nowhere = F.lit(False)
    for c in (*keys, at):
        nowhere = nowhere | F.col(c).isNull()
    known = history.filter(~nowhere)
    value = F.struct(*[F.col(c) for c in values])
    value_type = history.select(value.alias("v")).schema["v"].dataType
    probe = F.struct(*[F.col(c) for c in told])
    probe_type = probes.select(probe.alias("p")).schema["p"].dataType
    rows = known.select(
        *keys, F.col(at).alias("_at"), F.lit(0).alias("_asks"), value.alias("_value"), F.lit(None).cast(probe_type).alias("_probe")
    ).unionByName(
        probes.filter(~nowhere).select(
            *keys, F.col(at).alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast(value_type).alias("_value"), probe.alias("_probe")
        )
    )
    order = ["_at", "_asks", "_value"]
    if oversized_groups(rows, keys, limit).isEmpty():
        before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        seen = rows.withColumn("_seen", F.last("_value", ignorenulls=True).over(before))
    else:
        seen = _in_ranges(rows, keys, order)
    found = seen.filter("_asks = 1").select("_probe.*", *[F.col("_seen")[c].alias(c) for c in values])
    nothing = [F.lit(None).cast(history.schema[c].dataType).alias(c) for c in values]
    return found.unionByName(probes.filter(nowhere).select(*told, *nothing))


def _in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with the last value seen at or before each, over range partitions."""
    placed = cut(
        rows.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftrightunsigned("_place", 33))
    )
    # The last history row of each range, and of all ranges before it: one row per range.
    last = placed.filter("_asks = 0").groupBy("_part").agg(F.max_by(F.struct(*keys, "_value"), "_place").alias("_last"))
    parts = placed.select("_part").distinct().join(last, "_part", "left")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    own = W.partitionBy("_part", *keys).orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"_carried.{c}").eqNullSafe(F.col(c))
    return placed.join(F.broadcast(carried), "_part").select(
        "_asks",
        "_probe",
        F.coalesce(F.last("_value", ignorenulls=True).over(own), F.when(same, F.col("_carried._value"))).alias("_seen"),
    )
