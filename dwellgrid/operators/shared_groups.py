"""Pairs of items that share groups, counted without pairing what everybody shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dwellgrid.lineage import cut

# Rows of a group that meet each other in one task; larger groups are cut into blocks.
PAIR_BLOCK = 500
# Pairs that one task joins, as long as that asks for no more than MOST_TASKS tasks.
TASK_PAIRS = 1_000_000
MOST_TASKS = 10_000


def frequent_items(pairs: DataFrame, min_support: int = 3) -> DataFrame:
    """uid, freq of the users who appear in at least ``min_support`` regions."""
    return (
        pairs.groupBy("uid")
        .agg(F.count(F.lit(1)).alias("freq"))
        .filter(F.col("freq") >= min_support)
    )


def blocked_pairs(rows: DataFrame, group: list[str], item: str, block: int, tasks: int | None = None) -> DataFrame:
    """Rows of one group joined with each other as columns a_* and b_*, a's item smaller.

    A group is hashed into blocks of about ``block`` rows, and each pair of blocks is
    its own join key, so no key brings more than a block per side to a task. Rows are few beside their pairs, so the
    number of tasks goes by the pairs, which are counted from the sizes of the groups, unless ``tasks`` gives it.
    """
    counted = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    if tasks is None:
        n_pairs = (counted.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0) / 2
        tasks = min(int(n_pairs / TASK_PAIRS) + 1, MOST_TASKS)
    sizes = counted.select(*group, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(item), "blocks").cast("int"))
    values = [c for c in rows.columns if c not in group]
    left = placed.select(
        *group, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"),
        F.struct(*values).alias("l"),
    )
    right = placed.select(
        *group, F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"),
        F.struct(*values).alias("r"),
    )
    keys = [*group, "i", "j"]
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).filter(
        (F.col(f"l.{item}") < F.col(f"r.{item}"))
        | ((F.col("i") < F.col("j")) & (F.col(f"l.{item}") > F.col(f"r.{item}")))
    )
    swap = F.col(f"l.{item}") > F.col(f"r.{item}")
    met = met.select(*group, F.when(swap, F.col("r")).otherwise(F.col("l")).alias("a"),
                     F.when(swap, F.col("l")).otherwise(F.col("r")).alias("b"))
    return met.select(
        *group,
        *[F.col(f"a.{v}").alias(f"a_{v}") for v in values],
        *[F.col(f"b.{v}").alias(f"b_{v}") for v in values],
    )


def shared_groups(pairs: DataFrame, min_support: int = 3, block: int = PAIR_BLOCK) -> DataFrame:
    """uid, other_uid, support for users (uid < other_uid) sharing ``min_support`` regions, user by user.

    A uid may be of any type that can be compared and hashed, a struct too.

    Every user sets aside the ``min_support - 1`` most popular of their regions. Two
    users can only share enough regions if they share one that neither has set aside,
    so only those regions bring users together, and the regions everybody goes to bring
    nobody together. The regions set aside are then added to the counts of the
    candidates found.
    """
    known = cut(
        pairs.join(frequent_items(pairs, min_support).select("uid"), "uid", "left_semi")
        .select("cluster_id", "uid")
        .distinct()
    )
    popularity = known.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("popularity"))
    by_popularity = W.partitionBy("uid").orderBy(F.desc("popularity"), F.desc("cluster_id"))
    aside = cut(
        known.join(popularity, "cluster_id")
        .withColumn("place", F.row_number().over(by_popularity))
        .filter(F.col("place") <= min_support - 1)
        .select("uid", "cluster_id")
    )
    kept = cut(known.join(aside, ["uid", "cluster_id"], "left_anti"))
    # At most min_support - 1 regions per user.
    lists = aside.groupBy("uid").agg(F.collect_list("cluster_id").alias("aside"))
    rows = kept.join(lists, "uid", "left").select(
        "cluster_id", "uid", F.coalesce("aside", F.array().cast("array<int>")).alias("aside")
    )
    met = blocked_pairs(rows, ["cluster_id"], "uid", block)
    found = cut(
        met.groupBy("a_uid", "b_uid", "a_aside", "b_aside").agg(F.count(F.lit(1)).alias("shared"))
    )

    both = F.size(F.array_intersect("a_aside", "b_aside"))
    a_only = F.transform(
        F.array_except("a_aside", "b_aside"),
        lambda c: F.struct(F.col("b_uid").alias("uid"), c.alias("cluster_id")),
    )
    b_only = F.transform(
        F.array_except("b_aside", "a_aside"),
        lambda c: F.struct(F.col("a_uid").alias("uid"), c.alias("cluster_id")),
    )
    asked = found.select("a_uid", "b_uid", F.inline(F.concat(a_only, b_only)))
    answered = asked.join(kept, ["uid", "cluster_id"], "left_semi").select(
        "a_uid", "b_uid", F.lit(1).cast("bigint").alias("shared")
    )
    return (
        found.select("a_uid", "b_uid", (F.col("shared") + both).alias("shared"))
        .unionByName(answered)
        .groupBy("a_uid", "b_uid")
        .agg(F.sum("shared").alias("support"))
        .filter(F.col("support") >= min_support)
        .select(F.col("a_uid").alias("uid"), F.col("b_uid").alias("other_uid"), "support")
    )
