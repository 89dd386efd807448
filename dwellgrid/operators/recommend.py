"""Regions of similar users that a user does not know yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dwellgrid.functions.text import FIELD_SEP, natural_sorted
from dwellgrid.operators.numbering import number_all

# Fixed value: the text for a user with similar users but nothing to recommend.
NOTHING = "NO RECOMMENDATION"
# Bits of an offer's number that are its user's place in text order; those above are the round.
PLACE_BITS = 40
# Pairs of profiles that one task hands offers to, as long as that asks for no more than MOST_TASKS tasks.
TASK_PAIRS = 500_000
MOST_TASKS = 10_000


def recommend_regions(
    similar: DataFrame, ranked: DataFrame, top_n: int = 6, exclude: str = "region"
) -> DataFrame:
    """uid, position, cluster_id: up to ``top_n`` regions in the order they are picked.

    In round r every similar user, in text order, offers their r-th region; it is picked
    if new. Picking ends at ``top_n`` or with the first round that adds nothing.
    ``exclude="region"`` leaves out regions the user has visited;
    ``exclude="region_and_count"`` only those both visited equally often.

    Each round before the end adds a region, so rounds from ``top_n`` on never count
    and a similar user's first ``top_n`` regions suffice.
    """
    known = {"region": ["cluster_id"], "region_and_count": ["cluster_id", "visits"]}[exclude]
    offers = ranked.filter(F.col("rank") <= top_n).select(
        F.col("uid").alias("other_uid"), "cluster_id", "visits", (F.col("rank") - 1).alias("round")
    )
    earliest = F.min(F.struct("round", "other_uid")).alias("pick")
    fresh = (
        similar.select("uid", "other_uid")
        .join(offers, "other_uid")
        .groupBy("uid", *known)
        .agg(earliest)
        .join(ranked.select("uid", *known), ["uid", *known], "left_anti")
    )
    if len(known) > 1:
        fresh = fresh.groupBy("uid", "cluster_id").agg(F.min("pick").alias("pick"))
    return _picked(fresh, "uid", top_n)


def _picked(fresh: DataFrame, to: str, top_n: int) -> DataFrame:
    """``to``, position, cluster_id: the first ``top_n`` of the new regions, up to the first round without one.

    The cut to ``top_n`` comes first: it reaches below the shuffle, and the rounds without
    a gap are a prefix of the picks either way.
    """
    fresh = fresh.select(to, "cluster_id", "pick.round", "pick.other_uid")
    picks = W.partitionBy(to).orderBy("round", "other_uid")
    rounds = W.partitionBy(to).orderBy("round")
    return (
        fresh.withColumn("position", F.row_number().over(picks))
        .filter(F.col("position") <= top_n)
        .withColumn("nth_round", F.dense_rank().over(rounds))
        .filter(F.col("nth_round") == F.col("round") + 1)
        .select(to, "position", "cluster_id")
    )


def recommend_by_profile(
    ranked: DataFrame,
    members: DataFrame,
    profiles: DataFrame,
    pairs: DataFrame,
    top_n: int = 6,
    exclude: str = "region",
) -> DataFrame:
    """What ``recommend_regions`` gives where similar users are those who share enough regions, without listing them.

    ``members`` and ``profiles`` are from ``user_profiles``, ``pairs`` from ``profile_pairs``. Of the users of a
    profile only the earliest offer of each region counts for others, so profiles, not users, are paired. An offer is a
    number, its round ahead of its user's place in text order, so that the earliest one is found by hashing, not sorting.
    Without counts, all users of a profile know the same regions and get the same picks, which are handed to them last.
    With counts, users are told apart once the offers to their profile are down to those that may be picked.
    """
    known = {"region": ["cluster_id"], "region_and_count": ["cluster_id", "visits"]}[exclude]
    earliest = F.min("pick").alias("pick")
    placed = number_all(members.select("uid", "profile"), ["uid"], "nth")
    offers = (
        ranked.filter(F.col("rank") <= top_n)
        .join(placed, "uid")
        .select(
            F.col("profile").alias("b"),
            "cluster_id",
            "visits",
            (F.shiftleft((F.col("rank") - 1).cast("bigint"), PLACE_BITS) + F.col("nth")).alias("pick"),
        )
        .groupBy("b", *known)
        .agg(earliest)
    )
    own = profiles.select(F.col("profile").alias("a"), F.explode("regions").alias("cluster_id"))
    if exclude == "region":
        fresh = _offered(pairs, offers).groupBy("a", *known).agg(earliest).join(own, ["a", "cluster_id"], "left_anti")
        picked = _picked(_parted(fresh), "a", top_n).withColumnRenamed("a", "profile")
        return members.join(picked, "profile").select("uid", "position", "cluster_id")
    # Users of one profile are similar to each other; a user's own offers are known to them.
    itself = profiles.select(F.col("profile").alias("a"), F.col("profile").alias("b"))
    fresh = _offered(pairs.unionByName(itself), offers).groupBy("a", *known).agg(earliest)
    fresh = (
        _pickable(fresh, own, top_n)
        .withColumnRenamed("a", "profile")
        .join(members, "profile")
        .join(ranked.select("uid", *known), ["uid", *known], "left_anti")
        .groupBy("uid", "cluster_id")
        .agg(earliest)
    )
    return _picked(_parted(fresh), "uid", top_n)


def _offered(pairs: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers of ``b`` for every ``a`` it is paired with; each task takes a bounded number of pairs."""
    tasks = min(pairs.count() // TASK_PAIRS + 1, MOST_TASKS)
    return pairs.repartition(int(tasks), "b").join(offers, "b")


def _parted(fresh: DataFrame) -> DataFrame:
    """A pick as its round and its user's place."""
    place = F.col("pick").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    pick = F.struct(F.shiftright("pick", PLACE_BITS).alias("round"), place.alias("other_uid"))
    return fresh.withColumn("pick", pick)


def _pickable(fresh: DataFrame, own: DataFrame, top_n: int) -> DataFrame:
    """Of the earliest offers of each region and count to a profile, those that one of its users may pick.

    A user leaves out at most one count of a region, so each region's first two offers suffice. The first of a region that the
    profile does not know and the second of one it knows are open to all its users; what comes after ``top_n`` of these is picked by nobody.
    """
    first = W.partitionBy("a", "cluster_id").orderBy("pick")
    earlier = W.partitionBy("a").orderBy("pick").rowsBetween(W.unboundedPreceding, -1)
    two = fresh.withColumn("nth", F.row_number().over(first)).filter("nth <= 2")
    two = two.join(own.withColumn("own", F.lit(True)), ["a", "cluster_id"], "left")
    to_all = F.when(F.col("nth") == F.when(F.col("own"), 2).otherwise(1), 1).otherwise(0)
    counted = two.withColumn("to_all", to_all).withColumn("before", F.coalesce(F.sum("to_all").over(earlier), F.lit(0)))
    return counted.filter(F.col("before") < top_n).select(*fresh.columns)


def recommendation_lines(similar: DataFrame, picked: DataFrame) -> DataFrame:
    """uid, line for every user with similar users (``uid`` of ``similar``), regions in natural order."""
    lists = picked.groupBy("uid").agg(
        F.array_join(natural_sorted(F.collect_list(F.col("cluster_id").cast("string"))), FIELD_SEP).alias("line")
    )
    return (
        similar.select("uid")
        .distinct()
        .join(lists, "uid", "left")
        .select("uid", F.coalesce("line", F.lit(NOTHING)).alias("line"))
    )
