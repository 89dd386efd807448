"""Users who share regions: frequent itemsets of users over regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.text import FIELD_SEP, joined_lines
from dwellgrid.lineage import cut
from dwellgrid.operators.numbering import number_in_groups
from dwellgrid.operators.profiles import (
    grown_blocks,
    listed_sets,
    paired_blocks,
    profile_supports,
    user_pairs,
    user_profiles,
)
from dwellgrid.operators.shared_groups import PAIR_BLOCK, frequent_items


def frequent_pairs(pairs: DataFrame, min_support: int = 3, block: int = PAIR_BLOCK) -> DataFrame:
    """uid, other_uid, support for users (uid < other_uid) sharing ``min_support`` regions.

    Users with equal regions are one profile. Only profiles are paired and counted; their users come in last and
    without a shuffle of pairs, so what grows with the pairs of users is the result alone.
    """
    members, found = user_profiles(pairs, min_support)
    return user_pairs(members, cut(profile_supports(found, min_support, block)))


def frequent_itemsets(
    pairs: DataFrame, min_support: int = 3, max_len: int = 2, block: int = PAIR_BLOCK
) -> DataFrame:
    """items (sorted), freq of all user sets up to ``max_len`` users.

    Level by level: sets that agree in all but their last member are merged, and their common regions intersected.
    Members are blocks of users with equal regions; the users of a set of blocks come in last and without a shuffle,
    so what grows with the sets of users is the result alone.
    """
    known = cut(
        pairs.join(frequent_items(pairs, min_support).select("uid"), "uid", "left_semi")
        .select("cluster_id", "uid")
        .distinct()
    )
    levels = [
        frequent_items(known, min_support).select(F.array("uid").alias("items"), "freq")
    ]
    if max_len >= 2:
        members, found = user_profiles(known, min_support)
        supports = cut(profile_supports(found, min_support, block))
        levels.append(
            user_pairs(members, supports).select(
                F.array("uid", "other_uid").alias("items"), F.col("support").alias("freq")
            )
        )
    if max_len >= 3:
        sets = paired_blocks(members, found, supports)
    for length in range(3, max_len + 1):
        sets = grown_blocks(cut(sets), length, min_support, block)
        levels.append(listed_sets(sets, length))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole


def similar_users(found: DataFrame) -> DataFrame:
    """uid, other_uid, support with every pair both ways.

    All pairs one way, then all the other way: a user's rows stay together as ``found`` lists them, and files of them stay small.
    ``found`` is listed twice, from what its last shuffle has left.
    """
    turned = found.select(F.col("other_uid").alias("uid"), F.col("uid").alias("other_uid"), "support")
    return found.unionByName(turned)


def similar_user_lines(similar: DataFrame) -> DataFrame:
    """uid, part, line: a user's similar users in text order."""
    numbered = number_in_groups(similar, ["uid"], ["other_uid"], "place")
    numbered = numbered.withColumn("place", F.col("place") - 1)
    return joined_lines(numbered, ["uid"], "place", F.col("other_uid"), FIELD_SEP)
