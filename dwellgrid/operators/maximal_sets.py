"""The largest sets of users who share enough regions, of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.lineage import cut
from dwellgrid.operators.numbering import number_all
from dwellgrid.operators.profiles import member_blocks, user_profiles

# Profiles of a prefix class that one task searches; larger classes are split by their next region first.
CLASS_ITEMS = 2000


def _numbered(profiles: DataFrame) -> DataFrame:
    """(profile, regions) with regions as numbers, seldom ones first: classes of popular regions have few later ones."""
    rows = profiles.select("profile", F.explode("regions").alias("cluster_id"))
    popularity = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("popularity"))
    numbers = number_all(popularity, ["popularity", "cluster_id"], "number").select("cluster_id", "number")
    return rows.join(numbers, "cluster_id").groupBy("profile").agg(F.sort_array(F.collect_list("number")).alias("regions"))


def _divided(classes: DataFrame, length: int, min_support: int) -> DataFrame:
    """(prefix, profile, regions) with prefixes longer by one later region, as far as ``min_support`` regions can be had."""
    last = F.coalesce(F.try_element_at("prefix", F.lit(-1)), F.lit(0))
    later = F.filter("regions", lambda r: r > last)
    heads = F.slice(later, 1, F.greatest(F.lit(0), F.size(later) - (min_support - length)))
    return classes.select("prefix", "profile", "regions", F.explode(heads).alias("head")).select(
        F.concat("prefix", F.array("head")).alias("prefix"), "profile", "regions"
    )


def closed_in_class(later: list[int], n: int, least: int) -> Iterator[tuple[int, list[int]]]:
    """(bits, places): rows of ``n`` that have ``least`` regions of ``later`` in common, and the places of all they have.

    ``later`` has a bit for each row with the region. Depth first over regions, each set of rows taken once; rows that have
    enough in common are not searched further, and neither given where a row besides has ``least`` of these regions too.
    """
    everything = (1 << n) - 1
    stack = [(everything, [(k, bits) for k, bits in enumerate(later) if bits], -1)]
    while stack:
        rows, regions, core = stack.pop()
        common = [k for k, bits in regions if bits == rows]
        if len(common) >= least:
            # at_least[t]: rows with t of the common regions or more
            at_least = [everything] + [0] * least
            for k in common if len(common) > least else ():
                for t in range(least, 0, -1):
                    at_least[t] |= at_least[t - 1] & later[k]
            if not at_least[least] & ~rows:
                yield rows, common
            continue
        rest = [(k, bits) for k, bits in regions if bits != rows]
        for k, own in rest:
            if k <= core:
                continue
            inner = [(x, bits & own) for x, bits in regions if bits & own]
            # Rows that have an earlier region in common as well are found by that one.
            if len(inner) >= least and not any(bits & own == own for x, bits in rest if x < k):
                stack.append((own, inner, k))


def _searched(min_support: int):
    def search(table: pa.Table) -> pa.Table:
        prefix = table.column("prefix")[0].as_py()
        names = np.array(table.column("profile").to_pylist(), object)
        lists = table.column("regions").combine_chunks()
        row = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy())
        regions, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        has = np.zeros((len(regions), len(names)), bool)
        has[place, row] = True
        bits = [int.from_bytes(x.tobytes(), "little") for x in np.packbits(has, axis=1, bitorder="little")]
        begin = int(np.searchsorted(regions, prefix[-1], "right"))
        found = {"regions": [], "prefix": [], "profiles": []}
        for rows, common in closed_in_class(bits[begin:], len(names), min_support - len(prefix)):
            earlier = [k for k in range(begin) if bits[k] & rows == rows]
            everywhere = regions[[*earlier, *(begin + k for k in common)]].tolist()
            found["regions"].append(everywhere)
            found["prefix"].append(prefix)
            # The class of its first regions gives the set, others only tell that nothing enlarges it.
            mine = np.frombuffer(rows.to_bytes(len(names) // 8 + 1, "little"), np.uint8)
            whole = np.unpackbits(mine, bitorder="little")[: len(names)].astype(bool)
            found["profiles"].append(names[whole].tolist() if everywhere[: len(prefix)] == prefix else None)
        kinds = {"regions": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64()), "profiles": pa.list_(pa.string())}
        return pa.table({c: pa.array(found[c], kind) for c, kind in kinds.items()})

    return search


def _of_whole_prefixes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, prefix) of classes with ``min_support`` regions of prefix, and (regions, profile) where these are the first ones."""
    size = classes.groupBy("prefix").agg(F.count(F.lit(1)).alias("size"))
    counted = classes.select("prefix", F.explode("regions").alias("region")).groupBy("prefix", "region").agg(F.count(F.lit(1)).alias("n"))
    found = cut(
        counted.join(size, "prefix").filter("n = size").groupBy("prefix").agg(F.sort_array(F.collect_list("region")).alias("regions"))
    )
    first = found.filter(F.slice("regions", 1, F.size("prefix")) == F.col("prefix"))
    return found.select("regions", "prefix"), classes.join(first.select("prefix", F.col("regions").alias("whole")), "prefix").select(
        F.col("whole").alias("regions"), "profile"
    )


def frequent_maximal_sets(
    pairs: DataFrame, min_support: int = 3, class_items: int = CLASS_ITEMS, block: int | None = None, in_blocks: bool = False
) -> DataFrame:
    """(set_id, uid, support) of the sets of users in at least ``min_support`` common regions to which none can be added.

    Users with the same regions are taken as one until the end. Such a set is all users of some ``min_support`` regions, and of
    any so many of the regions they have in common. So regions are searched, not users: a class has the profiles with a prefix of
    regions, and one task finds depth first, with profiles as bits, which later regions go with it. Classes above
    ``class_items`` profiles are split by one more region of the prefix until they fit or the prefix has ``min_support`` regions.
    A class tells of a set whether a profile of its own enlarges it; a set is largest if every class of its regions
    tells that none does, which is counted, so sets are never compared with each other and profiles never paired.
    A user's regions are one row. With ``in_blocks`` a row has many users of a set, (set_id, uids, support), so that sets of many users
    are not shuffled user by user. ``block`` is taken for older callers; no pairs are made that it could divide. The number of sets may be exponential in the regions that users share, as the
    question has it.
    """
    members, profiles = user_profiles(pairs, min_support)
    everybody = cut(_numbered(profiles))
    classes = everybody.select(F.array().cast("array<bigint>").alias("prefix"), "profile", "regions")
    told, given = [], []
    for length in range(1, min_support + 1):
        classes = cut(_divided(classes, length, min_support))
        sizes = classes.groupBy("prefix").agg(F.count(F.lit(1)).alias("size"))
        large = cut(sizes.filter(F.col("size") > class_items).select("prefix"))
        searched = cut(
            classes.join(large, "prefix", "left_anti")
            .groupBy("prefix")
            .applyInArrow(_searched(min_support), "regions array<bigint>, prefix array<bigint>, profiles array<string>")
        )
        told.append(searched.select("regions", "prefix"))
        given.append(searched.filter("profiles IS NOT NULL").select("regions", F.explode("profiles").alias("profile")))
        classes = classes.join(large, "prefix", "left_semi")
        if large.isEmpty():
            break
    else:
        last, crowds = _of_whole_prefixes(classes)
        told[-1] = told[-1].unionByName(last)
        given.append(crowds)
    largest = told[-1]
    for length in range(len(told), 0, -1):
        # All classes that a prefix was split into, as far as the regions of the set go, have told.
        shorter = F.slice("prefix", 1, length - 1)
        place = F.coalesce(F.array_position("regions", F.try_element_at("shorter", F.lit(-1))), F.lit(0))
        largest = (
            largest.groupBy("regions", shorter.alias("shorter"))
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == F.size("regions") - min_support + length - place)
            .select("regions", F.col("shorter").alias("prefix"))
        )
        if length > 1:
            largest = largest.unionByName(told[length - 2])
    parts = given[0]
    for more in given[1:]:
        parts = parts.unionByName(more)
    named = parts.join(largest.select("regions"), "regions").select(
        F.sha2(F.array_join("regions", ","), 256).alias("set_id"), "profile", F.size("regions").cast("bigint").alias("support")
    )
    blocks = named.join(member_blocks(members), "profile").select("set_id", "uids", "support")
    return blocks if in_blocks else blocks.select("set_id", F.explode("uids").alias("uid"), "support")
