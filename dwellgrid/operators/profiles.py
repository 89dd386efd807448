"""Users with equal regions as one item, so that relations between users need not be listed user by user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dwellgrid.functions.text import FIELD_SEP, LINE_ITEMS
from dwellgrid.lineage import cut
from dwellgrid.operators.numbering import number_all
from dwellgrid.operators.reach import reached
from dwellgrid.operators.shared_groups import PAIR_BLOCK, blocked_pairs, shared_groups

# Users of a profile that travel as one row when pairs of profiles become pairs of users.
MEMBER_BLOCK = 500
# Users of a profile whose pairs with as many of another are listed at once, and users of a group of such blocks.
LIST_USERS = 125
GROUP_USERS = 1000
# Users of a range, and profiles of a group, that meet when lines are written.
RANGE_USERS = 4000
GROUP_PROFILES = 100
# Every group may meet every other: more users make larger groups, so that each user still goes to so many places at most.
MOST_GROUPS = 100
# Pairs of users that one task gives out, as long as that asks for no more than MOST_TASKS tasks.
TASK_PAIRS = 2_000_000
MOST_TASKS = 10_000


def user_profiles(pairs: DataFrame, min_support: int) -> tuple[DataFrame, DataFrame]:
    """(uid, profile, n, n_users) of the users with ``min_support`` regions or more, and (profile, regions, n, n_users) of their profiles.

    A profile is named by the least of its users; a user's regions are one row.
    """
    users = cut(
        pairs.select("uid", "cluster_id")
        .filter("uid IS NOT NULL AND cluster_id IS NOT NULL")
        .groupBy("uid")
        .agg(F.sort_array(F.collect_set("cluster_id")).alias("regions"))
        .filter(F.size("regions") >= min_support)
    )
    profiles = cut(users.groupBy("regions").agg(F.min("uid").alias("profile"), F.count(F.lit(1)).alias("n_users")))
    members = users.join(profiles, "regions").select("uid", "profile", F.size("regions").alias("n"), "n_users")
    return members, profiles.select("profile", "regions", F.size("regions").alias("n"), "n_users")


def profile_supports(profiles: DataFrame, min_support: int, block: int = PAIR_BLOCK) -> DataFrame:
    """(a, a_users, b, b_users, support), a < b, of different profiles with ``min_support`` common regions."""
    rows = profiles.select(F.struct("profile", "n_users").alias("uid"), F.explode("regions").alias("cluster_id"))
    ends = [F.col(f"{c}.{f}").alias(name) for c, x in (("uid", "a"), ("other_uid", "b")) for f, name in (("profile", x), ("n_users", f"{x}_users"))]
    return shared_groups(rows, min_support, block).select(*ends, "support")


def profile_pairs(profiles: DataFrame, min_support: int, block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b), both ways, of different profiles with ``min_support`` common regions."""
    found = profile_supports(profiles, min_support, block)
    return found.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def member_blocks(members: DataFrame, users: int | None = None) -> DataFrame:
    """(profile, block, n, n_users, uids): a profile's users in blocks of about ``users``, else ``MEMBER_BLOCK``, in text order."""
    own = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n_users") / (users or MEMBER_BLOCK))).cast("int")
    return members.groupBy("profile", own.alias("block"), "n", "n_users").agg(
        F.sort_array(F.collect_list("uid")).alias("uids")
    )


def member_groups(members: DataFrame) -> DataFrame:
    """(profile, n, n_users, g, k, uids): blocks of about ``LIST_USERS`` users, dealt to ``MOST_GROUPS`` groups at most and numbered in each by k."""
    groups = min(members.count() // GROUP_USERS + 1, MOST_GROUPS)
    dealt = member_blocks(members, LIST_USERS).withColumn("g", F.pmod(F.xxhash64("profile", "block"), F.lit(groups)).cast("int"))
    # A group has no more blocks than users.
    numbered = dealt.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy("profile", "block")))
    return numbered.select("profile", "n", "n_users", "g", "k", "uids")


def user_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """(uid, other_uid, support), uid < other_uid, of the users of paired profiles and of those who share one.

    ``members`` are from ``user_profiles``, ``found`` from ``profile_supports``; found is read more than once. Users of many profiles
    make a group, and groups meet, dealt to as many tasks as their pairs ask for: there each pair of profiles finds
    its users by their numbers and lists them, one user with all of the other profile, so that a user does not travel once for each
    profile that is paired with theirs.
    """
    alone = found.filter("a_users = 1 AND b_users = 1").select(F.col("a").alias("uid"), F.col("b").alias("other_uid"), "support")
    blocks = cut(member_groups(members))
    lists = blocks.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "uids"))).alias("blocks")).select("g", F.col("blocks.uids").alias("us"))
    side = lambda c, g, k: blocks.select(F.col("profile").alias(c), F.col("g").alias(g), F.col("k").alias(k))
    across = (
        found.filter("a_users > 1 OR b_users > 1").select("a", "b", "support").join(side("a", "g", "k"), "a").join(side("b", "h", "l"), "b")
    )
    first, second = F.struct("g", "k"), F.struct(F.col("h").alias("g"), F.col("l").alias("k"))
    links = across.select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y"), "support").select(
        F.col("x.g").alias("g"), F.col("y.g").alias("h"), F.col("x.k").alias("k"), F.col("y.k").alias("l"), "support"
    )
    within = (
        blocks.filter("n_users > 1")
        .select(F.col("profile").alias("a"), "g", "k", F.col("n").cast("bigint").alias("support"))
        .join(side("a", "h", "l"), "a")
        .filter("g < h OR g = h AND k <= l")
        .select("g", "h", "k", "l", "support")
    )
    links = links.unionByName(within)
    n_across = found.agg(F.sum(F.col("a_users") * F.col("b_users"))).first()[0] or 0
    n_within = members.filter("n_users > 1").agg(F.sum("n_users")).first()[0] or 0
    tasks = int(min((n_across + n_within // 2) // TASK_PAIRS + 1, MOST_TASKS))
    asked = cut(links.select("g", "h").distinct())
    cells = asked.join(lists, "g").join(lists.select(F.col("g").alias("h"), F.col("us").alias("vs")), "h")
    met = links.repartition(tasks, "g", "h").join(cells.repartition(tasks, "g", "h"), ["g", "h"])
    # Only a block that meets itself has a pair both ways.
    itself = ((F.col("g") == F.col("h")) & (F.col("k") == F.col("l"))).alias("itself")
    listed = met.select(F.explode(F.element_at("us", F.col("k"))).alias("u"), F.element_at("vs", F.col("l")).alias("vs"), itself, "support").select(
        "u", F.explode("vs").alias("v"), "itself", "support"
    )
    crowds = listed.filter("NOT itself OR u < v").select(
        F.least("u", "v").alias("uid"), F.greatest("u", "v").alias("other_uid"), "support"
    )
    return alone.unionByName(crowds)


def paired_blocks(members: DataFrame, profiles: DataFrame, found: DataFrame) -> DataFrame:
    """(p0, p1, u0, u1, e1, regions): pairs of blocks of users, p0 <= p1, that share ``min_support`` regions or more.

    ``members`` and ``profiles`` are from ``user_profiles``, ``found`` from ``profile_supports``. u0 and u1 are the users of
    the blocks p0 and p1, e1 tells whether p1 is p0 again. Only blocks of two users or more meet themselves.
    """
    nodes = cut(
        member_blocks(members)
        .join(profiles.select("profile", "regions"), "profile")
        .select("profile", F.struct("profile", "block").alias("p"), F.col("uids").alias("u"), "regions")
    )
    side = lambda c, k, r: nodes.select(F.col("profile").alias(c), F.col("p").alias(f"p{k}"), F.col("u").alias(f"u{k}"), F.col("regions").alias(r))
    across = (
        found.select("a", "b")
        .join(side("a", 0, "ra"), "a")
        .join(side("b", 1, "rb"), "b")
        .select("p0", "p1", "u0", "u1", F.lit(False).alias("e1"), F.array_intersect("ra", "rb").alias("regions"))
    )
    within = (
        side("a", 0, "regions")
        .join(side("a", 1, "rb").drop("rb"), "a")
        .filter("p0 < p1 OR p0 = p1 AND size(u0) > 1")
        .select("p0", "p1", "u0", "u1", (F.col("p0") == F.col("p1")).alias("e1"), "regions")
    )
    return across.unionByName(within)


def grown_blocks(sets: DataFrame, length: int, min_support: int, block: int = PAIR_BLOCK) -> DataFrame:
    """Sets of ``length`` blocks, p0 <= p1 <= …, with ``min_support`` common regions, from ``sets`` of one block less.

    ``sets`` is read more than once. Sets that agree in all but their last block meet, by as many tasks as the sets of
    users to list from them ask for: these are to be listed where their blocks have met.
    """
    tip = length - 2
    stem = [f"p{k}" for k in range(tip)]
    carried = [f"u{k}" for k in range(tip)] + [f"e{k}" for k in range(1, tip + 1)]
    width = F.lit(1.0)
    for k in range(tip):
        width = width * F.size(f"u{k}")
    groups = sets.groupBy(*stem).agg(
        F.max(width).alias("width"), F.sum(F.size(f"u{tip}")).cast("double").alias("users"), F.count(F.lit(1)).cast("double").alias("n")
    )
    counted = groups.agg(F.sum(F.col("width") * F.col("users") * F.col("users")), F.sum(F.col("n") * F.col("n"))).first()
    of_users, of_blocks = (counted[0] or 0) / 2, (counted[1] or 0) / 2
    tasks = min(int(of_users / TASK_PAIRS) + 1, MOST_TASKS)
    # Few tips at a time where many users stand behind them.
    few = int((TASK_PAIRS * of_blocks / of_users) ** 0.5) if of_users else block
    met = blocked_pairs(sets, stem, f"p{tip}", max(1, min(few, block)), tasks)
    across = met.select(
        *stem, F.col(f"a_p{tip}").alias(f"p{tip}"), F.col(f"b_p{tip}").alias(f"p{tip + 1}"),
        *[F.col(f"a_{c}").alias(c) for c in carried],
        F.col(f"a_u{tip}").alias(f"u{tip}"), F.col(f"b_u{tip}").alias(f"u{tip + 1}"), F.lit(False).alias(f"e{tip + 1}"),
        F.array_intersect("a_regions", "b_regions").alias("regions"),
    ).filter(F.size("regions") >= min_support)
    again = sets.filter(F.size(f"u{tip}") > 1).withColumns(
        {f"p{tip + 1}": F.col(f"p{tip}"), f"u{tip + 1}": F.col(f"u{tip}"), f"e{tip + 1}": F.lit(True)}
    )
    users = F.lit(1.0)
    for k in range(length):
        users = users * F.size(f"u{k}")
    n_again = again.agg(F.sum(users)).first()[0] or 0
    return across.unionByName(again.repartition(min(int(n_again / TASK_PAIRS) + 1, MOST_TASKS)))


def listed_sets(sets: DataFrame, length: int) -> DataFrame:
    """items (sorted), freq of the sets of users from sets of ``length`` blocks."""
    listed = sets.select(
        F.size("regions").cast("bigint").alias("freq"), *[f"u{k}" for k in range(length)], *[f"e{k}" for k in range(1, length)]
    )
    for k in range(length):
        kept = [c for c in listed.columns if c != f"u{k}"]
        listed = listed.select(*kept, F.explode(f"u{k}").alias(f"v{k}"))
        if k:
            # Only a block that comes again would give a set more than once.
            listed = listed.filter(f"NOT e{k} OR v{k - 1} < v{k}")
    return listed.select(F.sort_array(F.array(*[f"v{k}" for k in range(length)])).alias("items"), "freq")


def similar_links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, other_uid): so many pairs of similar users that all similar users are connected, ``pairs`` from ``profile_pairs``.

    Every user of a profile is linked with the one it is named by, and these with each other where their profiles are paired.
    """
    inside = members.filter("uid != profile").select(F.col("profile").alias("uid"), F.col("uid").alias("other_uid"))
    return inside.unionByName(pairs.filter("a < b").select(F.col("a").alias("uid"), F.col("b").alias("other_uid")))


def users_reached(members: DataFrame, pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """(uid, reached, hops): what ``reached`` gives over the pairs of similar users, ``starts`` having a column uid.

    Profiles are reached over ``pairs`` from ``profile_pairs``; all users of a profile are as far, those of the start's own
    one step away.
    """
    begin = cut(starts.select("uid").distinct().join(members.select("uid", "profile"), "uid"))
    steps = reached(pairs, begin.select("profile").distinct(), src="a", dst="b")
    itself = begin.select(F.col("profile").alias("start"), F.col("profile").alias("node"), F.lit(1).alias("hops")).distinct()
    ends = members.select(F.col("uid").alias("reached"), F.col("profile").alias("node"))
    return (
        begin.withColumnRenamed("profile", "start")
        .join(steps.unionByName(itself), "start")
        .join(ends, "node")
        .filter("uid != reached")
        .select("uid", "reached", "hops")
    )


def _text_ranges(members: DataFrame) -> DataFrame:
    """(profile, r, l, uids): users in text order in ranges of ``RANGE_USERS``, a profile's in each under a number l."""
    placed = number_all(members.select("profile", "uid"), ["uid"], "place")
    found = placed.groupBy("profile", F.floor((F.col("place") - 1) / RANGE_USERS).alias("r")).agg(
        F.sort_array(F.collect_list("uid")).alias("uids")
    )
    return found.withColumn("l", F.row_number().over(W.partitionBy("r").orderBy("profile")))


def similar_lines(members: DataFrame, pairs: DataFrame, line_items: int = LINE_ITEMS) -> DataFrame:
    """uid, part, line, place: what ``itemsets.similar_user_lines`` gives, without listing pairs of users.

    Users of a profile have one list, that of all users who are similar to them or of them, in text order; a user's line
    is that list without the user. Ranges of all users in text order meet groups of profiles, and each pair of profiles finds
    its users there by number, so users don't travel once for each pair. The list is cut into pieces of ``line_items`` users and the
    first one of the next piece, which takes the place of the one left out; pieces go once to each block of the profile's users.
    """
    size = int(line_items)
    profiles = cut(members.select(F.col("profile").alias("a"), "n_users").distinct())
    itself = profiles.select("a", F.col("a").alias("b"))
    ranges = cut(_text_ranges(members))
    n_groups = min(profiles.count() // GROUP_PROFILES + 1, MOST_GROUPS)
    g = F.pmod(F.xxhash64("a"), F.lit(n_groups)).cast("int").alias("g")
    side = ranges.select(F.col("profile").alias("b"), "r", "l", F.size("uids").cast("bigint").alias("n"))
    links = pairs.select("a", "b").unionByName(itself).join(side, "b").groupBy(g, "r", "a").agg(
        F.collect_list("l").alias("ls"), F.sum("n").alias("n")
    )
    before = W.partitionBy("a").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    placed = cut(
        links.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))).join(
            profiles.select("a", F.ceil(F.col("n_users") / MEMBER_BLOCK).cast("int").alias("n_blocks")), "a"
        )
    )
    n_names = placed.agg(F.sum("n")).first()[0] or 0
    tasks = int(min(n_names // TASK_PAIRS + 1, MOST_TASKS))
    lists = ranges.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("l", "uids"))).alias("us")).select("r", F.col("us.uids").alias("us"))
    cells = placed.select("g", "r").distinct().join(lists, "r").repartition(tasks, "g", "r")
    of_range = F.sort_array(F.flatten(F.transform("ls", lambda k: F.element_at("us", k))))
    named = placed.repartition(tasks, "g", "r").join(cells, ["g", "r"]).withColumn("names", of_range)
    # Places begin to last go to the parts whose items or first one of the next part they have.
    last = F.col("begin") + F.col("n") - 1
    parts = F.sequence(F.greatest(F.expr(f"(begin + {size - 1}) DIV {size} - 1"), F.lit(0)), F.floor(last / size))
    cut_from = F.greatest(F.col("begin"), F.col("part") * size)
    cut_to = F.least(last, (F.col("part") + 1) * size)
    pieces = (
        named.select("r", F.col("a").alias("profile"), "begin", "n", "n_blocks", "names", F.explode(parts).alias("part"))
        .withColumn("some", F.slice("names", (cut_from - F.col("begin") + 1).cast("int"), (cut_to - cut_from + 1).cast("int")))
        .select("r", "profile", F.col("part").cast("int").alias("part"), "some", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    )
    blocks = cut(member_blocks(members).select("profile", "block", "uids"))
    n_tasks = max(1, min(blocks.count(), MOST_TASKS))
    whole = (
        pieces.repartition(n_tasks, "profile", "block")
        .groupBy("profile", "block", "part")
        .agg(F.sort_array(F.collect_list(F.struct("r", "some"))).alias("pieces"))
        .select("profile", "block", "part", F.flatten("pieces.some").alias("items"))
    )
    met = blocks.repartition(n_tasks, "profile", "block").join(whole, ["profile", "block"])
    items = F.col("items")
    rest = (
        F.when(F.col("uid") < F.element_at(items, 1), F.slice(items, 2, size))
        .when(F.col("uid") > F.element_at(items, -1), F.slice(items, 1, size))
        .otherwise(F.array_remove(items, F.col("uid")))
    )
    full = (F.col("part") > 0) | (F.size("rest") == size)
    return (
        met.select(F.explode("uids").alias("uid"), "part", "items")
        .select("uid", "part", rest.alias("rest"))
        .filter(F.size("rest") > 0)
        .select(
            "uid", "part", F.array_join("rest", FIELD_SEP).alias("line"),
            F.when(full, F.col("part").cast("bigint") * size).alias("place"),
        )
    )


def users_with_similar(members: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """uid of every user with a similar one: of a paired profile, or not alone in theirs."""
    paired = pairs.select(F.col("a").alias("profile")).distinct()
    shared = profiles.filter("n_users > 1").select("profile")
    return members.join(paired.unionByName(shared).distinct(), "profile", "left_semi").select("uid")
