import random
from itertools import combinations

import pytest

import brute
from dwellgrid.operators import itemsets, profiles, shared_groups
from dwellgrid.operators.components import connected_components
from dwellgrid.operators.maximal_sets import frequent_maximal_sets
from dwellgrid.operators.reach import reached
from dwellgrid.plans.pipeline import TrajectoryPipeline


def crowds(seed=5, users=120):
    """(region, uid) of users with few different region sets, some sets of one user."""
    rng = random.Random(seed)
    sets = [rng.sample(range(12), k) for k in (2, 3, 4, 5, 5, 7)]
    rows = [(r, f"{u:03d}") for u in range(users) for r in rng.choice(sets)]
    return rows + [(r, "one") for r in (0, 1, 2, 3)] + [(r, "lone") for r in (90, 91, 92)] + [(None, "000"), (1, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "cluster_id int, uid string").repartition(3)


@pytest.mark.parametrize("block, tasks", [(500, 2_000_000), (4, 50)])
def test_only_profiles_are_paired(spark, monkeypatch, block, tasks):
    """Users with equal regions meet in the result alone; small blocks and tasks give the same pairs."""
    paired = []
    real = shared_groups.blocked_pairs
    monkeypatch.setattr(shared_groups, "blocked_pairs", lambda rows, *a: paired.append(rows.count()) or real(rows, *a))
    monkeypatch.setattr(profiles, "MEMBER_BLOCK", block)
    monkeypatch.setattr(profiles, "TASK_PAIRS", tasks)
    rows = crowds()
    got = itemsets.frequent_pairs(frame(spark, rows), 3).collect()
    want = brute.pairs([x for x in rows if None not in x], 3)
    assert len(got) == len(want) and {(r.uid, r.other_uid): r.support for r in got} == want
    assert max(paired) <= 8 * 7


def test_similar_users_are_not_stored(spark, monkeypatch):
    """The list of similar users is as large as their pairs: without an output folder no stage keeps it."""
    rows = crowds()
    run = TrajectoryPipeline(None)
    run.__dict__["region_user"] = frame(spark, rows)
    stored = []
    monkeypatch.setattr("dwellgrid.plans.pipeline.cut", lambda df: stored.append(df.columns) or df)
    want = brute.pairs([x for x in rows if None not in x], 3)
    got = run.similar.collect()
    assert {(r.uid, r.other_uid): r.support for r in got} == want | {(b, a): n for (a, b), n in want.items()}
    assert not stored


@pytest.mark.parametrize("users, group", [(125, 1000), (3, 10), (1, 1)])
def test_groups_of_users_meet(spark, monkeypatch, users, group):
    """A user goes to a pair of groups once, however many profiles are paired with theirs."""
    monkeypatch.setattr(profiles, "LIST_USERS", users)
    monkeypatch.setattr(profiles, "GROUP_USERS", group)
    rows = crowds()
    members, found = profiles.user_profiles(frame(spark, rows), 3)
    units = profiles.member_groups(members).collect()
    assert max(r.g for r in units) < 100
    assert sorted(u for r in units for u in r.uids) == sorted(r.uid for r in members.collect())
    assert all(sorted(r.k for r in units if r.g == g) == list(range(1, 1 + sum(r.g == g for r in units))) for g in {r.g for r in units})
    got = itemsets.similar_users(itemsets.frequent_pairs(frame(spark, rows), 3)).collect()
    want = brute.pairs([x for x in rows if None not in x], 3)
    assert len(got) == 2 * len(want)
    assert {(r.uid, r.other_uid): r.support for r in got} == want | {(b, a): n for (a, b), n in want.items()}


def test_files_of_similar_users_are_small(spark, tmp_path):
    """Rows that share a user follow each other, so that a file holds them in little room."""
    rows = [(r, f"{u:05d}") for u in range(900) for r in range(3 + u % 3)]
    similar = itemsets.similar_users(itemsets.frequent_pairs(frame(spark, rows), 3))
    similar.write.parquet(str(tmp_path / "similar"))
    files = list((tmp_path / "similar").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "similar")).count() == 900 * 899
    assert sum(f.stat().st_size for f in files) < 900 * 899


def profiled(spark, rows, least=3):
    members, found = profiles.user_profiles(frame(spark, rows), least)
    return members, profiles.profile_pairs(found, least)


def test_links_connect_whom_similar_users_connect(spark):
    rows = crowds() + [(r, u) for r in (60, 61, 62) for u in ("p1", "p2")]
    sim = itemsets.similar_users(itemsets.frequent_pairs(frame(spark, rows), 3))
    links = profiles.similar_links(*profiled(spark, rows))
    got = connected_components(links, "uid", "other_uid").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, connected_components(sim, "uid", "other_uid").collect()))
    assert links.count() < 130 + 8 * 7 / 2


def test_users_are_reached_by_their_profiles(spark):
    # A chain of region sets, each similar to the next, several users with each.
    rows = crowds() + [(r, f"c{k}{i}") for k in range(5) for r in range(200 + k, 204 + k) for i in "xyz"[: 1 + k % 3]]
    starts = spark.createDataFrame([(u,) for u in ("000", "001", "c0x", "c1y", "c1y", "lone", "nobody", None)], "uid string")
    sim = itemsets.similar_users(itemsets.frequent_pairs(frame(spark, rows), 3))
    want = {tuple(r) for r in reached(sim, starts, src="uid", dst="other_uid").collect()}
    got = profiles.users_reached(*profiled(spark, rows), starts).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert max(h for _, _, h in want) == 4


@pytest.mark.parametrize("line_items", [1000, 10, 1])
def test_lines_of_similar_users(spark, line_items):
    """A user's line is the list of the profile without the user, in parts too."""
    rows = crowds(users=30)
    sim = itemsets.similar_users(itemsets.frequent_pairs(frame(spark, rows), 3)).collect()
    want = set()
    for uid in {r.uid for r in sim}:
        others = sorted(r.other_uid for r in sim if r.uid == uid)
        for k in range(0, len(others), line_items):
            mine = others[k : k + line_items]
            place = k if k or len(mine) == line_items else None
            want.add((uid, k // line_items, ",".join(mine), place))
    got = profiles.similar_lines(*profiled(spark, rows), line_items).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("line_items, names", [(1000, 7), (10, 3), (1, 5), (4, 4)])
def test_lines_from_ranges_of_users(spark, monkeypatch, line_items, names):
    """Ranges of users meet groups of profiles; no row of a user for each paired profile, and none is numbered."""
    whole = sorted(map(tuple, profiles.similar_lines(*profiled(spark, crowds(users=30)), line_items).collect()))
    monkeypatch.setattr(profiles, "RANGE_USERS", names)
    monkeypatch.setattr(profiles, "GROUP_PROFILES", 2)
    monkeypatch.setattr(profiles, "MEMBER_BLOCK", 4)
    monkeypatch.setattr(profiles, "TASK_PAIRS", 20)
    stored = []
    real = profiles.cut
    monkeypatch.setattr(profiles, "cut", lambda df: stored.append(real(df)) or stored[-1])
    got = profiles.similar_lines(*profiled(spark, crowds(users=30)), line_items).collect()
    assert sorted(map(tuple, got)) == whole
    ranges = next(df for df in stored if df.columns == ["profile", "r", "uids", "l"]).collect()
    assert len({r.r for r in ranges}) > 2 and max(len(r.uids) for r in ranges) <= names
    assert all("uid" not in df.columns for df in stored[2:])


def test_pairs_are_joined_by_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    """Rows are few beside their pairs: a shuffle that goes by bytes would leave all pairs to one task."""
    monkeypatch.setattr(shared_groups, "TASK_PAIRS", 100)
    rows = spark.createDataFrame([(r, f"{u:03d}") for u in range(40) for r in range(3)], "cluster_id int, uid string")
    met = shared_groups.blocked_pairs(rows, ["cluster_id"], "uid", 5)
    assert met.rdd.getNumPartitions() == 25 and met.count() == 3 * 40 * 39 / 2


def test_large_sets_are_given_in_blocks(spark):
    """A set's users travel many to a row."""
    pairs = frame(spark, crowds())
    blocks = frequent_maximal_sets(pairs, 3, in_blocks=True).collect()
    listed = sorted(tuple(r) for r in frequent_maximal_sets(pairs, 3).collect())
    assert sorted((r.set_id, u, r.support) for r in blocks for u in r.uids) == listed
    assert len(blocks) < len(listed) / 5


@pytest.mark.parametrize("block, sets", [(500, 2_000_000), (3, 50)])
def test_only_blocks_of_users_are_joined_to_sets(spark, monkeypatch, block, sets):
    """Sets of users are listed from sets of blocks: what meets are rows of profiles, however many users have them."""
    met = []
    real = profiles.blocked_pairs
    monkeypatch.setattr(profiles, "blocked_pairs", lambda rows, *a: met.append(rows.count()) or real(rows, *a))
    monkeypatch.setattr(profiles, "MEMBER_BLOCK", block)
    monkeypatch.setattr(profiles, "TASK_PAIRS", sets)
    rows = crowds(users=40)
    regions = {}
    for r, u in rows:
        if r is not None and u is not None:
            regions.setdefault(u, set()).add(r)
    want = {}
    for size in (3, 4):
        for some in combinations(sorted(u for u in regions if len(regions[u]) > 2), size):
            common = len(set.intersection(*(regions[u] for u in some)))
            if common >= 3:
                want[some] = common
    got = [r for r in itemsets.frequent_itemsets(frame(spark, rows), 3, max_len=4).collect() if len(r["items"]) > 2]
    assert len(got) == len(want) and {tuple(r["items"]): r.freq for r in got} == want
    assert len(met) == 2 and (block < 500 or max(met) <= 8 * 8 * 8)
