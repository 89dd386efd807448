import itertools
import random
from collections import defaultdict

import pytest

from dwellgrid.operators import maximal_sets, shared_groups
from dwellgrid.operators.maximal_sets import frequent_maximal_sets


def brute(pairs, least):
    """Every largest set is the users of some ``least`` regions."""
    users = defaultdict(set)
    for region, uid in pairs:
        if region is not None and uid is not None:
            users[region].add(uid)
    shared = {
        frozenset(set.intersection(*(users[r] for r in regions)))
        for regions in itertools.combinations(sorted(users), least)
    } - {frozenset()}
    return {(s, sum(s <= u for u in users.values())) for s in shared if not any(s < o for o in shared)}


@pytest.mark.parametrize("seed, least, class_items", [(1, 3, 2000), (2, 2, 2000), (3, 3, 2), (4, 1, 3), (5, 3, 0)])
def test_maximal_sets(spark, seed, least, class_items):
    rng = random.Random(seed)
    pairs = []
    for u in range(26):
        k = rng.choice([0, 2, 3, 5, 9])
        pairs += [(r, f"{u:02d}") for r in rng.sample(range(10), k)]
    # Two users with equal regions, one with all regions, one alone, repeated and missing values.
    pairs += [(r, u) for r in (1, 4, 7) for u in ("x1", "x2")] + [(r, "all") for r in range(10)]
    pairs += [(r, "alone") for r in (90, 91, 92)] + pairs[:4] + [(None, "x1"), (1, None)]
    df = spark.createDataFrame(pairs, "cluster_id int, uid string").repartition(3)
    rows = frequent_maximal_sets(df, least, class_items=class_items, block=4).collect()
    sets = defaultdict(set)
    for r in rows:
        sets[r.set_id, r.support].add(r.uid)
    assert len(rows) == sum(map(len, sets.values()))
    assert {(frozenset(v), k[1]) for k, v in sets.items()} == brute(pairs, least)
    assert len(sets) == len({k[0] for k in sets})


def test_many_regions(spark):
    """More regions than a word of a bitmap has bits."""
    pairs = [(r, u) for r in range(200) for u in ("a", "b") if (u == "a" or r % 2)] + [(r, "c") for r in range(130, 200)]
    rows = frequent_maximal_sets(spark.createDataFrame(pairs, "cluster_id int, uid string"), 35).collect()
    assert sorted((r.uid, r.support) for r in rows) == [("a", 35), ("b", 35), ("c", 35)]


def test_no_pairs(spark):
    assert frequent_maximal_sets(spark.createDataFrame([], "cluster_id int, uid string")).collect() == []


@pytest.mark.parametrize("class_items", [2000, 20, 1])
def test_profiles_are_not_paired(spark, monkeypatch, class_items):
    """Many users with region sets of their own, alike in the popular ones: what is searched are rows of a profile and a prefix."""
    rng = random.Random(7)
    pairs = []
    for u in range(400):
        mine = rng.sample(range(4), rng.choice([3, 4])) + rng.sample(range(10, 18), rng.choice([0, 2, 3]))
        pairs += [(r, f"{u:03d}") for r in mine]
    monkeypatch.setattr(shared_groups, "blocked_pairs", None)
    stored = []
    real = maximal_sets.cut
    monkeypatch.setattr(maximal_sets, "cut", lambda df: stored.append((kept := real(df)).count()) or kept)
    df = spark.createDataFrame(pairs, "cluster_id int, uid string").repartition(3)
    sets = defaultdict(set)
    for r in frequent_maximal_sets(df, 3, class_items=class_items).collect():
        sets[r.set_id, r.support].add(r.uid)
    want = brute(pairs, 3)
    assert {(frozenset(v), k[1]) for k, v in sets.items()} == want and len(sets) == len(want)
    # A profile has at most 35 prefixes of three of its up to seven regions.
    assert len(stored) > 2 and max(stored) <= 35 * 400
