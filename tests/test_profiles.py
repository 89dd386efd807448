import random
from collections import defaultdict

import pytest

import brute
from dwellgrid.operators import itemsets, recommend
from dwellgrid.operators.profiles import profile_pairs, user_profiles, users_with_similar


def ranked_users(seed):
    """Users of few different region sets, with visits of their own."""
    rng = random.Random(seed)
    sets = [rng.sample(range(1, 15), k) for k in (2, 3, 3, 4, 5, 6, 9)]
    ranked = {}
    for u in range(40):
        regions = rng.choice(sets)
        ranked[f"{u:02d}"] = sorted(((r, rng.randint(1, 4)) for r in regions), key=lambda rv: (-rv[1], rv[0]))
    # One profile of a single user that is similar to nobody, one of two users similar to each other only.
    ranked["lone"] = [(50, 3), (51, 2), (52, 1)]
    ranked |= {"p1": [(60, 3), (61, 2), (62, 1)], "p2": [(61, 3), (60, 2), (62, 1)]}
    return ranked


@pytest.mark.parametrize("seed, least", [(1, 3), (2, 2)])
def test_recommendations_equal_those_by_similar_users(spark, seed, least):
    ranked = ranked_users(seed)
    rows = [(u, r, v, k + 1) for u, rs in ranked.items() for k, (r, v) in enumerate(rs)]
    ur = spark.createDataFrame(rows, "uid string, cluster_id int, visits long, rank int").repartition(3)
    pairs = ur.select("cluster_id", "uid")
    members, found = user_profiles(pairs, least)
    by_profile = profile_pairs(found, least, block=3)
    sim = itemsets.similar_users(itemsets.frequent_pairs(pairs, least))
    similar = defaultdict(list)
    for r in sim.collect():
        similar[r.uid].append(r.other_uid)
    assert sorted(r.uid for r in users_with_similar(members, found, by_profile).collect()) == sorted(similar)
    assert "lone" not in similar and similar["p1"] == ["p2"]
    for mode, same in (("region", False), ("region_and_count", True)):
        for top_n in (1, 4):
            got = recommend.recommend_by_profile(ur, members, found, by_profile, top_n, mode)
            rows = sorted(tuple(r) for r in got.collect())
            assert rows == sorted(tuple(r) for r in recommend.recommend_regions(sim, ur, top_n, mode).collect())
            want = brute.recommend(similar, ranked, top_n, same)
            assert rows == sorted((u, i + 1, r) for u, rs in want.items() for i, r in enumerate(rs))


def test_no_users(spark):
    none = spark.createDataFrame([], "uid string, cluster_id int, visits long, rank int")
    members, found = user_profiles(none.select("cluster_id", "uid"), 3)
    pairs = profile_pairs(found, 3)
    assert users_with_similar(members, found, pairs).collect() == []
    assert recommend.recommend_by_profile(none, members, found, pairs).collect() == []
