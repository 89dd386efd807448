import random

import pytest

from dwellgrid.operators import itemsets, recommend
from dwellgrid.operators.profiles import profile_pairs, user_profiles


def visited(spark, users=60, sets=6, seed=8):
    """Many users of few region sets, with counts of their own."""
    rng = random.Random(seed)
    chosen = [rng.sample(range(1, 13), k) for k in (3, 4, 4, 5, 6, 8)[:sets]]
    rows = []
    for u in range(users):
        mine = sorted(((r, rng.randint(1, 30)) for r in rng.choice(chosen)), key=lambda rv: (-rv[1], rv[0]))
        rows += [(f"{u:03d}", r, v, k + 1) for k, (r, v) in enumerate(mine)]
    ranked = spark.createDataFrame(rows, "uid string, cluster_id int, visits long, rank int").repartition(3)
    pairs = ranked.select("cluster_id", "uid")
    members, found = user_profiles(pairs, 3)
    return ranked, members, found, profile_pairs(found, 3)


@pytest.mark.parametrize("mode", ["region", "region_and_count"])
def test_earliest_offers_are_not_sorted(spark, mode):
    """Offers are many more than the earliest ones: sorting them before they are aggregated takes a task's memory."""
    got = recommend.recommend_by_profile(*visited(spark), 6, mode)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tasks, top_n", [(500_000, 6), (3, 2)])
def test_users_meet_only_offers_they_may_pick(spark, monkeypatch, tasks, top_n):
    """Counts tell users apart; a profile hands a bounded number of offers to its users, whatever the counts."""
    monkeypatch.setattr(recommend, "TASK_PAIRS", tasks)
    handed, real = [], recommend._pickable
    monkeypatch.setattr(recommend, "_pickable", lambda fresh, own, n: handed.append(real(fresh, own, n)) or handed[0])
    ranked, members, found, pairs = visited(spark)
    got = recommend.recommend_by_profile(ranked, members, found, pairs, top_n, "region_and_count").collect()
    sim = itemsets.similar_users(itemsets.frequent_pairs(ranked.select("cluster_id", "uid"), 3))
    want = recommend.recommend_regions(sim, ranked, top_n, "region_and_count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    assert max(r["count"] for r in handed[0].groupBy("a").count().collect()) <= top_n + 2 * 8
