import random
from collections import defaultdict
from itertools import combinations

import brute
from dwellgrid.operators import itemsets, recommend, regions, visits
from dwellgrid.operators.numbering import number_in_groups, with_previous
from dwellgrid.functions.text import joined_lines
from pyspark.sql import functions as F


def relation(rng, users=40, n_regions=18):
    """(region, uid) rows in which regions 1 and 2 are known to nearly everybody."""
    rows = set()
    for u in range(users):
        for region in range(1, n_regions + 1):
            if rng.random() < (0.95 if region <= 2 else 0.25):
                rows.add((region, f"{u:03d}"))
    return sorted(rows)


def test_pairs_and_triples_against_brute_force(spark):
    rows = relation(random.Random(3))
    df = spark.createDataFrame(rows, "cluster_id int, uid string").repartition(4)
    for support in (1, 3):
        got = {(r.uid, r.other_uid): r.support for r in itemsets.frequent_pairs(df, support, block=7).collect()}
        assert got == brute.pairs(rows, support)
    by_user = defaultdict(set)
    for region, uid in rows:
        by_user[uid].add(region)
    want = {}
    for trio in combinations(sorted(by_user), 3):
        shared = len(set.intersection(*(by_user[u] for u in trio)))
        if shared >= 5:
            want[trio] = shared
    sets = itemsets.frequent_itemsets(df, 5, max_len=3, block=7).collect()
    assert {tuple(r["items"]): r.freq for r in sets if len(r["items"]) == 3} == want
    assert {tuple(r["items"]): r.freq for r in sets if len(r["items"]) == 2} == brute.pairs(rows, 5)


def test_support_at_exactly_187_regions(spark):
    rows = [(r, u) for r in range(187) for u in ("a", "b") if r < 3 or (r % 2 == (u == "a"))]
    df = spark.createDataFrame(rows, "cluster_id int, uid string")
    assert [tuple(r) for r in itemsets.frequent_pairs(df, 3).collect()] == [("a", "b", 3)]


def test_recommendation_rounds(spark):
    rng = random.Random(11)
    ranked = {}
    for u in range(30):
        chosen = rng.sample(range(1, 14), rng.randint(1, 9))
        counts = sorted((rng.randint(1, 4) for _ in chosen), reverse=True)
        ranked[f"{u:03d}"] = sorted(zip(chosen, counts), key=lambda rv: (-rv[1], rv[0]))
    similar = {u: rng.sample([v for v in ranked if v != u], rng.randint(1, 6)) for u in list(ranked)[:25]}
    # Round 0 offers nothing new although round 1 would.
    ranked |= {"900": [(1, 1), (2, 1)], "901": [(1, 3), (9, 2)]}
    similar["900"] = ["901"]
    ur = spark.createDataFrame(
        [(u, r, v, k + 1) for u, rs in ranked.items() for k, (r, v) in enumerate(rs)],
        "uid string, cluster_id int, visits long, rank int",
    )
    sim = spark.createDataFrame(
        [(u, o, 3) for u, os in similar.items() for o in os], "uid string, other_uid string, support long"
    )
    for mode, same in (("region", False), ("region_and_count", True)):
        for top_n in (2, 6):
            want = brute.recommend(similar, ranked, top_n, same)
            df = recommend.recommend_regions(sim, ur, top_n, mode)
            got = defaultdict(dict)
            for r in df.collect():
                got[r.uid][r.position] = r.cluster_id
            assert {u: list(want[u]) for u in want if want[u]} == {
                u: [p[k] for k in sorted(p)] for u, p in got.items()
            }
    assert want["900"] != []  # counts differ, so compat mode offers region 1 again
    lines = {r.uid: r.line for r in recommend.recommendation_lines(sim, recommend.recommend_regions(sim, ur)).collect()}
    assert lines["900"] == "NO RECOMMENDATION"
    assert set(lines) == set(similar)


def test_natural_order_of_recommended_text(spark):
    sim = spark.createDataFrame([("a", "b")], "uid string, other_uid string")
    picked = spark.createDataFrame([("a", 1, 10), ("a", 2, 9), ("a", 3, 2)], "uid string, position int, cluster_id int")
    assert recommend.recommendation_lines(sim, picked).first().line == "2,9,10"


def test_runs_and_noise(spark):
    runs = {"AA": [5, 5], "A0A": [5, 0, 5], "00": [0, 0], "mix": [1, 1, 0, 0, 2, 2, 1]}
    rows = [("u", t, i, c) for t, cs in runs.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "uid string, traj_id string, stay_seq int, cluster_id int")
    want = {"AA": [5], "A0A": [5, 0, 5], "00": [0], "mix": [1, 0, 2, 1]}
    for limit in (1000, 2):
        got = defaultdict(dict)
        for r in visits.collapse_runs(df, limit).collect():
            got[r.traj_id][r.visit_seq] = r.cluster_id
        assert {t: [v[i] for i in range(len(v))] for t, v in got.items()} == want
    counted = regions.visit_counts(visits.collapse_runs(df)).collect()
    assert {r.cluster_id: r.visits for r in counted} == {5: 3, 1: 2, 2: 1}


def test_numbering_of_a_group_over_the_limit(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}", v) for v in rng.sample(range(10000), 600)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    want = defaultdict(list)
    for k, v in sorted(rows):
        want[k].append(v)
    numbered = number_in_groups(df, ["k"], ["v"], "nth", limit=50)
    got = {(r.k, r.nth): r.v for r in numbered.collect()}
    assert got == {(k, i + 1): v for k, vs in want.items() for i, v in enumerate(vs)}
    zero = numbered.withColumn("i", F.col("nth") - 1)
    prev = {(r.k, r.v): r.prev_v for r in with_previous(zero, ["k"], "i", ["v"], limit=50).collect()}
    assert prev == {(k, v): (vs[i - 1] if i else None) for k, vs in want.items() for i, v in enumerate(vs)}
    lines = joined_lines(zero, ["k"], "i", F.col("v"), ",", line_items=100).collect()
    joined = defaultdict(list)
    for r in sorted(lines, key=lambda r: (r.k, r.part)):
        assert r.line.count(",") < 100
        joined[r.k] += [int(v) for v in r.line.split(",")]
    assert joined == want


def test_equal_transactions(spark):
    rows = [(1, "9"), (1, "10"), (2, "10"), (2, "9"), (3, "9"), (4, "10"), (4, "9"), (4, "2")]
    df = spark.createDataFrame(rows, "cluster_id int, uid string")
    got = {(r.part, r.users, r.freq) for r in regions.transaction_counts(df).collect()}
    assert got == {(0, "9,10", 2), (0, "9", 1), (0, "2,9,10", 1)}
    cut_up = {(r.part, r.users, r.freq) for r in regions.transaction_counts(df, line_items=2).collect()}
    assert cut_up == {(0, "9,10", 2), (0, "9", 1), (0, "2,9", 1), (1, "10", 1)}
