import random
from collections import Counter

import pytest

from dwellgrid.operators.asof import as_of


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_as_of(spark, limit):
    rng = random.Random(limit)
    users = ["a", "b", "c", "dd", None]
    weights = [30, 3, 3, 1, 1]
    history = [
        (rng.choices(users, weights)[0], rng.choice([None, *range(200)]), rng.randrange(9), rng.choice("xyz"))
        for _ in range(300)
    ]
    probes = [
        (i, rng.choices([*users, "new"], [*weights, 2])[0], rng.choice([None, *range(-5, 210)]), rng.choice(["p", None]))
        for i in range(400)
    ]
    probes += probes[:3]
    got = as_of(
        spark.createDataFrame(probes, "id long, uid string, at long, note string").repartition(5),
        spark.createDataFrame(history, "uid string, at long, region int, mark string").repartition(3),
        ["uid"],
        "at",
        ["region", "mark"],
        limit,
    )
    assert got.columns == ["id", "uid", "at", "note", "region", "mark"]
    want = Counter()
    for i, uid, at, note in probes:
        before = [h for h in history if None not in (uid, at, h[1]) and h[0] == uid and h[1] <= at]
        best = max(before, key=lambda h: h[1:])[2:] if before else (None, None)
        want[(i, uid, at, note, *best)] += 1
    assert Counter(tuple(r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_history_no_probes(spark):
    none = spark.createDataFrame([], "uid string, at long, region int")
    probes = spark.createDataFrame([(1, "a", 5)], "id long, uid string, at long")
    assert [tuple(r) for r in as_of(probes, none, ["uid"], "at", ["region"]).collect()] == [(1, "a", 5, None)]
    assert as_of(probes.limit(0), none, ["uid"], "at", ["region"]).collect() == []
