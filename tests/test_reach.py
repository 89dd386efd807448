import random
from collections import deque

import pytest

from dwellgrid.operators.reach import reached


def walk(edges, start):
    found, todo = {start: 0}, deque([start])
    while todo:
        node = todo.popleft()
        for a, b in edges:
            if a == node and b is not None and b not in found:
                found[b] = found[node] + 1
                todo.append(b)
    return {(start, n, h) for n, h in found.items() if n != start}


@pytest.mark.parametrize("seed", [1, 2])
def test_reached(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(3, 3), (None, 1), (1, None)]
    edges += edges[:5] + [(i, i + 1) for i in range(100, 112)]
    starts = [0, 1, 2, 3, 100, 77, 0, None]
    df = spark.createDataFrame(edges, "src long, dst long")
    from_ = spark.createDataFrame([(s,) for s in starts], "u long")
    want = set().union(*(walk(edges, s) for s in starts if s is not None))
    got = reached(df, from_).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r) for r in reached(df, from_, max_hops=2).collect()} == {w for w in want if w[2] <= 2}
    assert max(w[2] for w in want) >= 12


def test_nothing_reached(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    nobody = spark.createDataFrame([(5,)], "u long")
    for df in (reached(edges, nobody), reached(edges.limit(0), nobody), reached(edges, nobody.limit(0)), reached(edges, nobody, 0)):
        assert df.columns == ["start", "node", "hops"] and df.collect() == []
