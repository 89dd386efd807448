import datetime
import random

from dwellgrid.operators.presence import co_presence

SCHEMA = "cluster_id int, arrive timestamp_ntz, leave timestamp_ntz"
START = datetime.datetime(2024, 1, 1)


def at(minute):
    return None if minute is None else START + datetime.timedelta(minutes=minute)


def brute(rows, least):
    """Minute by minute."""
    out = []
    for cluster in {r[0] for r in rows} - {0, None}:
        own = [(a, b) for c, a, b in rows if c == cluster and None not in (a, b)]
        counts = [sum(a <= m < b for a, b in own) for m in range(0, 400)]
        begin = 0
        for m in range(1, 400):
            if counts[m] != counts[begin]:
                if counts[begin] >= least:
                    out.append((cluster, at(begin), at(m), counts[begin]))
                begin = m
    return sorted(out)


def test_co_presence(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(160):
        a = rng.randrange(1, 300)
        rows.append((rng.choices([0, 1, 2, 7, None], [1, 9, 2, 2, 1])[0], a, a + rng.choice([0, 1, 5, 40, 90])))
    # Repeated stays, one that begins when another ends, missing and swapped times.
    rows += rows[:5] + [(9, 10, 20), (9, 20, 30), (9, None, 5), (9, 5, None), (9, 50, 40)]
    df = spark.createDataFrame([(c, at(a), at(b)) for c, a, b in rows], SCHEMA).repartition(4)
    for least in (1, 2, 5):
        got = sorted(tuple(r) for r in co_presence(df, least).collect())
        assert got == brute([r for r in rows if None in r or r[1] < r[2]], least)
    assert co_presence(df.limit(0)).collect() == []
