import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as driver
from conftest import DATA, duck, duck_result, spark_result
from frames import empty, lower, odd_documents
from llm import source_audit
from llm.transducer import Transducer

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def spans(terms):
    ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
    return np.frombuffer(b"".join(terms), np.uint8), np.concatenate([[0], ends])[: len(terms)].astype(np.int64), ends


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abcé中", max_size=6), max_size=60), st.lists(st.text("abcdé中", max_size=7), max_size=20))
def test_ordinals(terms, others):
    sorted_terms = sorted(t.encode() for t in terms)
    made = Transducer.of(sorted_terms)
    made = Transducer.from_bytes(made.root, made.as_bytes())
    asked = sorted_terms + [o.encode() for o in others]
    place = {t: i for i, t in enumerate(sorted_terms)}
    assert made.ordinals(*spans(asked)).tolist() == [place.get(t, -1) for t in asked]
    # Minimal: as many states as there are different sets of endings (and a start for no terms at all).
    endings = {
        frozenset(t[len(p) :] for t in sorted_terms if t.startswith(p))
        for p in {t[:n] for t in sorted_terms for n in range(len(t) + 1)} | {b""}
    }
    assert len(made.base) == len(endings)


def test_terms_must_be_sorted():
    with pytest.raises(ValueError):
        Transducer.of([b"b", b"a"])


def brute(rows, least, top=50):
    docs = [(lang or "", source or "", [lower(t) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = Counter()
    groups = sorted({(lang, source) for lang, source, _ in docs}, key=lambda g: [x.encode() for x in g])
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, k in df[lang].items() if k >= least), key=str.encode)
        own = [g for g in groups if g[0] == lang]
        all_counts = sum((n[g] for g in own), Counter())

        def rates(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return [1 + 10**9 * (counts[t] + 5) // total for t in kept]

        q = rates(all_counts)
        p = {g: rates(n[g]) for g in own}
        for g in own:
            pairs = [(sum(abs(x - y) for x, y in zip(p[g], p[o])), o[1]) for o in own if o != g]
            terms = [(x - y, t) for x, y, t in zip(p[g], q, kept) if n[g][t] and x > y]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                for rank, (value, item) in enumerate(found[:most], 1):
                    out[(*g, part, item, value, rank)] += 1
    return out


def many(spark):
    """Sources in several tiles, one of them without terms, and a language below the threshold."""
    words = "Ähre ähre apple b zebra Zoo ζω 中文 émile dot".split()
    rows = []
    for i in range(60):
        text = " ".join(words[(i * k + k * k) % len(words)] for k in range(i % 13))
        rows.append((i, text, ("aa", "bb", None)[i % 3], f"s{i % 7}", i, "k", i, None))
    rows += [(61, "only once", "cc", "s1", 0, "k", 1, None), (62, "1 2 3", "aa", "none", 0, "k", 1, None)]
    rows += [(63, None, "cc", None, 0, "k", 1, None)]
    return spark.createDataFrame(rows, odd_documents(spark).schema)


@pytest.mark.parametrize("most_terms, tile, block", [(1000, 128, 2048), (0, 2, 3), (1000, 2, 3)])
def test_divergence(spark, most_terms, tile, block):
    for docs, least in ((many(spark), 4), (odd_documents(spark), 2), (odd_documents(spark), 99)):
        rows = [(r.lang, r.source, r.text) for r in docs.collect()]
        got = source_audit.divergence(docs, least, top=5, most_terms=most_terms, tile=tile, block=block)
        assert Counter(tuple(r) for r in got.collect()) == brute(rows, least, 5)


def test_no_rows(spark):
    assert source_audit.divergence(empty(spark)).collect() == []


def test_sums_of_a_task():
    sums = source_audit._Sums()
    sums.add([("a", "x"), ("a", "y")], np.array([0, 1, 0]), np.array([5, 5, 5]))
    sums.add([("a", "y")], np.array([0, 0]), np.array([5, 7]))
    rows = sums.batch().to_pylist()
    assert [tuple(r.values()) for r in rows] == [("a", "x", 6, 2), ("a", "y", 6, 2), ("a", "y", 8, 1)]
    assert len(sums) == 0 and sums.batch().num_rows == 0


def test_query_matches_sql(spark):
    got = spark_result(driver.queries()["op13_source_audit"](spark, f"{DATA}/sf0.01"))
    assert got == duck_result(duck("0.01"), driver.oracle_sql()["op13_source_audit"])
