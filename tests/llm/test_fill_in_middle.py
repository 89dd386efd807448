import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as driver
from conftest import DATA, duck, duck_result, spark_result
from frames import empty, odd_documents
from llm import fill_in_middle
from llm.fill_in_middle import UnitIndex

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
ALPHABET = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("azAZ@[`{\x00\x7f é中\U0001f642")))


def index_of(texts):
    encoded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
    return UnitIndex(np.frombuffer(b"".join(encoded), np.uint8), offsets)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ALPHABET, st.integers(0, 1 << 32)), min_size=1, max_size=5))
def test_rank_and_select(cases):
    texts = [t for t, _ in cases]
    units = [UNIT.findall(t) for t in texts]
    index = index_of(texts)
    assert index.n_units.tolist() == [len(u) for u in units]
    k = [d % (len(u) + 1) for (_, d), u in zip(cases, units)]
    prefixes = ["".join(u[:n]) for u, n in zip(units, k)]
    ends = index.end_of(np.array(k))
    assert ends.tolist() == [len(p.encode()) for p in prefixes]
    assert index.chars_up_to(ends).tolist() == [len(p) for p in prefixes]


def test_blocks_see_their_followers(monkeypatch):
    text = "ab" * 20 + "é" * 9 + "x-" + "a" * 33 + "\U0001f642"
    whole = index_of([text, text])
    monkeypatch.setattr(fill_in_middle, "_BLOCK", 1)
    cut = index_of([text, text])
    assert (whole.ends == cut.ends).all() and (whole.starts == cut.starts).all()


def example(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by lists of units."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or h[2] % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_examples(spark):
    docs = odd_documents(spark)
    marked = docs.limit(1).selectExpr(
        "id AS doc_id", "'a <S> b' AS text", "lang", "source", "n_chars", "key", "id", "line_no"
    )
    docs = docs.unionByName(marked)
    # Many ids for one text, so that all forms occur.
    docs = docs.unionByName(
        docs.sparkSession.range(1000, 1100).selectExpr(
            "id AS doc_id", "concat('< <P ', id, ' x>S> é', repeat('<', id % 7)) AS text", "'xx' AS lang",
            "'s' AS source", "0L AS n_chars", "'k' AS key", "id", "'1' AS line_no"
        )
    )
    want = Counter((r.doc_id, *example(r.doc_id, r.text)) for r in docs.collect())
    got = Counter(tuple(r) for r in fill_in_middle.examples(docs).collect())
    assert got == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    digests = Counter(
        (i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest())
        for (i, n, form, p, m, out), k in want.items()
        for _ in range(k)
    )
    found = fill_in_middle.example_digests(docs).collect()
    assert Counter(tuple(r)[:-1] for r in found) == digests
    texts = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.restored_sha256) for r in found) == texts
    assert fill_in_middle.examples(empty(spark)).collect() == []
    assert fill_in_middle.example_digests(empty(spark)).collect() == []


def test_a_very_long_text(spark):
    text = "lorem ipsum é" * 1_000_000
    docs = spark.range(1).selectExpr("7L AS doc_id", "repeat('lorem ipsum é', 1000000) AS text")
    (row,) = fill_in_middle.examples(docs).collect()
    assert tuple(row) == (7, *example(7, text))


def test_query_matches_sql(spark):
    got = spark_result(driver.queries()["op12_fill_in_middle"](spark, f"{DATA}/sf0.001"))
    assert got == duck_result(duck("0.001"), driver.oracle_sql()["op12_fill_in_middle"])
