import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as driver
from conftest import DATA, duck, duck_result, spark_result
from frames import empty, odd_documents, words
from llm import substring_dedup
from llm.substring_dedup import factored, repeated_spans, without_repeats


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept text) with every window looked up in a dictionary."""
    lists = [(doc_id, words(text)) for doc_id, text in rows]
    first = {}
    for doc_id, w in lists:
        for i in range(len(w) - window + 1):
            phrase = tuple(w[i : i + window])
            if doc_id is not None:
                first[phrase] = min(first.get(phrase, doc_id), doc_id)
    out = Counter()
    for doc_id, w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out[doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def passages(seed, n_docs=60, window=12):
    """Texts stitched from a few passages and loose words, some of few different words; ids in no order."""
    rng = random.Random(seed)
    loose = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(loose) for _ in range(rng.randint(window - 2, 4 * window))] for _ in range(6)]
    shared.append(["a"] * (3 * window))
    shared.append(["b", "c"] * (2 * window))
    rows = []
    for i in range(n_docs):
        w = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(shared))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            a, b = sorted(rng.randrange(len(part) + 1) for _ in range(2))
            w += part[a:] if rng.random() < 0.5 else part[:b]
            w += [rng.choice(loose) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([i, i // 2]), "\t\n".join(w) if i % 3 else " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block_pieces", [(1, 4096), (2, 4096), (3, 1), (4, 2), (5, 0)])
def test_windows_of_a_few_words(spark, seed, block_pieces):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = without_repeats(docs, window=12, seed=3, block_pieces=block_pieces)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 12)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 50)
    assert Counter(tuple(r) for r in without_repeats(docs).collect()) == want
    digests = Counter((d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in want.elements())
    assert Counter(tuple(r) for r in without_repeats(docs, digests=True).collect()) == digests
    assert sum(w[2] for w in want) > 30_000
    assert without_repeats(empty(spark)).collect() == []
    assert repeated_spans(empty(spark)).collect() == []


def test_blocks_of_a_long_text_are_read_as_one(monkeypatch):
    text = " ".join(f"word{i % 77}" for i in range(3000)).encode()
    both = np.frombuffer(text + b"x y" + text, np.uint8)
    offsets = np.array([0, len(text), len(text) + 3, 2 * len(text) + 3])
    whole = substring_dedup._hashed_words(both, offsets)
    pieces = [np.concatenate(p) for p in zip(*substring_dedup._pieces(whole[2], whole[3], 50, 8))]
    monkeypatch.setattr(substring_dedup, "READ_BYTES", 100)
    for x, y in zip(whole, substring_dedup._hashed_words(both, offsets)):
        assert (x == y).all()
    # Words in blocks may cut pieces in two; together they hold the same windows under the same anchors.
    monkeypatch.setattr(substring_dedup, "READ_WORDS", 64)
    cut = [np.concatenate(p) for p in zip(*substring_dedup._pieces(whole[2], whole[3], 50, 8))]

    def windows(found):
        return {(k, s + i) for k, s, n in zip(found[0].tolist(), found[2].tolist(), found[3].tolist()) for i in range(n)}

    assert windows(pieces) == windows(cut)
    assert len(windows(pieces)) == pieces[3].sum() == 2 * (3000 - 49)


def test_factors_stop_where_their_source_does():
    a = np.arange(100, 200, dtype=np.uint64)
    one, two = a[:30], np.concatenate([a[20:30], a[40:44]])
    three = np.concatenate([a[5:28], a[20:30], a[40:42]])
    words_ = np.concatenate([one, two, three, three])
    ends = np.cumsum([len(one), len(two), len(three), len(three)])
    piece, at, length = factored(words_, ends, np.array([0, 0, 0, 1]), np.array([1, 2, 2, 9]), 8)
    found = sorted(zip(piece.tolist(), at.tolist(), length.tolist()))
    # The second and third piece share a document, the last is a block of its own.
    assert found == [(1, 0, 10), (2, 0, 23), (2, 23, 10)]


def test_a_passage_in_many_contexts(spark):
    """A crowded anchor: every document holds one passage between words of its own."""
    common = " ".join(f"c{i}" for i in range(60))
    docs = spark.range(400).selectExpr(
        "id AS doc_id",
        f"concat_ws(' ', transform(sequence(1, 60), i -> concat('l', id, '_', i)), '{common}',"
        " transform(sequence(1, 60), i -> concat('r', id, '_', i))) AS text",
    )
    got = without_repeats(docs, block_pieces=16).collect()
    assert all((r.n_words, r.n_removed) == (180, 0 if r.doc_id == 0 else 60) for r in got)


def test_query_matches_sql(spark):
    got = spark_result(driver.queries()["op11_substring_dedup"](spark, f"{DATA}/sf0.001"))
    assert got == duck_result(duck("0.001"), driver.oracle_sql()["op11_substring_dedup"])
