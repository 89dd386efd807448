import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from conftest import DATA, duck, duck_result, spark_result
from frames import BLANKS, empty, held, odd_documents, prose, words
from llm import chat_format, line_quality, pseudo_likelihood, queries, toxicity

SF = f"{DATA}/sf0.01"


def rows(df):
    return [tuple(r) for r in df.collect()]


# Line quality


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    repeated = {i + d for i, x in enumerate(windows) if often[x] > 1 for d in range(5)}
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_base_rules(spark):
    docs = odd_documents(spark)
    extra = [(20, "a b c d e f\na b c d e f\n x \n x \n"), (21, "# * $ % & | < > é\r\n\x0b"), (22, prose(8, 40) * 2)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = line_quality.judged(docs, line_quality.UNTRAINED).drop("content_share", "kept")
    assert Counter(rows(got)) == Counter((r.doc_id, *base_counts(r.text)) for r in docs.collect())
    assert rows(line_quality.judged(empty(spark), line_quality.UNTRAINED)) == []
    assert line_quality.learn(empty(spark), spark.createDataFrame([], "doc_id long, quality int")) == line_quality.UNTRAINED


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(5)
    counts = [1, 4, 0, 7, 2]
    first = np.concatenate([[0], np.cumsum(counts)])
    scores, moves = rng.normal(size=(sum(counts), 2)), rng.normal(size=(2, 2))
    got = line_quality.viterbi(scores, moves, first)
    for a, b in itertools.pairwise(first):
        paths = itertools.product((0, 1), repeat=b - a)

        def worth(path, a=a):
            return sum(scores[a + i, y] for i, y in enumerate(path)) + sum(moves[p] for p in itertools.pairwise(path))

        assert tuple(got[a:b]) == max(paths, key=worth)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(6)
    y = np.repeat(rng.integers(0, 2, 60), 5)
    x = np.stack([np.ones(len(y)), y + rng.normal(0, 0.7, len(y))], axis=1)
    first = np.arange(0, len(y) + 1, 20)
    weights, moves = line_quality.train(x, y, first)
    alone = max((np.where(x[:, 1] > cut, 1, 0) == y).mean() for cut in np.linspace(-1, 2, 61))
    assert (line_quality.viterbi(x @ weights, moves, first) == y).mean() > alone + 0.05
    assert moves[0, 0] > moves[0, 1] and moves[1, 1] > moves[1, 0]


def test_quality_query(spark):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_line_quality(spark, SF).collect()}
    assert got.keys() == source.keys()
    for i, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(source[i])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(got[i].kept, q) for i, q in labels.items() if not got[i].base_failed]
    assert sum(kept == (q == 1) for kept, q in judged) / len(judged) > 0.95


# Toxicity


def test_toxicity_query_on_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()}
    got = queries.op7_toxicity(spark, f"{DATA}/sf0.1").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    hits = sum(p == t == 1 for p, t in out)
    assert hits / sum(p for p, _ in out) > 0.85 and hits / sum(t for _, t in out) > 0.8


def test_toxicity_of_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (4, 0), (9, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert rows(toxicity.scored(empty(spark), none)) == []


def test_features_match_brute_force():
    texts = ["Bad, bad cat", "", "é!x", "\n"]
    owner, slot = toxicity.features(pa.array(texts))
    for i, t in enumerate(texts):
        plain = f" {''.join(c.lower() if c.isalpha() else ' ' for c in t)} ".encode()
        assert (owner == i).sum() == max(0, len(plain) - 4) + len(plain.split())
    a, b = toxicity.features(pa.array(["  Cat "])), toxicity.features(pa.array(["cat."]))
    assert set(b[1]) <= set(a[1])


def test_risk_stays_corrected():
    """Unlabelled data are not negatives: positives among them must not be pushed down."""
    rng = np.random.default_rng(7)
    hidden = rng.random(2000) < 0.3
    x = np.stack([hidden, rng.random(2000) < 0.5], axis=1).astype(np.float32)
    x = np.concatenate([x, np.array([[1, 0], [1, 1]] * 100, np.float32)])
    positive = np.arange(2200) >= 2000
    w, b = toxicity.nn_pu(x, positive, ~positive, 0.3)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert p[:2000][hidden].mean() > 0.8 and p[:2000][~hidden].mean() < 0.1


# Chat formatting

TURN = "array<struct<role:string,text:string>>"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n".replace("a<|b", "a< |b") for r, t in turns)


def test_preference_pairs(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    pairs = [
        (1, [a, b, a, b], [a, b, a, c]),
        (2, [a, b], [a]),
        (3, None, [b]),
        (4, [], []),
        (5, [a, (None, None)], [a, ("unknown", "")]),
        (None, [("user", "a<|b"), b], [("user", "a<|b"), c]),
    ]
    got = {r.pair_id: r for r in chat_format.preference_pairs(spark.createDataFrame(pairs, f"pair_id long, chosen {TURN}, rejected {TURN}")).collect()}
    assert [got[i].n_prompt_turns for i in (1, 2, 3, 4, 5, None)] == [3, 1, 0, 0, 2, 1]
    assert got[1].prompt == render([a, b, a]) and got[1].chosen == render([b]) and got[1].rejected == render([c])
    assert got[None].prompt == render([("user", "a<|b")])
    assert (got[2].chosen, got[2].rejected, got[2].trainable) == (render([b]), "", False)
    for r in got.values():
        for text, spans in ((r.chosen, r.chosen_loss), (r.rejected, r.rejected_loss)):
            shown = [text[int(s.split(":")[0]) : int(s.split(":")[1])] for s in spans.split(",") if s]
            assert shown == [t.split("\n", 1)[1][:-1] for t in text.split("<|im_start|>") if t.startswith("assistant")]
    assert got[1].trainable


def test_conversations_of_odd_rows(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", None), (2, 0, "assistant", "x")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.conversations(df).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("unknown", "")], None: [("user", "")], 2: [("assistant", "x")]}
    shown = chat_format.preference_pairs(chat_format.stale_reply_pairs(chat_format.conversations(df)))
    con = duck("0.001")
    con.register("given", df.toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))
    con.execute("CREATE OR REPLACE VIEW conversations AS SELECT * FROM given")
    assert spark_result(shown) == duck_result(con, chat_format.ORACLE_SQL)
    assert chat_format.preference_pairs(chat_format.stale_reply_pairs(chat_format.conversations(df.limit(0)))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    got = spark_result(driver.queries()[name](spark, SF))
    assert got == duck_result(duck("0.01"), driver.oracle_sql()[name]) and got[1]


def test_chat_format_runs_without_python(spark):
    plan = queries.op4_preference_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# Pseudo-likelihood


def test_classes_match_brute_force():
    texts = ["The cat. the", "", "cat THE x", " "]
    known = [b"the", b"x"]
    classes, places = pseudo_likelihood.Classes(known)(pa.array(texts))
    assert len(places) == 6 and (np.delete(classes, places) == pseudo_likelihood.EDGE).all()
    got = classes[places].tolist()
    assert (got[0], got[2], got[4], got[5]) == (0, 0, 0, 1)
    assert got[3] >= pseudo_likelihood.TOP_WORDS and got[3] != pseudo_likelihood.EDGE


def test_probabilities_sum_to_one_and_gradients_point_down():
    rng = np.random.default_rng(8)
    classes = rng.integers(0, pseudo_likelihood.CLASSES, 400)
    places = np.arange(2, 398)
    net = pseudo_likelihood.Network()
    total = np.zeros(1)
    for c in range(pseudo_likelihood.CLASSES):
        changed = classes.copy()
        changed[200] = c
        total += np.exp(net.log_probabilities(changed, np.array([200])))
    assert abs(total[0] - 1) < 1e-4
    before = net.log_probabilities(classes, places).mean()
    for _ in range(30):
        net.learn(classes, places)
    assert net.log_probabilities(classes, places).mean() > before + 0.05


def test_word_counts_cover_all_texts(spark):
    docs = odd_documents(spark).select("doc_id", "text")
    counts = Counter(w for r in docs.collect() for w in words("".join(c.lower() if c.isascii() else c for c in r.text or "")))
    want = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:20]
    assert [w.decode() for w in pseudo_likelihood.frequent_words(docs, 20)] == want


def test_pseudo_likelihood_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = pseudo_likelihood.pseudo_likelihood(docs).collect()
    n = Counter((r.doc_id, r.n_tokens) for r in got)
    assert n == Counter((r.doc_id, len(words(r.text))) for r in docs.collect())
    for r in got:
        assert r.log_likelihood <= 0 and (r.mean_log_likelihood is None) == (r.n_tokens == 0)
    assert rows(pseudo_likelihood.pseudo_likelihood(empty(spark))) == []


def test_training_beats_the_untrained_network(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    chosen = pseudo_likelihood.frequent_words(docs)
    means = []
    for weights in (pseudo_likelihood.Network().flat(), pseudo_likelihood.train(docs, chosen)):
        r = pseudo_likelihood.scored(docs, chosen, weights).selectExpr("sum(log_likelihood) / sum(n_tokens)").first()
        means.append(r[0])
    assert means[1] > means[0] + 0.3


def test_training_masks_every_token_once(monkeypatch):
    masked = []
    monkeypatch.setattr(pseudo_likelihood.Network, "learn", lambda self, classes, places: masked.extend(places.tolist()))
    texts = ["one", "two words", " ".join(f"w{i}" for i in range(50)), ""]
    classes, places = pseudo_likelihood.Classes([])(pa.array(texts))
    ends = np.cumsum([len(t.split()) for t in texts])
    data = [bytes(classes[places][a:b].astype(np.uint8)) for a, b in zip([0, *ends], ends)]
    batch = pa.record_batch({"unit": pa.array([3] * len(data), pa.int32()), "classes": pa.array(data, pa.binary())})
    for number in range(pseudo_likelihood.ROUNDS):
        list(pseudo_likelihood._round(pseudo_likelihood.Network().flat(), number)([batch]))
    assert sorted(masked) == places.tolist()


def test_units_are_learned_alike_in_any_batches(monkeypatch):
    """However rows are batched, a unit's texts are learned in the same pieces; units start afresh."""
    monkeypatch.setattr(pseudo_likelihood, "CHUNK_TOKENS", 64)
    rng = np.random.default_rng(8)
    units = np.sort(rng.integers(0, 3, 60)).astype(np.int32)
    data = [rng.integers(0, pseudo_likelihood.EDGE, n).astype(np.uint8).tobytes() for n in rng.integers(0, 40, 60)]
    start = pseudo_likelihood.Network().flat()

    def learned(size):
        batches = [
            pa.record_batch({"unit": pa.array(units[a : a + size]), "classes": pa.array(data[a : a + size], pa.binary())})
            for a in range(0, 60, size)
        ]
        (out,) = pseudo_likelihood._round(start, 0)(batches)
        return out.column(1).to_numpy()

    assert (learned(60) == learned(7)).all() and (learned(60) == learned(1)).all()
    one_by_one = sum(
        next(
            pseudo_likelihood._round(start, 0)(
                [
                    pa.record_batch(
                        {
                            "unit": pa.array(units[units == u]),
                            "classes": pa.array([d for d, v in zip(data, units) if v == u], pa.binary()),
                        }
                    )
                ]
            )
        )
        .column(1)
        .to_numpy()
        for u in range(3)
    )
    assert np.allclose(learned(60), one_by_one)
    assert list(pseudo_likelihood._round(start, 0)([])) == []


def test_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [
        {r.doc_id: r.log_likelihood for r in pseudo_likelihood.pseudo_likelihood(docs.repartition(n)).collect()}
        for n in (1, 4, 16)
    ]
    for other in found[1:]:
        assert max(abs(found[0][k] - other[k]) for k in found[0]) < 1e-6 * max(map(abs, found[0].values()))


def test_held_out_texts_are_likelier_than_by_class_frequencies(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    known, unseen = docs.filter("doc_id % 5 != 0"), docs.filter("doc_id % 5 = 0")
    chosen = pseudo_likelihood.frequent_words(known)
    nothing = pseudo_likelihood._shares(None)[0]
    network = pseudo_likelihood.Network(pseudo_likelihood.train(known, chosen))
    counts = np.ones(pseudo_likelihood.EDGE)
    for r in pseudo_likelihood.encoded(known, chosen, nothing).select("classes").collect():
        counts += np.bincount(np.frombuffer(r.classes, np.uint8), minlength=len(counts))
    own, plain = [], []
    for r in pseudo_likelihood.encoded(unseen, chosen, nothing).select("classes").collect():
        classes = np.frombuffer(r.classes, np.uint8).astype(np.int64)
        own.append(network.log_probabilities(*pseudo_likelihood.with_edges(classes, np.array([len(classes)]))))
        plain.append(np.log(counts / counts.sum())[classes])
    assert np.concatenate(own).mean() > np.concatenate(plain).mean() + 0.08


@pytest.mark.parametrize("hot", [65_536, 3, 0])
def test_scores_by_plain_python(spark, monkeypatch, hot):
    """Scores from given weights and counts, token by token."""
    monkeypatch.setattr(pseudo_likelihood, "HOT_WORDS", hot)
    monkeypatch.setattr(pseudo_likelihood._shares, "__defaults__", (hot,))
    texts = {1: "the cat sat on the mat", 2: "a cat", 3: "", 4: "zebra zebra THE zebra", 5: None}
    frequent = [b"the", b"on"]
    counts = {b"the": 9, b"on": 4, b"cat": 5, b"sat": 2, b"mat": 1, b"dog": 7}
    rng = np.random.default_rng(2)
    net = pseudo_likelihood.Network(pseudo_likelihood.Network().flat() + rng.normal(0, 0.2, len(pseudo_likelihood.Network().flat())))
    embed, inner, bias, outer, out_bias = (p.astype(float) for p in net.parts)
    side, top = pseudo_likelihood.SIDE, pseudo_likelihood.TOP_WORDS

    def hash_class(word):
        return int(pseudo_likelihood._word_hashes([word])[0]) >> 58

    def class_of(word):
        return frequent.index(word) if word in frequent else top + hash_class(word)

    want = {}
    for i, text in texts.items():
        w = [x.lower().encode() for x in (text or "").split()]
        padded = [pseudo_likelihood.EDGE] * side + [class_of(x) for x in w] + [pseudo_likelihood.EDGE] * side
        total = 0.0
        for k, word in enumerate(w):
            around = padded[k : k + side] + padded[k + side + 1 : k + 2 * side + 1]
            logits = np.tanh(sum(embed[c] @ inner[d] for d, c in enumerate(around)) + bias) @ outer + out_bias
            total += logits[padded[k + side]] - np.log(np.exp(logits).sum())
            if word not in frequent:
                same = [n for x, n in counts.items() if x not in frequent and hash_class(x) == hash_class(word)]
                total += np.log((counts.get(word, 0) + 1) / (sum(same) + len(same) + 1))
        want[i] = (len(w), total)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long")
    got = pseudo_likelihood.scored(docs, frequent, net.flat(), table).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: n for i, (n, _) in want.items()}
    for r in got:
        assert abs(r.log_likelihood - want[r.doc_id][1]) < 1e-4
        assert (r.mean_log_likelihood is None) == (r.n_tokens == 0)


def test_words_of_a_class_cost_by_their_counts(spark):
    """In one hash class, a frequent word costs less than a rare one, and this less than an unseen one."""
    by_class = {}
    for n in range(200):
        h = int(pseudo_likelihood._word_hashes([b"w%d" % n])[0])
        by_class.setdefault(h >> 58, []).append((f"w{n}", h))
    c, (often, seldom, unseen) = next((c, ws[:3]) for c, ws in by_class.items() if len(ws) > 2)
    counts = spark.createDataFrame([(often[0].encode(), 97), (seldom[0].encode(), 1)], "word binary, n long")
    docs = spark.createDataFrame([(i, w[0]) for i, w in enumerate((often, seldom, unseen))], "doc_id long, text string")
    got = pseudo_likelihood.scored(docs, [], pseudo_likelihood.Network().flat(), counts)
    a, b, u = (r.log_likelihood for r in got.orderBy("doc_id").collect())
    assert abs(a - b - np.log(98 / 2)) < 1e-6 and abs(b - u - np.log(2)) < 1e-6


def test_toxicity_scores_from_given_weights(spark):
    """Scores by plain Python from the slots of words and five-character grams."""
    docs = odd_documents(spark)
    rng = np.random.default_rng(4)
    texts = [(r.doc_id, r.text) for r in docs.collect()]

    def slots(text):
        plain = " " + "".join(c if c in "abcdefghijklmnopqrstuvwxyz" else " " for c in (text or "").lower()) + " "
        parts = [plain[i : i + 5] for i in range(len(plain) - 4)]
        grams, words_ = toxicity.features(pa.array([text or ""])), plain.split()
        assert len(grams[1]) == len(parts) + len(words_)
        return set(grams[1].tolist())

    ascii_texts = [(i, t) for i, t in texts if (t or "").isascii()]
    known = sorted(set().union(*(slots(t) for _, t in ascii_texts)))
    chosen = np.array(sorted(rng.choice(known, 200, replace=False)), np.int64)
    model = toxicity.Model(chosen, rng.normal(0, 0.3, 200), -0.4)
    weight = dict(zip(chosen.tolist(), model.weights))
    want = Counter(
        (i, round(1 / (1 + np.exp(-(model.bias + sum(weight.get(s, 0) for s in slots(t))))), 9)) for i, t in ascii_texts
    )
    frame = spark.createDataFrame(ascii_texts, "doc_id long, text string")
    assert Counter((r.doc_id, round(r.score, 9)) for r in toxicity.scored(frame, model).collect()) == want


def test_features_are_chosen_as_plain_python_does(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 7)
    monkeypatch.setattr(toxicity, "SIGNIFICANT", 0.5)
    rng = np.random.default_rng(9)
    rows = [(i, sorted({int(s) for s in rng.integers(0, 40, 9)} | ({50} if i % 3 == 0 else set())), int(i % 3 == 0), int(i % 4 != 1)) for i in range(60)]
    n_p, n_u = sum(r[2] for r in rows), sum(r[3] for r in rows)
    z = {}
    for s in range(51):
        p, u = sum(r[2] for r in rows if s in r[1]), sum(r[3] for r in rows if s in r[1])
        m = (p + u + 1) / (n_p + n_u + 2)
        z[s] = (p / n_p - u / n_u) / np.sqrt(m * (1 - m) * (1 / n_p + 1 / n_u))
    want = sorted(sorted((s for s in z if z[s] >= 0.5), key=lambda s: (-z[s], s))[:7])
    df = spark.createDataFrame(rows, "doc_id long, slots array<int>, p int, u int")
    assert toxicity._chosen(df, n_p, n_u) == want and 50 in want
    model = toxicity._fit(df, 0.3)
    assert model.slots.tolist() == want and model.weights[want.index(50)] > 0
    nothing = toxicity._fit(df.withColumn("slots", F.array().cast("array<int>")), 0.3)
    assert len(nothing.slots) == 0 and toxicity._fit(df.filter("p = 0"), 0.3) is toxicity.NOTHING


def test_quality_verdict_from_given_weights(spark):
    """The column kept: the best of all labellings of a text's lines, by trying them."""
    rng = np.random.default_rng(2)
    field = (rng.normal(0, 1, (line_quality.N_FEATURES, 2)), rng.normal(0, 0.5, (2, 2)))
    texts = [prose(i, 12 + 7 * i) + ("\n" + prose(i, 6).strip() + "\n*** # ***") * (i % 3) for i in range(8)] + ["", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for i, text in enumerate(texts):
        lines = line_quality.Lines(pa.array([text]))
        scores, best = lines.features @ field[0], None
        for labels in itertools.product((0, 1), repeat=len(scores)):
            value = sum(scores[k, y] for k, y in enumerate(labels)) + sum(field[1][a, b] for a, b in itertools.pairwise(labels))
            if best is None or value > best[0]:
                best = (value, labels)
        letters = [sum(c not in BLANKS for c in line) for line in text.split("\n") if words(line)]
        share = sum(n for n, y in zip(letters, best[1]) if y == 0) / max(1, sum(letters))
        w = words(text)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + d for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for d in range(5)}
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        want[i] = (failed, round(share, 9), not failed and share >= 0.5)
    got = line_quality.judged(docs, field).collect()
    assert {r.doc_id: (r.base_failed, round(r.content_share, 9), r.kept) for r in got} == want
    assert {(False, True), (False, False), (True, False)} == {(v[0], v[2]) for v in want.values()}


@pytest.mark.parametrize("scale", [0.3, 30])
def test_network_equals_a_plain_one(scale):
    """A step and the scores are those of float64 arithmetic, for logits that a float's exponential can't hold, too."""
    rng = np.random.default_rng(4)
    classes = rng.integers(0, pseudo_likelihood.CLASSES, 300)
    places = np.arange(2, 2 + pseudo_likelihood.BATCH - 1)
    net = pseudo_likelihood.Network(rng.normal(0, scale, len(pseudo_likelihood.Network().flat())))
    embed, inner, bias, outer, out_bias = (x.astype(np.float64) for x in net.parts)
    n, flat = len(places), inner.reshape(-1, pseudo_likelihood.HIDDEN)
    around = np.stack([classes[places + d] for d in (-2, -1, 1, 2)], axis=1)
    x = embed[around].reshape(n, -1)
    hidden = np.tanh(x @ flat + bias)
    logits = hidden @ outer + out_bias
    logits -= logits.max(axis=1)[:, None]
    log_p = logits - np.log(np.exp(logits).sum(axis=1))[:, None]
    own = log_p[np.arange(n), classes[places]]
    assert np.allclose(net.log_probabilities(classes, places), own, rtol=1e-3, atol=1e-3 * scale)
    down = np.exp(log_p)
    down[np.arange(n), classes[places]] -= 1
    inside = (down @ outer.T) * (1 - hidden * hidden)
    step = pseudo_likelihood.RATE / n
    grown = embed.copy()
    np.subtract.at(grown, around.ravel(), step * (inside @ flat.T).reshape(-1, pseudo_likelihood.WIDTH))
    want = [grown, (flat - step * x.T @ inside).reshape(inner.shape), bias - step * inside.sum(axis=0),
            outer - step * hidden.T @ down, out_bias - step * down.sum(axis=0)]
    net.learn(classes, places)
    for got, w in zip(net.parts, want, strict=True):
        assert np.allclose(got, w, rtol=1e-3, atol=1e-3 * scale)


def test_exponentials_without_a_shift():
    """Exponentials are taken where the logits lie; a sum tells whether they could be, no pass for a maximum before."""
    hidden, outer = np.ones((4, 3), np.float32), np.full((3, pseudo_likelihood.CLASSES), 0.5, np.float32)
    logits = hidden @ outer
    shift, sums = pseudo_likelihood._exponentials(logits, hidden, outer)
    assert not shift.any() and np.allclose(logits, np.exp(1.5)) and np.allclose(sums, pseudo_likelihood.CLASSES * np.exp(1.5))


def test_words_counted_in_any_pieces(monkeypatch):
    """Counts handed on in pieces add up to those of plain Python, and few pieces repeat a word."""
    texts = [None, "", " a\x0b\x0cB\x1c\x85  X y \x00z", "\n\n", "É A"] + [
        " ".join(f"W{(i * k) % 97}" for i in range(40)) for k in range(1, 30)
    ]
    want = Counter()
    for t in texts:
        want.update("".join(c.lower() if c.isascii() else c for c in t or "").encode().split())
    batches = [pa.record_batch({"text": pa.array(texts[a : a + 3])}) for a in range(0, len(texts), 3)]
    for most in (10, 1000):
        monkeypatch.setattr(pseudo_likelihood, "COUNTED", most)
        got, n = Counter(), 0
        for out in pseudo_likelihood._count(batches):
            n += out.num_rows
            got.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)))
        assert got == want
    assert n == len(want)


@pytest.mark.parametrize("n", [0, 1, 3, 200])
def test_places_of_hashes(n):
    rng = np.random.default_rng(n)
    hashes = np.unique(np.append(rng.integers(0, 2**64 - 1, n, dtype=np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)[:n]))
    asked = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, 2**64 - 1, 500, dtype=np.uint64)])
    at, there = pseudo_likelihood.Places(hashes)(asked)
    assert (there == np.isin(asked, hashes)).all() and (hashes[at[there]] == asked[there]).all()
