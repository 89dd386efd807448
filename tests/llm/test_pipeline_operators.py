import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import DATA
from llm import decontamination, language_id, line_dedup, packing, queries, simhash, token_counts
from llm.pretokens import pieces
from llm.tables import may_learn
from llm.rank_merge import merger
from frames import components, empty, fingerprint, held, lower, odd_documents, prose, words

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SF = f"{DATA}/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@settings(max_examples=300, deadline=None)
@given(
    st.text(
        st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("aAtTs' \n\tΣİ́<|>"))),
        max_size=30,
    ),
    st.sampled_from(["", "<|startoftext|>", "<|endoftext|><|endoftext|>", "<|STARTOFTEXT|>"]),
)
def test_ids_equal_the_library(text, mark):
    text = text[:7] + mark + text[7:]
    ids, counts = merger(PATH).encode(pieces(text))
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert counts.sum() == len(ids)


def test_token_counts(spark):
    docs = odd_documents(spark)
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        n = len(LIBRARY.encode(text, add_special_tokens=False).ids)
        want[(r.doc_id, len(text.encode()), n, n > 2048)] += 1
    assert Counter(rows(token_counts.token_counts(docs, PATH))) == want
    assert rows(token_counts.token_counts(empty(spark), PATH)) == []


def check_packing(found, docs):
    size = 2048
    by_doc, by_sequence = defaultdict(Counter), defaultdict(list)
    for r in found:
        by_doc[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] += 1
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    for doc_id, text in docs:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4").tobytes()
            want[doc_id][(piece, at, len(part) // 4, zlib.crc32(part))] += 1
    assert by_doc == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in found)
    return len(by_sequence), -(-total // size)


def test_packing(spark):
    docs = odd_documents(spark)
    found = packing.packed(docs, PATH).collect()
    check_packing(found, [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.packed(empty(spark), PATH).collect() == []
    kept = packing.packed(docs, PATH, keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in kept)


def test_packing_query_is_tight(spark):
    used, least = check_packing(queries.op8_best_fit_packing(spark, SF).collect(), documents(spark))
    assert used <= 1.03 * least + 1


def test_open_bins_close_the_fullest_and_fit_best():
    bins = packing.OpenBins(10, 2)
    assert bins.place(4) == (0, 0, [])
    assert bins.place(7) == (1, 0, [])
    assert bins.place(3) == (1, 7, [1])
    assert bins.place(9) == (2, 0, [])
    # Nothing fits and no more may be opened: the fullest closes.
    assert bins.place(8) == (3, 0, [2])
    assert bins.place(6) == (0, 4, [0])


def test_simhash(spark):
    docs = odd_documents(spark)
    source = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [fingerprint(t) for _, t in source]
    assert Counter((d, p) for (d, _), p in zip(source, prints)) == Counter(
        (d, p % 2**64) for d, p in rows(simhash.fingerprints(docs))
    )
    root = components(len(source), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = defaultdict(list)
    for (doc_id, _), r in zip(source, root):
        if doc_id is not None:
            least[r].append(doc_id)
    want = Counter((d, min(least[r], default=None)) for (d, _), r in zip(source, root))
    got = simhash.near_duplicates(docs).select("doc_id", "component_id")
    assert Counter(rows(got)) == want
    assert rows(simhash.near_duplicates(empty(spark))) == []
    stay = simhash.one_of_each(docs)
    assert stay.columns == docs.columns
    assert stay.count() == len(set(root))
    assert simhash.one_of_each(empty(spark)).columns == docs.columns


@pytest.mark.parametrize("dense", [1, 3, 64])
def test_links_connect_what_brute_force_connects(spark, dense):
    rng = np.random.default_rng(dense)
    seeds = rng.integers(-(2**63), 2**63, 12)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(20):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.add(int(np.int64(s) ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)).astype(np.int64)))
    fps = sorted(fps)
    found = rows(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), dense=dense))
    at = {f: i for i, f in enumerate(fps)}
    linked = {tuple(sorted((at[a], at[b]))) for a, b in found}
    assert all((fps[a] % 2**64 ^ fps[b] % 2**64).bit_count() <= 2 for a, b in linked)
    want = components(len(fps), lambda i, j: (fps[i] % 2**64 ^ fps[j] % 2**64).bit_count() <= 2)
    assert components(len(fps), lambda i, j: (i, j) in linked) == want


def test_simhash_query(spark):
    source = documents(spark)
    prints = [fingerprint(t) for _, t in source]
    ids = [d for d, _ in source]
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    root = components(len(ids), lambda i, j: (prints[order[i]] ^ prints[order[j]]).bit_count() <= 2)
    want = {(ids[order[i]], f"{prints[order[i]]:016x}", ids[order[r]]) for i, r in enumerate(root)}
    assert set(rows(queries.op9_simhash(spark, SF))) == want


def brute_lines(source):
    lines = [(d, n, line.strip(" \t\n\r\x0b\x0c")) for d, t in source for n, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    different = sorted({x[2] for x in lines})
    sets = [line_dedup.shingles(x) for x in different]
    root = components(
        len(different), lambda i, j: line_dedup.jaccard(sets[i], sets[j]) >= 0.8
    )
    return lines, dict(zip(different, root))


def test_line_dedup_query(spark):
    source = sorted(documents(spark))
    lines, root = brute_lines(source)
    first = {}
    for d, n, line in lines:
        first.setdefault(root[line], (d, n))
    want = {(d, n, first[root[line]] == (d, n)) for d, n, line in lines}
    got = rows(queries.op5_line_dedup(spark, SF).select("doc_id", "line_no", "kept"))
    assert set(got) == want and len(got) == len(lines)


def test_line_dedup_edits(spark):
    docs = odd_documents(spark)
    out = line_dedup.without_repeated_lines(docs, count_col="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = defaultdict(list)
    for r in out.collect():
        by_id[r.doc_id].append(r.text)
    assert by_id[1] == [prose(1, 60)]
    assert by_id[2] == [""]
    assert by_id[5] == [None] and by_id[7] == [" \n\t\n "]
    assert "".join(by_id[13]).strip() == prose(5, 33).strip()
    assert line_dedup.without_repeated_lines(empty(spark)).columns == docs.columns
    assert rows(line_dedup.marked_lines(empty(spark))) == []


def test_hot_lines_stay_linear(spark):
    """A thousand near copies of one line over several tasks give candidates in proportion."""
    base = " ".join(words(prose(7, 70)))
    docs = spark.createDataFrame([(i, f"{base} {i}") for i in range(1000)], "doc_id long, text string").repartition(4)
    assert line_dedup.candidates(docs).count() < 30_000
    assert line_dedup.marked_lines(docs).filter("kept").count() == 1


def test_lines_of_a_value_all_meet(spark):
    """450 lines of one template: whoever shares a band's value with no more lines than are paired is a candidate."""
    rng = np.random.default_rng(5)
    base, other = words(prose(8, 40)), words(prose(9, 400))
    lines = sorted(
        {
            " ".join(other[rng.integers(400)] if rng.random() < rate else w for w in base)
            for rate in (0.02, 0.06, 0.1)
            for _ in range(150)
        }
    )
    ids = [line_dedup.line_id(line) for line in lines]
    keys = line_dedup.band_keys(line_dedup.signatures(lines)) >> np.uint64(line_dedup.ORDER_BITS)
    by_value = defaultdict(list)
    for i, row in zip(ids, keys.tolist(), strict=True):
        for value in row:
            by_value[value].append(i)
    want = {
        (min(a, b), max(a, b))
        for group in by_value.values()
        if len(group) <= line_dedup.NEAREST + 1
        for a in group
        for b in group
        if a != b
    }
    texts = ["\n".join(lines[k::7]) for k in range(7)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = set(rows(line_dedup.candidates(docs)))
    assert len(want) > 300 and want <= got
    # All lines: the same components as all pairs with their exact similarity.
    _, root = brute_lines([(0, "\n".join(lines))])
    found = dict(rows(line_dedup.marked_lines(docs).select("line_id", "component_id").distinct()))
    by_root, by_found = defaultdict(set), defaultdict(set)
    for i, line in zip(ids, lines, strict=True):
        by_root[root[line]].add(i)
        by_found[found[i]].add(i)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_found.values()))


def planted(spark):
    item = prose(41, 40)
    w = words(item)
    changed = [x if i % 7 else "replaced" for i, x in enumerate(w)]
    docs = [
        (1, prose(1, 100) + " " + item + " " + prose(2, 50)),
        (2, prose(3, 90) + " " + " ".join(changed).upper()),
        (3, prose(4, 200)),
        (4, None),
        (5, ""),
        (6, "short item of exactly seven plain words"),
        (None, item),
        (7, " ".join(w[:8])),
    ]
    items = [(100, item), (101, item), (102, None), (103, ""), (104, "item of exactly seven plain"), (105, "of exactly"), (None, prose(50, 30))]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)),
        spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("x")),
    )


def test_decontamination(spark):
    docs, items = planted(spark)
    found = {(r.doc_id, r.item_id): r for r in decontamination.overlaps(docs, items).collect()}
    assert set(found) == {(1, 100), (1, 101), (2, 100), (2, 101), (None, 100), (None, 101), (6, 104)}
    assert (found[1, 100].doc_word, found[1, 100].n_words, found[1, 100].n_equal) == (100, 40, 40)
    assert found[2, 100].n_equal == 34
    left = decontamination.without_overlaps(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7]
    assert decontamination.overlaps(empty(spark), items).count() == 0
    assert decontamination.overlaps(docs, items.limit(0)).count() == 0
    assert decontamination.without_overlaps(docs, items.limit(0)).count() == docs.count()


def test_decontamination_query(spark):
    items = [(r.item_id, words(lower(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for doc_id, text in documents(spark):
        w = words(lower(text))
        for item_id, item in items:
            need = min(len(item), decontamination.MIN_WORDS)
            for shift in range(-len(item) + need, len(w) - need + 1):
                a, b = max(0, -shift), min(len(item), len(w) - shift)
                equal = np.array([w[shift + j] == item[j] for j in range(a, b)], bool)
                s, e = decontamination.best_overlap(equal, 0.8) if equal.sum() >= 0.8 * need else (0, 0)
                if e - s >= need:
                    want.add((doc_id, item_id))
    got = set(rows(queries.op6_decontamination(spark, SF).select("doc_id", "item_id")))
    assert got == want and want


@given(st.lists(st.booleans(), max_size=40))
def test_best_overlap(equal):
    e = np.array(equal, bool)
    fitting = [(a, b) for a in range(len(e)) for b in range(a + 1, len(e) + 1) if e[a:b].sum() >= 0.8 * (b - a) - 1e-9]
    longest = max((b - a for a, b in fitting), default=0)
    a, b = decontamination.best_overlap(e, 0.8)
    assert b - a == longest and (longest == 0 or (a, b) in fitting)


def test_language_id(spark):
    docs = odd_documents(spark)
    content = language_id.learn(docs, F.lit(True))
    assert set(content) == {"xx", "yy"}
    got = language_id.language_of(docs, content).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (5, 6, 7, 8):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        if r.doc_id in (1, 9, 11, 12):
            assert r.lang_pred in content
    assert language_id.learn(empty(spark), F.lit(True)) == {}
    assert {r.lang_pred for r in language_id.language_of(docs, {}).collect()} == {"und"}
    assert language_id.language_of(empty(spark), content).count() == 0
    left = language_id.in_clear_language(docs, content)
    assert left.columns == docs.columns
    assert left.count() == sum(not r.rejected for r in got)


def test_language_query_holds_out(spark):
    sf = f"{DATA}/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_language_id(spark, sf).collect()
    assert all(r.held_out == held(r.doc_id) for r in got)
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(right) > 200 and sum(right) / len(right) > 0.98


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    after = {(r.doc_id, r.text) for r in docs.collect()}
    assert 0 < len(after) < before
    check_packing(corpus_pipeline.run(spark, SF).collect(), after)


def test_stages_take_odd_documents(spark):
    for docs in (odd_documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd_documents(spark).columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_arrow_chunks_keep_every_row():
    from llm.arrays import chunks

    batch = pa.record_batch({"id": list(range(5)), "text": ["a" * 10, None, "b" * 100, "", "c"]})
    got = [c.to_pydict() for c in chunks([batch], "text", 20)]
    assert [i for g in got for i in g["id"]] == list(range(5))
    assert [t for g in got for t in g["text"]] == ["a" * 10, "", "b" * 100, "", "c"]


def template_lines(n):
    """Lines around one template; similar ones stand apart in any order of their hashes."""
    rng = np.random.default_rng(17)
    base, other = words(prose(8, 40)), words(prose(9, 400))
    return sorted(
        {" ".join(other[rng.integers(400)] if rng.random() < 0.08 else w for w in base) for _ in range(n)}
    )


def components_of_values(lines):
    """Components that all pairs of lines with an equal band value give."""
    keys = line_dedup.band_keys(line_dedup.signatures(lines)) >> np.uint64(line_dedup.ORDER_BITS)
    sets = [line_dedup.shingles(line) for line in lines]
    met = lambda i, j: (keys[i] == keys[j]).any() and line_dedup.jaccard(sets[i], sets[j]) >= 0.8
    return components(len(lines), met)


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_lines_of_a_crowded_value_all_meet(spark, monkeypatch):
    """With few lines paired one by one and small blocks, the components are those of all pairs of the values."""
    monkeypatch.setattr(line_dedup, "NEAREST", 2)
    monkeypatch.setattr(line_dedup, "BLOCK", 40, raising=False)
    lines = template_lines(400)
    want = components_of_values(lines)
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string").repartition(5)
    found = dict(rows(line_dedup.marked_lines(docs).select("line_id", "component_id").distinct()))
    assert len(set(want)) > 20
    assert same_partition(want, [found[line_dedup.line_id(line)] for line in lines])


def test_no_line_leaves_its_values(spark):
    """A task that has many similar lines of a value hands on all of them."""
    lines = template_lines(300)
    docs = spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")
    values = line_dedup.band_keys(line_dedup.signatures(lines)) >> np.uint64(line_dedup.ORDER_BITS)
    by_value = defaultdict(set)
    for line, row in zip(lines, values.tolist(), strict=True):
        for value in row:
            by_value[value].add(line_dedup.line_id(line))
    want = {(v, i, len(ids)) for v, ids in by_value.items() if len(ids) > 1 for i in ids}
    assert max(n for _, _, n in want) > line_dedup.NEAREST + 1
    assert set(rows(line_dedup._met_in_values(docs))) == want


def test_seeds_miss_no_overlap():
    """Whichever words are replaced, some seed looks at none of them."""
    for n in range(decontamination.LEAST_ITEM, 2 * decontamination.MIN_WORDS):
        short = n < decontamination.MIN_WORDS
        shapes = decontamination._shapes([n] if short else [])[len(decontamination.MASKS) if short else 0 :]
        seeds = {sum(1 << i + at for i in shape) for span, shape in shapes for at in range(n - span + 1)}
        for replaced in itertools.combinations(range(n), int(0.2 * n + 1e-9)):
            bits = sum(1 << i for i in replaced)
            assert any(not seed & bits for seed in seeds), (n, replaced)


def test_replaced_words_are_found_at_any_place(spark):
    items = [words(prose(60 + n, n)) for n in (5, 9, 11, 12, 15)]
    docs = []
    for item in items:
        for replaced in itertools.combinations(range(len(item)), int(0.2 * len(item) + 1e-9)):
            changed = ["other" if i in replaced else w for i, w in enumerate(item)]
            docs.append((len(docs), " ".join(["before", *changed, "after"]), len(item)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, n long")
    benchmark = spark.createDataFrame([(len(w), " ".join(w)) for w in items], "item_id long, text string")
    found = decontamination.overlaps(docs, benchmark).select("doc_id", "item_id")
    assert {(r.doc_id, r.n) for r in docs.collect()} <= set(rows(found))


def test_languages_are_bounded_and_learned_from_named_documents(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [(i, f"{lang} words of {lang} {i}", lang) for lang, n in (("aa", 6), ("bb", 4), ("cc", 4), ("dd", 1)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert list(language_id.learn(docs, F.lit(True))) == ["aa", "bb"]
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert language_id.learn(unnamed, may_learn()) == {}
    assert [r[0] for r in docs.select(may_learn()).collect()] == [not held(r[0]) for r in rows]


def test_language_by_direct_compression(spark):
    """Sizes by zstandard's own one-shot calls, block by block and level by level."""
    content = {"aa": b" amber birch cedar delta ember ", "bb": b" quill raven pearl onyx nylon ", "cc": b" 12 34 56 "}
    texts = [prose(i, 5 + 40 * i) for i in range(6)] + ["Amber BIRCH\tcedar", "quill raven", "", "123", None, prose(7, 3000)]

    def direct(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        plain = f" {' '.join(text.lower().split())} "
        for level in language_id.LEVELS:
            sizes = {}
            for lang, data in content.items():
                given = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                pack = zstandard.ZstdCompressor(level=level, dict_data=given, write_content_size=False)
                at = range(0, len(plain), language_id.BLOCK_CHARS)
                sizes[lang] = sum(len(pack.compress(plain[i : i + language_id.BLOCK_CHARS].encode())) for i in at)
            best = min(content, key=lambda lang: (sizes[lang], list(content).index(lang)))
            following = min(n for lang, n in sizes.items() if lang != best)
            lead = (following - sizes[best]) / following
            if lead >= language_id.UNSURE:
                break
        return best, lead

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, round(r.score, 12), r.rejected) for r in language_id.language_of(docs, content).collect()}
    want = {}
    for i, t in enumerate(texts):
        lang, lead = direct(t)
        want[i] = (lang, round(lead, 12), lead < language_id.NARROW or lang == "und")
    assert got == want and len({w[0] for w in want.values()}) > 2


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8])
def test_shingle_hashes_are_those_of_each_window(width):
    lines = ["a", "abcdefg", "xabcdefg", "é漢🙂" * 5, "ab", "abcdefgabcdefg"]
    h, owner = line_dedup._shingle_hashes(lines, width)
    seen = {}
    for i, line in enumerate(lines):
        mine = h[owner == i].tolist()
        windows = [line[k : k + width] for k in range(max(1, len(line) - width + 1))]
        assert len(mine) == len(windows)
        for window, number in zip(windows, mine, strict=True):
            assert seen.setdefault(window, number) == number
    assert len(set(seen.values())) == len(seen)
    codes = np.arange(1, 30, dtype=np.uint64)
    for at, got in enumerate(line_dedup._windows(codes, width).tolist()):
        want = 0
        for c in codes[at : at + width].tolist():
            want = (want * 0x9E3779B97F4A7C15 + c) % (1 << 64)
        assert got == want


def odd_lines():
    """Pairs of near copies over few and over many code points, and lines shorter than a shingle."""
    rng = np.random.default_rng(23)
    few, many = list("abc é\0"), [chr(c) for c in range(0x4E00, 0x4E00 + 900)] + ["🙂", "a", "\0"]
    lines = ["a", "ab", "ab\0", "\0", "abcdefg", "abcdef\0", "abcdefga"]
    for letters in (few, many):
        for _ in range(25):
            line = [letters[i] for i in rng.integers(len(letters), size=rng.integers(8, 120))]
            lines.append("".join(line))
            line[rng.integers(len(line))] = "z"
            lines.append("".join(line))
    return lines


@pytest.mark.parametrize("wide", [False, True])
def test_similarity_of_lines_is_exact(wide):
    lines = [x for x in odd_lines() if wide or max(x) < "Ā"]
    assert (len(set("".join(lines))) > 1 << 64 // line_dedup.SHINGLE) == wide
    sets = line_dedup.ShingleSets(lines)
    plain = [line_dedup.shingles(x) for x in lines]
    found = 0
    for i, j in itertools.product(range(len(lines)), repeat=2):
        want = line_dedup.jaccard(plain[i], plain[j])
        assert sets.similar(i, j, want)
        assert not sets.similar(i, j, want + 1e-9)
        found += i != j and want >= line_dedup.SIMILARITY
    assert found > 10


def test_candidates_are_compared_without_sets_of_texts(monkeypatch):
    """Building a set of strings for each candidate took most of the comparison's time."""
    lines = template_lines(200)
    at = np.array(list(itertools.combinations(range(len(lines)), 2)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(at[:, 0]), pa.array([lines[i] for i in at[:, 0]]), pa.array(at[:, 1]), pa.array([lines[i] for i in at[:, 1]])],
        ["src", "a", "dst", "b"],
    )
    sets = [line_dedup.shingles(x) for x in lines]
    similar = lambda i, j: line_dedup.jaccard(sets[i], sets[j]) >= line_dedup.SIMILARITY
    want = components(len(lines), similar)
    monkeypatch.setattr(line_dedup, "shingles", None)
    given = [tuple(x.values()) for b in line_dedup._similar(line_dedup.SIMILARITY)([batch]) for x in b.to_pylist()]
    blocks = line_dedup.connecting(lines, [0] * len(lines))
    for links in (given, blocks):
        assert all(similar(i, j) for i, j in links)
        assert same_partition(want, components(len(lines), lambda i, j: (i, j) in links))  # noqa: B023
    assert 1 < len(set(want)) < len(lines)


def test_signing_in_parts_changes_nothing(monkeypatch):
    lines = odd_lines() + template_lines(60)
    whole = line_dedup.signatures(lines), *line_dedup.sketches(lines)
    monkeypatch.setattr(line_dedup, "PART_CHARS", 200)
    assert len(list(line_dedup._parts(lines))) > 20
    parts = line_dedup.signatures(lines), *line_dedup.sketches(lines)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
