"""How far the sources of a language differ in their words, counted through a transducer of the kept vocabulary.

1. Each task counts, chunk by chunk, in how many documents a term occurs; Spark adds the counts up. A language keeps the
   terms of enough documents, numbered in byte order.
2. A minimal acyclic transducer is built of each language's sorted terms. The texts stream through it once more, all
   terms of a chunk taking each step together, and tasks add up occurrences for each (source, ordinal).
3. Rates are exact integers. A pair of sources differs in a block of ordinals by what its counts add to the difference
   of the rates of absent terms, so only terms that occur are touched. Sources are dealt in tiles: a task
   meets the counts of two tiles in one block. Ordinals decide between equal values.

The transducers travel to the tasks while all vocabularies together have at most ``MOST_TERMS`` terms, which is counted
first; beyond, the terms' counts are joined with the vocabulary by Spark instead. The result is the same.

* Null texts, languages and sources are ''. A language without kept terms has pairs of value 0 and no terms.
* Repeated rows and ids are documents of their own; ids are not read. Extra columns are ignored. No rows: no rows.
* Texts are never cut; memory is some fifty times the longest text, or that of a chunk of 2 MB.
* Within a chunk, terms are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dwellgrid.operators.numbering import number_in_groups
from llm.arrays import chunks, lowered, prefix_sums, span_hashes, text_bytes, word_spans
from llm.tables import cut
from llm.transducer import Transducer

#: Documents of a language that a kept term occurs in.
LEAST_DOCS = 30
#: Terms of all languages whose transducers travel to the tasks: some 30 MB.
MOST_TERMS = 1_000_000
#: Added to every count.
PRIOR = 5
#: Terms of a source that are reported.
TOP = 50
#: Sources of a tile, and ordinals of a block: a task's part of the comparison of sources.
TILE, BLOCK = 128, 2048
#: Different (group, ordinal) a task adds up before it hands them on.
HELD_COUNTS = 500_000
CHUNK_BYTES = 2 << 20

# A blank for all bytes that are in no term; bytes of terms with A-Z lowered.
_TERM = lowered(np.arange(256, dtype=np.uint8))
_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def _filled(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    names = {"lang": lang_col, "source": source_col, "text": text_col}
    return docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in names.items()]
    )


def _terms(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, document of each) of a chunk's terms."""
    values, offsets = text_bytes(chunk.column("text"))
    values = _TERM[values]
    starts, ends, first = word_spans(values, offsets)
    return values, starts, ends, np.repeat(np.arange(chunk.num_rows), np.diff(first))


def _codes(*columns: pa.Array) -> tuple[np.ndarray, list[tuple[str, ...]]]:
    """A number for each row's values, and the values of each number."""
    seen: dict[tuple[str, ...], int] = {}
    rows = zip(*(c.to_pylist() for c in columns), strict=True)
    codes = np.array([seen.setdefault(row, len(seen)) for row in rows], np.int64)
    return codes, list(seen)


def _heads(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where, in sorted order, one of the keys differs from the row before."""
    head = np.ones(len(order), bool)
    head[1:] = False
    for key in keys:
        key = key[order]
        head[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(head)


def _words_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    data = pa.py_buffer(values[at].tobytes())
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), data])
    return words.cast(pa.string())


def _document_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n_docs) of each chunk."""
    for chunk in chunks(batches, "text", CHUNK_BYTES):
        values, starts, ends, doc = _terms(chunk)
        langs, names = _codes(chunk.column("lang"))
        h = span_hashes(prefix_sums(values), starts, ends)
        order = np.lexsort((doc, h))
        order = order[_heads(order, h, doc)]  # one occurrence for each document
        order = order[np.lexsort((h[order], langs[doc[order]]))]
        at = _heads(order, langs[doc], h)
        first = order[at]
        counts = np.diff(np.append(at, len(order)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.list_(pa.string())).flatten().take(pa.array(langs[doc[first]])),
                _words_of(values, starts[first], ends[first]),
                pa.array(counts, pa.int64()),
            ],
            ["lang", "term", "n_docs"],
        )


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n) of each chunk."""
    for chunk in chunks(batches, "text", CHUNK_BYTES):
        values, starts, ends, doc = _terms(chunk)
        groups, names = _codes(chunk.column("lang"), chunk.column("source"))
        h = span_hashes(prefix_sums(values), starts, ends)
        order = np.lexsort((h, groups[doc]))
        at = _heads(order, groups[doc], h)
        first = order[at]
        codes = groups[doc[first]].tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[c][0] for c in codes], pa.string()),
                pa.array([names[c][1] for c in codes], pa.string()),
                _words_of(values, starts[first], ends[first]),
                pa.array(np.diff(np.append(at, len(order))), pa.int64()),
            ],
            ["lang", "source", "term", "n"],
        )


def kept_terms(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(lang, term, ordinal) of the terms in at least ``least_docs`` documents of a language; ordinals from 1."""
    filled = _filled(docs, lang_col, source_col, text_col).select("lang", "text")
    counted = filled.mapInArrow(_document_counts, "lang string, term string, n_docs long")
    kept = cut(
        counted.groupBy("lang", "term")
        .agg(F.sum("n_docs").alias("n_docs"))
        .filter(F.col("n_docs") >= least_docs)
        .select("lang", "term")
    )
    return cut(number_in_groups(kept, ["lang"], ["term"], "ordinal").withColumn("ordinal", F.col("ordinal").cast("long")))


def _built(table: pa.Table) -> pa.Table:
    """One language's transducer; terms come in any order."""
    made = Transducer.of(sorted(t.encode() for t in table.column("term").to_pylist()))
    row = {"lang": table.column("lang")[0].as_py(), "root": made.root, **made.as_bytes()}
    return pa.Table.from_pylist([row])


def transducers(vocabulary: DataFrame) -> dict[str, tuple[int, dict[str, bytes]]]:
    """Each language's transducer, built by its own task; only for a vocabulary of a checked size."""
    parts = ", ".join(f"{name} binary" for name in Transducer.FIELDS)
    built = vocabulary.groupBy("lang").applyInArrow(_built, f"lang string, root long, {parts}")
    return {r.lang: (r.root, {name: bytes(r[name]) for name in Transducer.FIELDS}) for r in built.collect()}


class _Sums:
    """Counts by (group, ordinal) that a task adds up."""

    def __init__(self):
        self._groups: dict[tuple[str, str], int] = {}
        self._keys, self._counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: list[tuple[str, str]], groups: np.ndarray, ordinals: np.ndarray) -> None:
        codes = np.array([self._groups.setdefault(n, len(self._groups)) for n in names], np.int64)
        new, counts = np.unique((codes[groups] << 32) | ordinals, return_counts=True)
        both = np.concatenate([self._keys, new])
        self._keys, to = np.unique(both, return_inverse=True)
        sums = np.zeros(len(self._keys), np.int64)
        # The keys on each side are different, so plain indexing adds each once.
        sums[to[: len(both) - len(new)]] += self._counts
        sums[to[len(both) - len(new) :]] += counts
        self._counts = sums

    def __len__(self):
        return len(self._keys)

    def batch(self) -> pa.RecordBatch:
        names = list(self._groups)
        codes = (self._keys >> 32).tolist()
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([names[c][0] for c in codes], pa.string()),
                pa.array([names[c][1] for c in codes], pa.string()),
                pa.array((self._keys & 0xFFFFFFFF) + 1, pa.int64()),
                pa.array(self._counts, pa.int64()),
            ],
            ["lang", "source", "ordinal", "n"],
        )
        self.__init__()
        return out


def _recount(shared):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {lang: Transducer.from_bytes(root, parts) for lang, (root, parts) in shared.value.items()}
        sums = _Sums()
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            values, starts, ends, doc = _terms(chunk)
            groups, names = _codes(chunk.column("lang"), chunk.column("source"))
            of_term = groups[doc]
            lang_of = np.array([n[0] for n in names], object)
            for lang in dict.fromkeys(n[0] for n in names):
                if lang in ready:
                    own = np.flatnonzero((lang_of == lang)[of_term])
                    ordinals = ready[lang].ordinals(values, starts[own], ends[own])
                    hit = ordinals >= 0
                    sums.add(names, of_term[own[hit]], ordinals[hit])
            if len(sums) > HELD_COUNTS:
                yield sums.batch()
        yield sums.batch()

    return count


def occurrences(
    docs: DataFrame,
    vocabulary: DataFrame,
    most_terms: int = MOST_TERMS,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(lang, source, ordinal, n) of the kept terms that occur in a (lang, source)."""
    filled = _filled(docs, lang_col, source_col, text_col)
    if vocabulary.limit(most_terms + 1).count() <= most_terms:
        shared = docs.sparkSession.sparkContext.broadcast(transducers(vocabulary))
        found = filled.mapInArrow(_recount(shared), "lang string, source string, ordinal long, n long")
    else:
        counted = filled.mapInArrow(_term_counts, "lang string, source string, term string, n long")
        by_term = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        found = by_term.join(vocabulary, ["lang", "term"]).select("lang", "source", "ordinal", "n")
    return cut(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))


def _rate(n: Column | str, total: Column | str, size: Column | str) -> Column:
    """``1 + floor(10^9 * (n + 5) / (total + 5 * size))`` in whole numbers of any size; null for an empty vocabulary."""
    n, total, size = (F.col(c) if isinstance(c, str) else c for c in (n, total, size))
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    below = (total + PRIOR * size).cast("decimal(19,0)")
    return F.when(size > 0, F.lit(1) + F.call_function("div", above, below))


def _tile_sums(table: pa.Table, size: int) -> pa.Table:
    """What the counts of a block add to the differences of each two groups of two tiles of ``size`` groups."""
    num, ordinal, p = (table.column(c).to_numpy() for c in ("num", "ordinal", "p"))
    ta, tb = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
    base = ordinal == 0
    groups = np.sort(num[base])
    absent = p[base][np.argsort(num[base])]
    terms, column = np.unique(ordinal[~base], return_inverse=True)
    rates = np.repeat(absent[:, None], len(terms), axis=1)
    rates[np.searchsorted(groups, num[~base]), column] = p[~base]
    tile = (groups - 1) // size
    a_side, b_side = np.flatnonzero(tile == ta), np.flatnonzero(tile == tb)
    out = []
    for a in a_side.tolist():
        b = b_side[b_side > a]
        if len(b):
            sums = np.abs(rates[b] - rates[a]).sum(axis=1) - len(terms) * np.abs(absent[b] - absent[a])
            out.append((np.full(len(b), groups[a]), groups[b], sums))
    a, b, sums = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((),) * 3))
    lang = pa.array([table.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "part": pa.array(sums, pa.int64())})


def _source_pairs(groups: DataFrame, counts: DataFrame, tile: int, block: int) -> DataFrame:
    """(lang, source, item, value, item_num) for each two sources of a language."""
    tiles = groups.groupBy("lang").agg((F.max(F.expr(f"(num - 1) div {tile}")) + 1).alias("tiles"))
    placed = groups.join(tiles, "lang").withColumn("tile", F.expr(f"(num - 1) div {tile}"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {block}")))
    base = placed.filter("size > 0").select(
        "lang", "num", "tile", "tiles", F.lit(0).cast("long").alias("ordinal"), F.col("p0").alias("p"), blocks.alias("block")
    )
    rows = counts.join(placed.select("lang", "source", "num", "tile", "tiles"), ["lang", "source"]).select(
        "lang", "num", "tile", "tiles", "ordinal", "p", F.expr(f"(ordinal - 1) div {block}").alias("block")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = base.unionByName(rows).withColumn("other", other)
    sums = (
        dealt.select(
            "lang", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "block", "num", "ordinal", "p"
        )
        .groupBy("lang", "ta", "tb", "block")
        .applyInArrow(lambda t: _tile_sums(t, tile), "lang string, a long, b long, part long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("part").alias("part"))
    )
    # Every two sources, tile by tile.
    side = placed.select("lang", "source", "num", "tile", "tiles", "p0", "size").withColumn("other", other)
    left = side.filter("tile <= other").select(
        "lang", F.col("tile").alias("ta"), F.col("other").alias("tb"), F.col("num").alias("a"),
        F.col("source").alias("a_source"), F.col("p0").alias("a_p0"), "size",
    )
    right = side.filter("other <= tile").select(
        "lang", F.col("other").alias("ta"), F.col("tile").alias("tb"), F.col("num").alias("b"),
        F.col("source").alias("b_source"), F.col("p0").alias("b_p0"),
    )
    pairs = left.join(right, ["lang", "ta", "tb"]).filter("a < b").join(sums, ["lang", "a", "b"], "left")
    plain = F.col("size") * F.abs(F.col("a_p0") - F.col("b_p0"))
    value = F.coalesce(plain + F.coalesce("part", F.lit(0).cast("long")), F.lit(0).cast("long"))
    both = F.array(
        F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item"), F.col("b").alias("item_num")),
        F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"), F.col("a").alias("item_num")),
    )
    return pairs.select("lang", value.alias("value"), F.inline(both))


def divergence(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    most_terms: int = MOST_TERMS,
    tile: int = TILE,
    block: int = BLOCK,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank): sources by difference, and terms that a source overuses."""
    names = {"lang_col": lang_col, "source_col": source_col, "text_col": text_col}
    vocabulary = kept_terms(docs, least_docs, **names)
    counts = occurrences(docs, vocabulary, most_terms, **names)
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    occurring = cut(_filled(docs, **names).select("lang", "source").distinct())
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = (
        occurring.join(sizes, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("size", zero).alias("size"), F.coalesce("total", zero).alias("total"))
    )
    groups = groups.withColumn("p0", _rate(zero, "total", "size"))
    groups = cut(number_in_groups(groups, ["lang"], ["source"], "num").withColumn("num", F.col("num").cast("long")))
    rated = cut(
        counts.join(groups.select("lang", "source", "total", "size"), ["lang", "source"]).select(
            "lang", "source", "ordinal", _rate("n", "total", "size").alias("p")
        )
    )
    whole = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(sizes, "lang")
    expected = (
        counts.groupBy("lang", "ordinal")
        .agg(F.sum("n").alias("n"))
        .join(whole, "lang")
        .select("lang", "ordinal", _rate("n", "total", "size").alias("q"))
    )
    overused = rated.join(expected, ["lang", "ordinal"]).filter("p > q").select(
        "lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value")
    )
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    terms = (
        overused.withColumn("rank", F.row_number().over(by_value))
        .filter(F.col("rank") <= top)
        .join(vocabulary, ["lang", "ordinal"])
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )
    pairs = number_in_groups(
        _source_pairs(groups, rated, tile, block), ["lang", "source"], [F.desc("value"), "item_num"], "rank"
    ).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.col("rank").cast("int"))
    return pairs.unionByName(terms)


#: DuckDB SQL for the rows of ``divergence`` over ``documents``.
ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), t AS (
    SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), v AS (
    SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), size AS (
    SELECT lang, count(*) AS v FROM v GROUP BY lang
), c AS (
    SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL
), g AS (
    SELECT d.lang, d.source, coalesce(any_value(size.v), 0) AS v FROM d LEFT JOIN size ON size.lang = d.lang GROUP BY d.lang, d.source
), filled AS (
    SELECT g.lang, g.source, g.v, v.term, coalesce(c.n, 0) AS n
    FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), p AS (
    SELECT lang, source, term, n,
           1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
    FROM filled
), q AS (
    SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
    FROM filled GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
    FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
