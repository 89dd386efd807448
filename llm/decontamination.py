"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask that looks at some positions of a span of words and ignores the rest, so that a replaced
word breaks only the seeds that look at it. Hashes of all masks at all places of documents and benchmark items
are joined. Around each hit, document and item are compared word by word along the hit's diagonal; an overlap
counts if it has ``MIN_WORDS`` words (or the whole item, if shorter) of which ``MIN_EQUAL`` are equal.

The seeds miss no such overlap, whichever words are replaced. One of 24 words or more has a part of 12 to 23 words
in which as many are equal, and in each of these, with up to 2 (of 12), 3 (of 15) or 4 (of 20) replaced words at any
places, some mask fits somewhere. For a shorter item there is a mask to ignore each choice of as many fifths of its
words as may be replaced.

A 2 MB bitmap of the item hashes drops nearly all document hashes inside the scan; the join decides on the rest.
Only documents with a hit are read a second time.

* Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Null texts have no words.
* Items of less than ``MIN_WORDS`` words must be in a document as a whole; items under ``LEAST_ITEM`` words are no evidence and never match.
* Items with equal words are compared once and reported under each id. Repeated documents are reported by id,
  once. Null ids of documents are reported as null. Empty tables: no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import chunks, lowered, prefix_sums, span_hashes, text_bytes, window_hashes, word_spans
from llm.bitmap import bitmap_of, is_set, may_hold
from llm.tables import cut, texts

#: 1: the word counts, 0: it is ignored. Chosen greedily until every pattern of replaced words was covered.
MASKS = ("11110111", "110100010111", "11101100011", "110111011", "111000100111", "101011111", "11110001011")
MIN_WORDS = 12
MIN_EQUAL = 0.8
LEAST_ITEM = 5
#: Parts of a short item, of which a mask ignores as many as words may be replaced.
PARTS = 5


def _shapes(lengths: list[int]) -> list[tuple[int, list[int]]]:
    """(span, positions looked at) of every seed: the masks, and those of the items that are shorter than an overlap."""
    shapes = [(len(mask), [i for i, c in enumerate(mask) if c == "1"]) for mask in MASKS]
    for n in lengths:
        for ignored in itertools.combinations(range(PARTS), int((1 - MIN_EQUAL) * n + 1e-9)):
            shapes.append((n, [i for i in range(n) if i * PARTS // n not in ignored]))
    return shapes


def _seeds(column: pa.Array, shapes: list[tuple[int, list[int]]], keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word number in it, hash) of the seeds of all texts for which ``keep(hash, ...)`` holds."""
    values, offsets = text_bytes(column)
    values = lowered(values)
    starts, ends, firsts = word_spans(values, offsets)
    words = span_hashes(prefix_sums(values), starts, ends)
    text_of = np.repeat(np.arange(len(column)), np.diff(firsts))
    found = []
    for number, (span, shape) in enumerate(shapes):
        if len(words) < span:
            continue
        # Every seed has one more, constant, part so that seeds of different masks never meet.
        n = len(words) - span + 1
        h = window_hashes(words, shape)[:n] ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64)
        at = np.flatnonzero((text_of[:n] == text_of[span - 1 :]) & keep(h, number, text_of[:n]))
        found.append((text_of[at], at - firsts[text_of[at]], h[at]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _rows(ids: pa.Array, text_no: np.ndarray, pos: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(text_no)), pa.array(pos, pa.int64()), pa.array(h.view(np.int64))], ["key", "pos", "h"]
    )


def _item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    shapes = _shapes(lengths)

    def seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            size = chunk.column(2).to_numpy(zero_copy_only=False)

            def own(h, number, text_no, size=size):
                span = shapes[number][0]
                return size[text_no] >= MIN_WORDS if number < len(MASKS) else size[text_no] == span

            yield _rows(chunk.column(0), *_seeds(chunk.column(1), shapes, own))

    return items.select("key", "text", "n").mapInArrow(seeds, "key long, pos long, h long")


def _document_seeds(docs: DataFrame, lengths: list[int], bits: bytes) -> DataFrame:
    shapes = _shapes(lengths)

    def seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            yield _rows(chunk.column(0), *_seeds(chunk.column(1), shapes, lambda h, *_: is_set(bits, h)))

    return docs.select("key", "text").mapInArrow(seeds, "key long, pos long, h long")


def best_overlap(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch (start, end) of which at least ``share`` is true; of equally long ones the first."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share, -share))]) + 1e-9 * np.arange(len(equal) + 1)
    lowest = np.minimum.accumulate(sums)
    best = (0, 0)
    # For each end, the earliest start with a prefix that is not larger.
    starts = np.searchsorted(-lowest, -sums, side="left")
    lengths = np.arange(len(sums)) - starts
    end = int(lengths.argmax())
    return (int(starts[end]), end) if lengths[end] > 0 else best


def _words(text: str) -> list[bytes]:
    return lowered(np.frombuffer(text.encode(), np.uint8)).tobytes().split()


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        last, words = None, []
        for key, text, item_key, item, shifts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text is not last:
                last, words = text, _words(text)
            wanted, best = _words(item), None
            for shift in shifts:
                first, stop = max(0, -shift), min(len(wanted), len(words) - shift)
                equal = np.array([words[shift + j] == wanted[j] for j in range(first, stop)], bool)
                a, b = best_overlap(equal, MIN_EQUAL)
                found = (b - a, int(equal[a:b].sum()), -(shift + first + a), -(first + a))
                best = max(best or found, found)
            if best and best[0] >= min(len(wanted), MIN_WORDS):
                out.append((key, item_key, -best[2], -best[3], best[0], best[1]))
        columns = zip(*out, strict=True) if out else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in columns],
            ["key", "item_key", "doc_word", "item_word", "n_words", "n_equal"],
        )


def _leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_key, doc_word, item_word, n_words, n_equal); both inputs are (key, text)."""
    # One row for each different item; how many words it has.
    sized = items.withColumn("n", F.size(F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")))
    sized = sized.filter(F.col("n") >= LEAST_ITEM)
    lengths = sorted(r.n for r in sized.filter(F.col("n") < MIN_WORDS).select("n").distinct().collect())
    seeds = cut(_item_seeds(sized, lengths))
    hits = _document_seeds(docs, lengths, bitmap_of(seeds, "h"))
    met = hits.join(seeds.select("h", F.col("key").alias("item_key"), F.col("pos").alias("item_pos")), "h")
    # All hits on one diagonal are one comparison.
    shifts = (
        met.select("key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .distinct()
        .groupBy("key", "item_key")
        .agg(F.sort_array(F.collect_list("shift")).alias("shifts"))
    )
    shifts = cut(shifts)
    again = docs.filter(may_hold(bitmap_of(shifts, "key"))("key")).dropDuplicates(["key"])
    joined = (
        shifts.join(sized.select(F.col("key").alias("item_key"), F.col("text").alias("item")), "item_key")
        .join(again, "key")
        .select("key", "text", "item_key", "item", "shifts")
    )
    return joined.mapInArrow(
        _verify, "key long, item_key long, doc_word long, item_word long, n_words long, n_equal long"
    )


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text); the key stands for id and text together."""
    return texts(df, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): the longest overlap of each pair that has one."""
    keyed, items, pairs = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    names = keyed.select("key", "doc_id").distinct().filter(may_hold(bitmap_of(pairs, "key"))("key"))
    return pairs.join(names, "key").join(items, "item_key").select(
        "doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"
    )


def _found(docs, benchmark, id_col, text_col, item_col, item_text_col) -> tuple[DataFrame, DataFrame, DataFrame]:
    keyed = _keyed(docs, id_col, text_col)
    lower = F.translate(F.col(item_text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"),
        F.trim(F.regexp_replace(lower, "[\\x20\\x09-\\x0D]+", " ")).alias("text"),
    ).filter("text IS NOT NULL")
    named = named.withColumn("key", F.xxhash64("text"))
    pairs = cut(_leaks(keyed, named.select("key", "text").dropDuplicates(["key"])))
    return keyed, named.select(F.col("key").alias("item_key"), "item_id").distinct(), pairs


def without_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"
) -> DataFrame:
    """The rows of ``docs`` that overlap no item, as they are."""
    _, _, pairs = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    leaked = pairs.select(F.col("key").alias("__row_key")).distinct()
    columns = docs.columns
    marked = docs.withColumn("__row_key", key).withColumn(
        "__may", may_hold(bitmap_of(leaked, "__row_key"))("__row_key")
    )
    # Only what the bitmap leaves open takes part in the join; all other texts stay where they are.
    sure = marked.filter(~F.col("__may"))
    open_ = marked.filter("__may").join(leaked, "__row_key", "left_anti")
    return sure.select(*[f"`{c}`" for c in columns]).unionByName(open_.select(*[f"`{c}`" for c in columns]))
