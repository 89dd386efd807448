"""Passages repeated across documents, found by parsing relative to indexed reference blocks.

A window is a number of consecutive words. Its anchor is the seed (a few words) with the least hash in it, the first
of equals: equal windows have equal anchors. Consecutive windows with one anchor form a piece of text.

1. A scan gives a row for each piece: its anchor, a hash of its words, its document and place. Spark keeps the anchors
   that occur in two documents and, of equal pieces, the first document. A piece that an earlier document holds
   as a whole is a repetition as it stands; no words are moved for it.
2. What is left are different pieces with a common anchor. The first holder of each hands over the words. All pieces of
   an anchor are a reference block: an index of its phrases of one window's length, in the order of documents. Each
   piece is factored greedily against what precedes it in the block: the next phrase in the index is extended word by
   word as far as its source goes on; the search resumes at the first window that crosses the factor's end.
   A block belongs to one task, which takes many blocks at once; factors of a window's length or more are repetitions.
3. An anchor with more than ``BLOCK_PIECES`` different pieces (a passage that stands in very many contexts) would
   make an unbounded block. The windows of its pieces are keyed by themselves instead, and Spark takes the first
   document of each: same result, any size.
4. The spans of a document meet its text once more; covered words go.

Documents are known by id and a 64-bit hash of their text together. Every comparison of words is one of 64-bit
hashes of all words in it.

* A null text has no words. A document without id neither repeats another nor is repeated.
* Equal ids are no smaller than each other: rows that share an id don't repeat each other. Repeated rows give
  repeated results. A passage repeated only inside a document stays.
* Texts shorter than a window stay, with words joined by single blanks. Extra columns are ignored. No rows: no rows.
* Texts are never cut; a long one is read in blocks, and takes some twelve bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import chunks, mixed, prefix_sums, span_hashes, text_bytes, window_hashes, word_spans
from llm.tables import cut, texts

WINDOW = 50
#: Words of an anchor.
SEED = 8
#: Different pieces of an anchor that make a block for one task.
BLOCK_PIECES = 512
#: Words of whole blocks that a task factors at a time.
TASK_WORDS = 1 << 20
#: Bytes, and words, of a long text that are worked on at a time.
READ_BYTES, READ_WORDS = 1 << 21, 1 << 19

_PLACE_BITS = 20  # of a place among READ_WORDS words and a window
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

_MARKS = "key long, shape long, doc_id long, th long, start int, n int"
_SPANS = "key long, shape long, spans array<struct<at:int,length:int>>"


def _block_ends(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about READ_BYTES that end behind a blank."""
    at = 0
    while at < len(values):
        stop = at + READ_BYTES
        while stop < len(values):
            blanks = np.flatnonzero(_BLANK[values[stop : stop + READ_BYTES]])
            if len(blanks):
                stop += int(blanks[0]) + 1
                break
            stop += READ_BYTES
        yield at, min(stop, len(values))
        at = stop


def _hashed_words(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of all words, and each text's first word (and one for the end)."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a, b in _block_ends(values):
        inside = np.unique(np.clip(offsets - a, 0, b - a))
        starts, ends, _ = word_spans(values[a:b], np.union1d(inside, [0, b - a]))
        h = span_hashes(prefix_sums(values[a:b]), starts, ends)
        parts.append((starts + a, ends + a, h))
    starts, ends, h = (np.concatenate(p) for p in zip(*parts, strict=True))
    return starts, ends, h, np.searchsorted(starts, offsets)


def _least_in_windows(grams: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbours stands; equals are settled by place."""
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: reach - width], low[width - reach :])
    return (low & _PLACE).astype(np.int64)


def _pieces(words: np.ndarray, first: np.ndarray, window: int, seed: int):
    """(anchor hash, content hash, first word, windows) of the pieces of all texts, in blocks of words."""
    text_end = np.repeat(first[1:], np.diff(first))
    for lo in range(0, len(words), READ_WORDS):
        part = words[lo : lo + READ_WORDS + window - 1]
        if len(part) < window:
            break
        grams = window_hashes(part, range(seed))
        anchor = _least_in_windows(grams, window - seed + 1)
        whole = np.arange(len(anchor)) + (lo + window) <= text_end[lo : lo + len(anchor)]
        breaks = np.ones(len(anchor) + 1, bool)
        breaks[1:-1] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
        heads = np.flatnonzero(breaks)
        starts, n = heads[:-1], np.diff(heads)
        starts, n = starts[whole[starts]], n[whole[starts]]
        shape = span_hashes(prefix_sums(part), starts, starts + n + (window - 1))
        yield grams[anchor[starts]], mixed(shape ^ n.astype(np.uint64)), starts + lo, n


def _marks(window: int, seed: int):
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            values, offsets = text_bytes(chunk.column("text"))
            _, _, words, first = _hashed_words(values, offsets)
            doc_id, th = (chunk.column(c).to_numpy() for c in ("doc_id", "th"))
            for key, shape, start, n in _pieces(words, first, window, seed):
                text = np.searchsorted(first, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(shape.view(np.int64)),
                        pa.array(doc_id[text]),
                        pa.array(th[text]),
                        pa.array((start - first[text]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["key", "shape", "doc_id", "th", "start", "n"],
                )

    return mark


def _handed_over(window: int):
    """(key, shape, doc_id, crowded, words) of the pieces that are asked of each text; words as 64-bit hashes."""

    def hand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            values, offsets = text_bytes(chunk.column("text"))
            _, _, words, first = _hashed_words(values, offsets)
            asked = chunk.column("asked")
            each = np.diff(asked.offsets.to_numpy())
            fields = asked.flatten()
            start, n = (fields.field(c).to_numpy() for c in ("start", "n"))
            at = start + np.repeat(first[:-1], each)
            data = [words[a : a + m].tobytes() for a, m in zip(at.tolist(), (n + window - 1).tolist(), strict=True)]
            doc_id = np.repeat(chunk.column("doc_id").to_numpy(), each)
            yield pa.RecordBatch.from_arrays(
                [*map(fields.field, ("key", "shape")), pa.array(doc_id), fields.field("crowded"), pa.array(data, pa.binary())],
                ["key", "shape", "doc_id", "crowded", "words"],
            )

    return hand


def factored(words: np.ndarray, ends: np.ndarray, block: np.ndarray, doc: np.ndarray, window: int) -> tuple:
    """(piece, first word in it, length) of the factors of at least ``window`` words.

    Pieces are given one behind the other with the number of their block and their document; those of a block follow
    each other in the order of documents. A factor's source is a piece of the same block and a smaller document.
    """
    begins = np.concatenate([[0], ends[:-1]])
    n = ends - begins - (window - 1)
    piece = np.repeat(np.arange(len(n)), n)
    first_window = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first_window[-1]) - np.repeat(first_window[:-1] - begins, n)
    # The index: equal phrases of a block side by side, the earliest document first.
    phrase = mixed(span_hashes(prefix_sums(words), at, at + window) + mixed(block.astype(np.uint64))[piece])
    order = np.lexsort((piece, phrase))
    head = np.ones(len(order), bool)
    head[1:] = phrase[order[1:]] != phrase[order[:-1]]
    source = np.empty(len(order), np.int64)
    source[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    found = doc[piece[source]] < doc[piece]
    # The next found phrase at or behind each window.
    none = len(order)
    following = np.append(np.where(found, np.arange(none), none), none)
    following = np.minimum.accumulate(following[::-1])[::-1]
    reach = np.arange(int((ends - begins).max(initial=0)))
    out = []
    cursor, live = first_window[:-1].copy(), np.arange(len(n))
    while len(live):
        here = following[np.minimum(cursor, none)]
        go = here < first_window[live + 1]
        here, live = here[go], live[go]
        length = np.empty(len(here), np.int64)
        for lo in range(0, len(here), 1 << 14):
            own = here[lo : lo + (1 << 14)]
            p, s = at[own], at[source[own]]
            most = np.minimum(ends[piece[own]] - p, ends[piece[source[own]]] - s)
            inside = reach < most[:, None]
            x = words[np.minimum(p[:, None] + reach, len(words) - 1)]
            y = words[np.minimum(s[:, None] + reach, len(words) - 1)]
            length[lo : lo + (1 << 14)] = ((x == y) & inside).cumprod(axis=1).sum(axis=1)
        long = length >= window
        out.append((live[long], at[here[long]] - begins[live[long]], length[long]))
        cursor = here + np.maximum(length - (window - 1), 1)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _spans_batch(key: list, shape: list, piece: np.ndarray, at: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((at, piece))
    piece, at, length = piece[order], at[order], length[order]
    hit, heads = np.unique(piece, return_index=True)
    spans = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(length, pa.int32())], ["at", "length"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(piece)), pa.int32()), spans)
    return pa.RecordBatch.from_arrays(
        [pa.array([key[i] for i in hit], pa.int64()), pa.array([shape[i] for i in hit], pa.int64()), lists],
        ["key", "shape", "spans"],
    )


def _parsed(window: int, task_words: int):
    """Factors of the blocks of a task, crowded ones left out; rows come sorted by anchor and document."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shapes, docs, data, held = [], [], [], [], 0

        def blocks():
            words = np.frombuffer(b"".join(data), np.uint64)
            ends = np.cumsum([len(d) // 8 for d in data])
            block = np.cumsum(np.append(0, np.diff(np.array(keys, np.int64)) != 0))
            return _spans_batch(keys, shapes, *factored(words, ends, block, np.array(docs, np.int64), window))

        for batch in batches:
            batch = batch.filter(pc.invert(batch.column("crowded")))
            columns = (batch.column(c).to_pylist() for c in ("key", "shape", "doc_id", "words"))
            for key, shape, doc_id, words in zip(*columns, strict=True):
                if keys and key == keys[-1] and shape == shapes[-1]:
                    continue  # a repeated row
                if held >= task_words and key != keys[-1]:
                    yield blocks()
                    keys, shapes, docs, data, held = [], [], [], [], 0
                keys.append(key)
                shapes.append(shape)
                docs.append(doc_id)
                data.append(words)
                held += len(words) // 8
        if keys:
            yield blocks()

    return parse


def _windows(window: int):
    """(key, shape, doc_id, at, phrase) of every window of the crowded pieces."""

    def list_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("crowded"))
            if not batch.num_rows:
                continue
            data = batch.column("words").to_pylist()
            words = np.frombuffer(b"".join(data), np.uint64)
            sizes = np.array([len(d) // 8 for d in data])
            n = sizes - (window - 1)
            at = np.concatenate([np.arange(k) for k in n])
            start = at + np.repeat(np.cumsum(sizes) - sizes, n)
            phrase = span_hashes(prefix_sums(words), start, start + window)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("key", "shape", "doc_id")],
                    pa.array(at.astype(np.int32)),
                    pa.array(phrase.view(np.int64)),
                ],
                ["key", "shape", "doc_id", "at", "phrase"],
            )

    return list_windows


def _factors(known: DataFrame, members: DataFrame, window: int, block_pieces: int) -> DataFrame:
    """(key, shape, spans) of the pieces whose first holder repeats an earlier document in part.

    Both ways read the same dealt pieces and leave out the other's themselves: a filter would be
    pushed below the exchange, and the texts would be dealt for each way again.
    """
    heads = (
        members.filter("doc_id = first_doc AND n_shapes > 1")
        .groupBy("key", "shape")
        .agg(
            F.min(F.struct("doc_id", "th", "start")).alias("of"),
            F.first("n").alias("n"),
            (F.first("n_shapes") > block_pieces).alias("crowded"),
        )
    )
    asked = heads.groupBy(F.col("of.doc_id").alias("own"), F.col("of.th").alias("th")).agg(
        F.collect_list(F.struct("key", "shape", F.col("of.start").alias("start"), "n", "crowded")).alias("asked")
    )
    dealt = (
        known.join(asked, ["own", "th"])
        .select("doc_id", "text", "asked")
        .mapInArrow(_handed_over(window), "key long, shape long, doc_id long, crowded boolean, words binary")
        # Blocks stay together, crowded pieces are spread.
        .repartition(F.when(F.col("crowded"), F.col("shape")).otherwise(F.col("key")))
    )
    by_block = dealt.sortWithinPartitions("key", "doc_id", "shape").mapInArrow(_parsed(window, TASK_WORDS), _SPANS)
    listed = dealt.mapInArrow(_windows(window), "key long, shape long, doc_id long, at int, phrase long")
    earliest = listed.groupBy("key", "phrase").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    hits = listed.join(earliest.filter("first_doc < last_doc"), ["key", "phrase"]).filter("first_doc < doc_id")
    span = F.struct("at", F.lit(window).alias("length"))
    # A set: repeated rows hand over the same pieces.
    by_window = hits.groupBy("key", "shape").agg(F.collect_set(span).alias("spans"))
    return by_block.unionByName(by_window)


def repeated_spans(
    docs: DataFrame,
    window: int = WINDOW,
    seed: int = SEED,
    block_pieces: int = BLOCK_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(own, th, covers) of the documents with repeated passages.

    ``own`` is the id, ``th`` a hash of the text; each cover is ``first word << 32 | words``, covers may overlap.
    """
    known = _known(docs, id_col, text_col)
    marks = cut(known.filter("doc_id IS NOT NULL").select("doc_id", "th", "text").mapInArrow(_marks(window, seed), _MARKS))
    by_shape = marks.groupBy("key", "shape").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    by_key = (
        by_shape.groupBy("key")
        .agg(
            F.min("first_doc").alias("key_first"),
            F.max("last_doc").alias("key_last"),
            F.count(F.lit(1)).alias("n_shapes"),
        )
        .filter("key_first < key_last")
        .select("key", "n_shapes")
    )
    shared = by_shape.join(by_key, "key").select("key", "shape", "first_doc", "n_shapes")
    members = cut(marks.join(shared, ["key", "shape"]))
    span_of = F.shiftleft(F.col("start").cast("long"), 32) + F.col("length")
    whole = members.filter("doc_id > first_doc").select(
        "doc_id", "th", "start", (F.col("n") + window - 1).alias("length")
    )
    parts = (
        members.filter("doc_id = first_doc")
        .join(_factors(known, members, window, block_pieces), ["key", "shape"])
        .select("doc_id", "th", "start", F.inline("spans"))
        .select("doc_id", "th", (F.col("start") + F.col("at")).alias("start"), "length")
    )
    spans = whole.unionByName(parts).groupBy(F.col("doc_id").alias("own"), "th")
    return spans.agg(F.collect_list(span_of).alias("covers"))


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(own, th, doc_id, text): ``own`` and ``th`` tell documents apart and are never null.

    So neither of the two joins by them adds a filter, and Spark deals the texts once for both.
    """
    th = F.xxhash64(F.col("text"), F.col("doc_id").isNull())
    own = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    return texts(docs, id_col, text_col).select(own.alias("own"), th.alias("th"), "doc_id", "text")


def _kept(digests: bool):
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            values, offsets = text_bytes(chunk.column("text"))
            starts, ends, _, first = _hashed_words(values, offsets)
            covers = chunk.column("covers")
            each = np.diff(covers.offsets.to_numpy())
            packed = covers.flatten().to_numpy()
            begin = (packed >> 32) + np.repeat(first[:-1], each)
            depth = np.zeros(len(starts) + 1, np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + (packed & 0xFFFFFFFF), -1)
            stay = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
            n_words = np.diff(first)
            left = np.searchsorted(stay, first)
            # Kept words with one byte behind each; the blank behind a text's last kept word is left out.
            edge = np.zeros(len(values) + 1, np.int8)
            edge[starts[stay]] = 1
            edge[ends[stay]] -= 1
            taken = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            inner = np.ones(len(stay), bool)
            inner[left[1:][left[1:] > left[:-1]] - 1] = False
            blanks = ends[stay[inner]]
            taken[blanks] = True
            values = values.copy()
            values[blanks] = 0x20
            sizes = np.zeros(len(values) + 1, np.int64)
            np.cumsum(taken, out=sizes[1:])
            cuts = sizes[offsets].tolist()
            data = values[taken].tobytes()
            kept = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = [
                chunk.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(n_words - np.diff(left), pa.int64()),
            ]
            if digests:
                columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
            else:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return keep


def without_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    seed: int = SEED,
    block_pieces: int = BLOCK_PIECES,
    digests: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: the words that stay, joined by blanks, or their SHA-256."""
    covers = repeated_spans(docs, window, seed, block_pieces, id_col, text_col)
    known = _known(docs, id_col, text_col)
    joined = known.join(covers, ["own", "th"], "left").select(
        "doc_id", "text", F.coalesce("covers", F.array().cast("array<bigint>")).alias("covers")
    )
    return joined.mapInArrow(_kept(digests), "doc_id long, n_words long, n_removed long, kept string")


#: DuckDB SQL for the digests of ``without_repeats`` over ``documents``.
ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), w AS (
    SELECT r, doc_id, place, array_to_string(words[place : place + 49], ' ') AS phrase
    FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS place FROM d)
), covered AS (
    SELECT DISTINCT r, unnest(range(place, place + 50)) AS place
    FROM (SELECT r, place, doc_id, min(doc_id) OVER (PARTITION BY phrase) AS first_doc FROM w)
    WHERE first_doc < doc_id
), gone AS (
    SELECT r, list(place) AS places FROM covered GROUP BY r
), stay AS (
    SELECT r, string_agg(word, ' ' ORDER BY place) AS kept
    FROM (SELECT d.r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d) x
    ANTI JOIN covered USING (r, place) GROUP BY r
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN stay USING (r)
"""
