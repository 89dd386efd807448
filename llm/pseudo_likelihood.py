"""Language-model scores by masked pseudo-likelihood: every token is predicted from both of its sides.

A small network sees the ``SIDE`` tokens before and after a masked token and predicts it among all classes; the sum of
the conditional log-probabilities scores a document. Tokens are lower-cased words. The most frequent words of the
whole corpus are classes of their own, all others share hash classes. A word of a hash class has its class's
conditional probability times its share in the class, which follows from the counts of all words: ``(n + 1) / (N + V +
1)`` for a word seen ``n`` times in a class of ``V`` words seen ``N`` times in all; what is left is for unseen words.

1. Word counts cover all documents. The counts of the ``HOT_WORDS`` most frequent words go along with the scan.
2. One scan turns every text into its classes, a byte a word, with the shares of hot words added up and the other words
   listed; training and scoring read this table.
3. Training covers all documents. Documents are dealt by a hash of id and classes to units of about ``UNIT_TOKENS``
   tokens and sorted there, so the model does not depend on files or partitions. In each round every unit starts
   with the weights of the round before and masks one token in ``MASKED`` at a time until its share is through; after
   ``ROUNDS`` rounds every token was masked once. Weights are averaged by the number of tokens, summed before they
   are gathered. The network has one size; what grows with the corpus are the word counts, and the units it is fitted to.
4. The words that are not hot are joined with their counts.

* Null and empty texts, and those without a word: 0 tokens, sum 0, mean null.
* Repeated rows get equal scores; null ids are scored. No rows: no rows. No words at all: an untrained network.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import chunks, lowered, prefix_sums, span_hashes, text_bytes, word_spans
from llm.tables import cut, texts

TOP_WORDS, HASHED = 191, 64
CLASSES = TOP_WORDS + HASHED + 1
EDGE = CLASSES - 1  # what stands before and after a text
SIDE = 2
WIDTH, HIDDEN = 16, 32
MASKED, ROUNDS, BATCH, RATE = 16, 4, 256, 0.3
#: Tokens of a unit, and most units; beyond, units grow.
UNIT_TOKENS, MOST_UNITS = 4_000_000, 20_000
#: Words whose counts every task holds: 1 MB.
HOT_WORDS = 65_536
#: Tokens that a task learns from, or scores, at a time.
CHUNK_TOKENS = 1 << 17
SCORING_BATCH = 2048
#: Different words a task counts before it hands them on.
COUNTED = 200_000
#: Bytes of text whose words are counted at once.
COUNTED_BYTES = 1 << 22

_ONES = np.ones(CLASSES, np.float32)
_AROUND = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
_CELLS = np.arange(CLASSES * WIDTH).reshape(CLASSES, WIDTH)
_SHAPES = ((CLASSES, WIDTH), (2 * SIDE, WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def merged() -> pa.Table:
        found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return found.select(["word", "n_sum"]).rename_columns(["word", "n"])

    for chunk in chunks(batches, "text", COUNTED_BYTES):
        words = pc.ascii_split_whitespace(pc.ascii_lower(chunk.column(0))).flatten()
        found = pc.value_counts(words.filter(pc.greater(pc.binary_length(words), 0)))
        held.append(pa.table({"word": found.field(0).cast(pa.binary()), "n": found.field(1)}))
        rows += len(found)
        if rows > 2 * COUNTED:
            held = [merged()]
            rows = held[0].num_rows
            if rows > COUNTED:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from merged().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of all texts."""
    counts = docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return cut(counts)


def _most_frequent(counts: DataFrame, most: int = TOP_WORDS) -> list[bytes]:
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def frequent_words(docs: DataFrame, most: int = TOP_WORDS) -> list[bytes]:
    """The most frequent words of all texts; equally frequent ones in byte order."""
    return _most_frequent(word_counts(docs), most)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return span_hashes(prefix_sums(joined), ends - [len(w) for w in words], ends) if words else np.zeros(0, np.uint64)


def _rare_counts(counts: DataFrame, words: list[bytes]) -> DataFrame:
    """(h, n) of the words that share hash classes."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _word_hashes(batch.column(0).to_pylist())
            rare = ~np.isin(h, _word_hashes(words))
            yield pa.RecordBatch.from_arrays([pa.array(h[rare].view(np.int64)), batch.column(1).filter(pa.array(rare))], ["h", "n"])

    return counts.select("word", "n").mapInArrow(hashed, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Places:
    """Places of hashes in a sorted array of them, found by their upper bits."""

    def __init__(self, hashes: np.ndarray):
        bits = len(hashes).bit_length() + 1
        self._shift = np.uint64(64 - bits)
        self._first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self._shift)
        self._hashes = np.append(hashes, np.uint64(2**64 - 1))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the hash is there) of each; the place only counts where it is."""
        at = self._first[(h >> self._shift).view(np.int64)]
        there = self._hashes[at]
        later = np.flatnonzero(there < h)
        while len(later):
            at[later] += 1
            there[later] = self._hashes[at[later]]
            later = later[there[later] < h[later]]
        return at, (there == h) & (at < len(self._hashes) - 1)


class Classes:
    """Class numbers of the words of many texts."""

    def __init__(self, words: list[bytes]):
        hashes = _word_hashes(words)
        order = np.argsort(hashes)
        self._places, self._numbers = Places(hashes[order]), order

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(classes with ``SIDE`` edges before and after each text, place of each word)."""
        return self.with_hashes(column)[:2]

    def with_hashes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and the hash of each word."""
        values, offsets = text_bytes(column)
        values = lowered(values)
        starts, ends, firsts = word_spans(values, offsets)
        h = span_hashes(prefix_sums(values), starts, ends)
        found = TOP_WORDS + (h >> np.uint64(58)).astype(np.int64)
        at, known = self._places(h)
        found[known] = self._numbers[at[known]]
        return *with_edges(found, np.diff(firsts)), h


def with_edges(found: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes with ``SIDE`` edges before and after each text, place of each word) of texts of given lengths."""
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    out = np.full(len(found) + 2 * SIDE * len(lengths), EDGE, np.int64)
    places = np.arange(len(found)) + SIDE * (2 * text_of + 1)
    out[places] = found
    return out, places


def _exponentials(logits: np.ndarray, hidden: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shift, sums): turns logits, which are ``hidden @ outer``, into exponentials of what exceeds each row's shift; sums of the rows.

    There is no shift unless sums without one come near the ends of what a float holds.
    """
    np.exp(logits, out=logits)
    sums = logits @ _ONES
    if 1e-25 < sums.min(initial=1) and sums.max(initial=1) < 1e25:
        return np.zeros(len(logits), np.float32), sums
    np.matmul(hidden, outer, out=logits)
    shift = logits.max(axis=1)
    logits -= shift[:, None]
    np.exp(logits, out=logits)
    return shift, logits @ _ONES


def _tanh(x: np.ndarray) -> None:
    """In place; by the exponential, which is the faster one."""
    x += x
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1


class Network:
    """Embeddings, one hidden layer, a softmax over classes."""

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in _SHAPES]
        if flat is None:
            rng = np.random.default_rng(11)
            flat = rng.normal(0, 0.1, sum(sizes))
            flat[sizes[0] + sizes[1] : sizes[0] + sizes[1] + sizes[2]] = 0
            flat[-sizes[-1] :] = 0
        parts = np.split(np.asarray(flat, np.float32), np.cumsum(sizes)[:-1])
        self.parts = [p.reshape(s).copy() for p, s in zip(parts, _SHAPES, strict=True)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @staticmethod
    def context(classes: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.take(classes, places[:, None] + _AROUND, mode="clip").astype(np.intp)

    def _whole_outer(self) -> np.ndarray:
        """The outer weights with the bias as a last row, for hidden layers that end in a one."""
        return np.vstack([self.parts[3], self.parts[4]])

    def log_probabilities(self, classes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of each masked place's own class."""
        embed, inner, bias = self.parts[:3]
        outer = self._whole_outer()
        classes = classes.astype(np.uint8)
        # What each class adds to the hidden layer from each distance, computed once.
        tables = np.einsum("cw,swh->sch", embed, inner)
        tables[0] += bias
        found = np.empty(len(places))
        ones = np.ones((SCORING_BATCH, HIDDEN + 1), np.float32)
        space = np.empty((SCORING_BATCH, CLASSES), np.float32)
        with np.errstate(over="ignore"):
            for a in range(0, len(places), SCORING_BATCH):
                at = places[a : a + SCORING_BATCH]
                hidden, logits = ones[: len(at)], space[: len(at)]
                around = self.context(classes, at)
                added = np.take(tables[0], around[:, 0], axis=0, mode="clip")
                for s in range(1, 2 * SIDE):
                    added += np.take(tables[s], around[:, s], axis=0, mode="clip")
                _tanh(added)
                hidden[:, :HIDDEN] = added
                np.matmul(hidden, outer, out=logits)
                own = logits[np.arange(len(at)), classes[at]].astype(np.float64)
                shift, sums = _exponentials(logits, hidden, outer)
                found[a : a + len(at)] = own - shift - np.log(sums)
        return found

    def learn(self, classes: np.ndarray, places: np.ndarray) -> None:
        """One pass of stochastic gradient steps over the places."""
        embed, inner, bias = self.parts[:3]
        flat_inner = inner.reshape(-1, HIDDEN)
        classes = classes.astype(np.uint8)
        outer = np.ascontiguousarray(self._whole_outer().T)
        ones = np.ones((BATCH, HIDDEN + 1), np.float32)
        space = np.empty((BATCH, CLASSES), np.float32)
        rows = np.arange(BATCH) * CLASSES
        steady = np.ones(BATCH, np.float32)
        with np.errstate(over="ignore"):
            for a in range(0, len(places), BATCH):
                at = places[a : a + BATCH]
                n = len(at)
                hidden, p = ones[:n], space[:n]
                around = self.context(classes, at)
                x = np.take(embed, around, axis=0, mode="clip").reshape(n, -1)
                inside = x @ flat_inner
                inside += bias
                _tanh(inside)
                hidden[:, :HIDDEN] = inside
                np.matmul(hidden, outer.T, out=p)
                sums = _exponentials(p, hidden, outer.T)[1]
                # The rows of p are the gradients but for a factor each, which goes to the narrower side of the products.
                p.reshape(-1)[rows[:n] + classes[at]] -= sums
                factor = (np.float32(RATE / n) / sums)[:, None]
                down = p @ outer[:, :HIDDEN]
                inside *= inside
                np.subtract(1, inside, out=inside)
                inside *= factor
                down *= inside
                back = down @ flat_inner.T
                outer -= p.T @ (hidden * factor)
                flat_inner -= x.T @ down
                bias -= steady[:n] @ down
                cells = np.take(_CELLS, around.ravel(), axis=0, mode="clip").ravel()
                embed -= np.bincount(cells, back.ravel(), embed.size).reshape(embed.shape).astype(np.float32)
        self.parts[3][:], self.parts[4][:] = outer[:, :HIDDEN].T, outer[:, HIDDEN]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the length of each value."""
    values, offsets = text_bytes(column)
    return values, np.diff(offsets)


def _round(start: np.ndarray, number: int):
    """Weights, times tokens, of the units of a task; rows (unit, classes) come sorted by unit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(start) + 1)
        unit, network, seen, held = None, Network(start), 0, []

        def learn():
            if held:
                classes, places = with_edges(*(np.concatenate(x) for x in zip(*held, strict=True)))
                for phase in range(number, MASKED, ROUNDS):
                    network.learn(classes, places[phase::MASKED])
                held.clear()

        def done():
            learn()
            total[:-1] += network.flat().astype(np.float64) * seen
            total[-1] += seen

        for batch in batches:
            units = batch.column(0).to_numpy()
            values, lengths = _lists(batch.column(1))
            ends = np.cumsum(lengths)
            # Pieces end where the unit changes and where enough tokens are together, whatever the batches are.
            at = 0
            while at < len(units):
                if units[at] != unit:
                    done()
                    unit, network, seen = units[at], Network(start), 0
                have = sum(int(n.sum()) for _, n in held)
                before = ends[at] - lengths[at]
                stop = int(np.searchsorted(ends, before + CHUNK_TOKENS - have, side="left")) + 1
                stop = min(stop, at + int(np.searchsorted(units[at:] != unit, True)), len(units))
                held.append((values[before : ends[stop - 1]].astype(np.int64), lengths[at:stop]))
                seen += int(ends[stop - 1] - before)
                if have + ends[stop - 1] - before >= CHUNK_TOKENS:
                    learn()
                at = stop
        done()
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "w"])

    return run


def _encode(words: list[bytes], hot):
    """(doc_id, classes, known, h, times): a byte a word; log shares of hot words; other words and how often they occur."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes_of = Classes(words)
        hot_hashes, hot_shares = hot.value
        places_of = Places(hot_hashes)
        for chunk in chunks(batches, "text"):
            classes, places, h = classes_of.with_hashes(chunk.column(1))
            own = classes[places]
            # Each text's words lie between its edges.
            text_of = np.cumsum(classes == EDGE)[places] // (2 * SIDE)
            lengths = np.bincount(text_of, minlength=chunk.num_rows)
            rare = own >= TOP_WORDS
            text, word = text_of[rare], h[rare]
            known = np.zeros(chunk.num_rows)
            at, is_hot = places_of(word)
            known += np.bincount(text[is_hot], hot_shares[at[is_hot]], chunk.num_rows)
            text, word = text[~is_hot], word[~is_hot]
            # One key of text and the hash's upper bits: where these are equal for two words, a word may be listed twice.
            bits = np.uint64(max(1, chunk.num_rows.bit_length()))
            order = np.argsort((text.astype(np.uint64) << (np.uint64(64) - bits)) | (word >> bits))
            text, word = text[order], word[order]
            new = np.ones(len(word), bool)
            new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(word)))
            ends = pa.array(np.searchsorted(text[at], np.arange(chunk.num_rows + 1)), pa.int32())
            edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            data = pa.py_buffer(own.astype(np.uint8).tobytes())
            encoded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges.tobytes()), data])
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0),
                    encoded.cast(pa.binary()),
                    pa.array(known),
                    pa.ListArray.from_arrays(ends, pa.array(word[at].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
                ],
                ["doc_id", "classes", "known", "h", "times"],
            )

    return encode


def _shares(rare: DataFrame | None, most: int = HOT_WORDS):
    """(hashes in order, log shares) of the most frequent words of the hash classes, and the sizes of these classes.

    Counts are rounded to steps of a sixteenth of their doubling; the steps that hold at most ``most`` words in
    all, from above, are what is gathered.
    """
    if rare is None:
        return (np.zeros(0, np.uint64), np.zeros(0)), np.zeros(HASHED)
    sizes = np.zeros(HASHED)
    for r in rare.groupBy(F.shiftrightunsigned("h", 58).alias("class")).agg((F.sum("n") + F.count("*")).alias("size")).collect():
        sizes[r["class"]] = r["size"]
    step = F.floor(16 * F.log2(F.col("n").cast("double")))
    steps = sorted(rare.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)
    fit = np.cumsum([r.words for r in steps]) <= most
    if not fit.any():
        return (np.zeros(0, np.uint64), np.zeros(0)), sizes
    top = rare.filter(step >= steps[int(fit.sum()) - 1].step).toPandas()
    hashes, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    return (hashes, np.log((n + 1) / (sizes[(hashes >> np.uint64(58)).astype(np.int64)] + 1))), sizes


def encoded(docs: DataFrame, words: list[bytes], hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The table of classes that training and scoring read; ``row`` numbers its rows."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    schema = "doc_id long, classes binary, known double, h array<long>, times array<int>"
    found = docs.select("doc_id", "text").mapInArrow(_encode(words, shared), schema)
    # Cut, so that the rows keep their numbers.
    return cut(found.withColumn("row", F.monotonically_increasing_id()))


def train(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """Weights learned from (doc_id, text)."""
    return _trained(encoded(docs, words, _shares(None)[0]))


def _class_totals(table: DataFrame) -> np.ndarray:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(CLASSES, np.int64)
        for batch in batches:
            totals += np.bincount(_lists(batch.column(0))[0], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(totals)], ["i", "n"])

    totals = np.zeros(CLASSES)
    for r in table.select("classes").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        totals[r.i] = r.n
    return totals


def _trained(table: DataFrame, unit_tokens: int = UNIT_TOKENS) -> np.ndarray:
    """Weights averaged over all units after each round; what is gathered is the size of one network."""
    weights = Network().flat()
    totals = _class_totals(table)
    size = int(totals.sum())
    if not size:
        return weights
    # The first round starts from the frequencies of the classes.
    weights[-CLASSES:] = np.log((totals + 1) / (size + CLASSES))
    units = min(-(-size // unit_tokens), MOST_UNITS)
    # Rows without an id are told apart by their place, so that many of them don't meet in one unit.
    place = F.xxhash64(F.coalesce("doc_id", "row"), "classes")
    dealt = cut(
        table.filter(F.octet_length("classes") > 0)
        .select(F.pmod(place, F.lit(units)).cast("int").alias("unit"), place.alias("place"), "classes")
        .repartitionById(units, F.col("unit"))
        .sortWithinPartitions("unit", "place", "classes")
        .select("unit", "classes")
    )
    for number in range(ROUNDS):
        sums = dealt.mapInArrow(_round(weights, number), "i int, w double")
        total = np.zeros(len(weights) + 1)
        for r in sums.groupBy("i").agg(F.sum("w").alias("w")).collect():
            total[r.i] = r.w
        weights = (total[:-1] / total[-1]).astype(np.float32)
    return weights


def _scored(table: DataFrame, weights: np.ndarray, rare: DataFrame, sizes: np.ndarray) -> DataFrame:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(weights)
        for batch in batches:
            values, lengths = _lists(batch.column(2))
            ends = np.cumsum(lengths)
            sums = np.zeros(len(lengths))
            at = 0
            while at < len(lengths):
                before = ends[at] - lengths[at]
                stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK_TOKENS, side="right")))
                some = lengths[at:stop]
                found = network.log_probabilities(*with_edges(values[before : ends[stop - 1]].astype(np.int64), some))
                sums[at:stop] = np.bincount(np.repeat(np.arange(len(some)), some), found, len(some))
                at = stop
            of_classes = pa.array(sums + batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), of_classes],
                ["row", "doc_id", "n_tokens", "of_classes"],
            )

    by_class = table.select("row", "doc_id", "classes", "known").mapInArrow(
        score, "row long, doc_id long, n_tokens long, of_classes double"
    )
    # 64 numbers; a class without counted words has size 0.
    size = F.element_at(F.array(*[F.lit(float(x)) for x in sizes]), (F.shiftrightunsigned("h", 58) + 1).cast("int"))
    tokens = table.select("row", F.inline(F.arrays_zip("h", "times"))).withColumn("size", size)
    share = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("size") + 1))
    in_classes = (
        tokens.join(rare.select("h", "n"), "h", "left").groupBy("row").agg(F.sum(F.col("times") * share).alias("in_classes"))
    )
    total = F.col("of_classes") + F.coalesce("in_classes", F.lit(0.0))
    return by_class.join(in_classes, "row", "left").select(
        "doc_id",
        "n_tokens",
        total.alias("log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"),
    )


def scored(docs: DataFrame, words: list[bytes], weights: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row of (doc_id, text).

    ``counts`` are the words of the corpus that was learned from; those of ``docs`` if not given.
    """
    rare = cut(_rare_counts(word_counts(docs) if counts is None else counts, words))
    hot, sizes = _shares(rare)
    return _scored(encoded(docs, words, hot), weights, rare, sizes)


def pseudo_likelihood(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Counts, trains and scores over all of ``docs``."""
    plain = texts(docs, id_col, text_col)
    counts = word_counts(plain)
    words = _most_frequent(counts)
    rare = cut(_rare_counts(counts, words))
    hot, sizes = _shares(rare)
    table = encoded(plain, words, hot)
    return _scored(table, _trained(table), rare, sizes)
