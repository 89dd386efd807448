"""Quality rules by line sequence labelling: a linear-chain conditional random field over the lines of a text.

Viterbi decoding marks each line as content or boilerplate; a document is kept if at least half of the code points
of its words stand in content lines. Base rules come first and decide alone where they fail.

The field is trained on a bounded sample of documents with a quality label: the lines of good documents are
content except for repeats of an earlier line, those of bad documents are boilerplate. Lines without a word take
part in nothing.

* Null and empty texts: all counts 0, base failed, not kept. Repeated rows are treated alike; null ids are kept.
* Ties in decoding go to content. Nothing to learn from: every line is content.
* Texts are never cut; the sample to learn from holds at most ``SAMPLE`` documents of either label and no text
  over ``LEARN_CHARS`` characters. Null labels and null ids are not learned from. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import chunks, per_text, prefix_sums, span_hashes, text_bytes, window_hashes, word_spans
from llm.sampling import rows_of, sampled_ids
from llm.tables import texts

SAMPLE = 384
LEARN_CHARS = 20_000
WINDOW = 5
STEPS, RATE, DECAY = 120, 0.1, 1e-3
CONTENT, BOILERPLATE = 0, 1

#: The characters that the base rules count as symbols.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".?!:;\"'")] = True

N_FEATURES = 12

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_share double, kept boolean"
)


class Lines:
    """Counts of texts, and the features of their lines that hold a word."""

    def __init__(self, column: pa.Array):
        values, offsets = text_bytes(column)
        self.n = len(offsets) - 1
        starts, ends, firsts = word_spans(values, offsets)
        words = span_hashes(prefix_sums(values), starts, ends)
        letters = _LEAD[values] & ~_SPACE[values]
        self.n_words = np.diff(firsts)
        self.word_chars = per_text(letters, offsets)
        self.n_symbols = per_text(_SYMBOL[values], offsets)
        repeated = self._repeated(words, firsts)
        self.n_repeat_words = per_text(repeated, firsts)
        # Lines end at line feeds and at the ends of texts; only those with a word count.
        feeds = np.flatnonzero(values == 0x0A)
        line_starts = np.union1d(feeds + 1, offsets[:-1])
        line_starts = line_starts[line_starts < len(values)]
        edges = np.append(line_starts, len(values))
        first_word = np.searchsorted(starts, edges)
        with_word = np.flatnonzero(np.diff(first_word) > 0)
        self.starts = edges[with_word]
        self.ends = edges[with_word + 1] - (values[edges[with_word + 1] - 1] == 0x0A)
        a, b = first_word[with_word], first_word[with_word + 1]
        self.owner = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.owner, np.arange(self.n + 1))
        data = values.tobytes()
        self.dup = np.zeros(len(self.starts), bool)
        seen, last = set(), -1
        for i, (o, s, e) in enumerate(zip(self.owner.tolist(), self.starts.tolist(), self.ends.tolist(), strict=True)):
            if o != last:
                seen, last = set(), o
            line = data[s:e]
            self.dup[i] = line in seen
            seen.add(line)
        self.n_dup_lines = np.bincount(self.owner, self.dup, self.n).astype(np.int64)
        self.chars = self._between(letters, self.starts, self.ends)
        self.features = self._features(values, words, repeated, letters, a, b)

    @staticmethod
    def _between(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[ends] - sums[starts]

    @staticmethod
    def _repeated(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Words that stand in a window found twice or more in their text."""
        marks = np.zeros(len(words) + 1, np.int64)
        n = len(words) - WINDOW + 1
        if n > 0:
            text_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            whole = np.flatnonzero(text_of[:n] == text_of[WINDOW - 1 :])
            # Windows of different texts never meet: the text is part of the key.
            key = window_hashes(words, range(WINDOW))[whole] ^ (text_of[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key)
            equal = key[order][1:] == key[order][:-1]
            again = np.zeros(len(whole), bool)
            again[order[1:][equal]] = True
            again[order[:-1][equal]] = True
            np.add.at(marks, whole[again], 1)
            np.add.at(marks, whole[again] + WINDOW, -1)
        return np.cumsum(marks)[: len(words)] > 0

    def _features(self, values, words, repeated, letters, a, b) -> np.ndarray:
        n_words = b - a
        size = np.maximum(1, self.ends - self.starts)
        chars = np.maximum(1, self.chars)
        next_same = np.append(words[1:] == words[:-1], False) if len(words) else np.zeros(0, bool)

        def share(table):
            return self._between(table[values], self.starts, self.ends) / chars

        out = np.empty((len(n_words), N_FEATURES))
        out[:, 0] = 1
        out[:, 1] = np.minimum(1, 4 * share(_SYMBOL))
        out[:, 2] = np.minimum(1, share(_UPPER))
        out[:, 3] = np.minimum(1, 4 * share(_DIGIT))
        out[:, 4] = np.minimum(1, 4 * share(_SHOUT))
        out[:, 5] = np.minimum(1, self._between(next_same, a, b) / n_words)
        out[:, 6] = self._between(repeated, a, b) / n_words
        out[:, 7] = self.dup
        out[:, 8] = np.minimum(1, np.log2(n_words) / 8)
        out[:, 9] = np.minimum(1, self.chars / n_words / 20)
        out[:, 10] = _STOP[values[self.ends - 1]] if len(n_words) else 0
        out[:, 11] = np.minimum(1, 4 * (size - self._between(_LEAD[values] & letters, self.starts, self.ends)) / size - 0.5)
        return out


def _by_place(first: np.ndarray):
    """For each line number, the texts that have such a line; longest texts first."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    falling = counts[order]
    for t in range(int(falling[0]) if len(falling) else 0):
        yield t, order[: np.searchsorted(-falling, -t, side="left")]


def viterbi(scores: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of each line; ``scores`` (lines, 2), ``moves`` (2, 2), texts begin at ``first``."""
    best = scores.copy()
    came = np.zeros(scores.shape, np.int8)
    steps = list(_by_place(first))
    for t, who in steps[1:]:
        at = first[who] + t
        through = best[at - 1][:, :, None] + moves
        came[at] = through.argmax(axis=1)
        best[at] += through.max(axis=1)
    labels = np.zeros(len(scores), np.int64)
    for t, who in reversed(steps):
        at = first[who] + t
        last = at + 1 == first[who + 1]
        labels[at] = np.where(last, best[at].argmax(axis=1), came[np.minimum(at + 1, len(came) - 1), labels[np.minimum(at + 1, len(labels) - 1)]])
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features, 2) and moves (2, 2) by the forward-backward gradient and Adam."""
    theta = np.zeros(2 * x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen_x = x.T @ np.eye(2)[y]
    inner = np.setdiff1d(np.arange(1, len(y)), first)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[inner - 1], y[inner]), 1)
    steps = list(_by_place(first))
    for step in range(1, STEPS + 1):
        w, moves = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        e = x @ w
        forward, backward = e.copy(), np.zeros_like(e)
        for t, who in steps[1:]:
            at = first[who] + t
            forward[at] += _log_sum(forward[at - 1][:, :, None] + moves, 1)
        for t, who in reversed(steps[1:]):
            at = first[who] + t
            backward[at - 1] = _log_sum(moves[None] + (e[at] + backward[at])[:, None, :], 2)
        total = _log_sum(forward + backward, 1)
        chance = np.exp(forward + backward - total[:, None])
        joint = np.exp(
            forward[inner - 1][:, :, None] + moves + (e[inner] + backward[inner])[:, None, :] - total[inner][:, None, None]
        )
        grad = np.concatenate([(x.T @ chance - seen_x).ravel(), (joint.sum(axis=0) - seen_moves).ravel()]) / len(y)
        grad += DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)


Field = tuple[np.ndarray, np.ndarray]
UNTRAINED: Field = (np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> Field:
    """A field from the documents with a label, 1 for good and 0 for bad."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good"))
        .filter("doc_id IS NOT NULL AND good IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
    )
    good = dict.fromkeys(sampled_ids(known.filter("good = 1"), SAMPLE), True)
    good.update(dict.fromkeys(sampled_ids(known.filter("good = 0"), SAMPLE), False))
    sample = rows_of(texts(docs, id_col, text_col), sorted(good)).filter(F.length("text") <= LEARN_CHARS)
    rows = sorted((r.doc_id, r.text) for r in sample.collect())
    if len({good[i] for i, _ in rows}) < 2:
        return UNTRAINED
    lines = Lines(pa.array([t for _, t in rows], pa.string()))
    is_good = np.array([good[i] for i, _ in rows], bool)
    y = np.where(is_good[lines.owner] & ~lines.dup, CONTENT, BOILERPLATE)
    return train(lines.features, y, lines.first) if len(y) else UNTRAINED


def judged(docs: DataFrame, field: Field, least_share: float = 0.5, id_col="doc_id", text_col="text") -> DataFrame:
    """Counts, base rules, content share and verdict of every row."""
    weights, moves = field

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            lines = Lines(chunk.column(1))
            content = viterbi(lines.features @ weights, moves, lines.first) == CONTENT
            inside = np.bincount(lines.owner, lines.chars * content, lines.n)
            share = inside / np.maximum(1, lines.word_chars)
            failed = (lines.n_words < 10) | (100 * lines.n_repeat_words > 20 * lines.n_words)
            columns = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0),
                    *(pa.array(c.astype(np.int64)) for c in columns),
                    pa.array(failed),
                    pa.array(share),
                    pa.array(~failed & (share >= least_share)),
                ],
                [part.split()[0] for part in SCHEMA.split(", ")],
            )

    return texts(docs, id_col, text_col).mapInArrow(judge, SCHEMA)
