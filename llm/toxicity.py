"""Toxicity by non-negative positive-unlabelled learning.

Learning knows confirmed toxic documents and unlabelled ones. The risk of a linear classifier is estimated as
``prior * P(loss if negative) ... + max(0, U(loss if positive) - prior * P(loss if positive))``: what unlabelled
documents cost as negatives is corrected by the share of toxic ones among them, and where that estimate turns
negative, which only over-fitting does, the step goes back. The class prior is the share of toxic documents among
all labelled rows that may be learned from.

Features are byte 5-grams and words, lower-cased, everything but letters being a blank; of these the ones that toxic
documents hold significantly more often than unlabelled ones. A document has a feature or not.

* The sample to learn from is at most ``POSITIVE`` toxic and ``UNLABELLED`` other documents, whose labels are not
  looked at; scoring covers whole texts of all rows and streams with the scan.
* Null and empty texts get the score of a document without features. Null labels are ignored; of an id with several labels
  any toxic one counts. No toxic document to learn from: all scores are 0.
* Repeated rows get equal scores; null ids are scored and never learned from. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import chunks, mixed, prefix_sums, span_hashes, text_bytes, word_spans
from llm.sampling import rows_of, sampled_ids
from llm.tables import cut, held_out, texts

POSITIVE = 2048
UNLABELLED = 4096
SLOTS = 1 << 20
WIDTH = 5
#: Most features; the least difference between shares, in standard errors, of one.
FEATURES = 1024
SIGNIFICANT = 5.0
STEPS, RATE, DECAY = 400, 0.05, 6e-4

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every gram and word; texts begin and end with a blank."""
    values, offsets = text_bytes(column)
    n = len(offsets) - 1
    lengths = np.diff(offsets) + 2
    ends = np.cumsum(lengths)
    text = np.full(int(ends[-1]) if n else 0, 0x20, np.uint8)
    owner = np.repeat(np.arange(n), lengths)
    inner = np.ones(len(text), bool)
    inner[ends - 1] = inner[ends - lengths] = False
    text[inner] = _PLAIN[values]
    starts, stops, _ = word_spans(text, np.concatenate([[0], ends]))
    words = span_hashes(prefix_sums(text), starts, stops)
    plain = text.astype(np.uint64)
    m = max(0, len(plain) - WIDTH + 1)
    key = np.zeros(m, np.uint64)
    for d in range(WIDTH):
        key = (key << np.uint64(8)) | plain[d : d + m]
    same = owner[:m] == owner[WIDTH - 1 :] if m else np.zeros(0, bool)
    slots = np.concatenate([mixed(key[same]), mixed(words ^ np.uint64(WIDTH))]) >> np.uint64(44)
    return np.concatenate([owner[:m][same], owner[starts]]), slots.astype(np.int64)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.bias == -np.inf:
            return np.zeros(len(column))
        number = np.full(SLOTS, -1, np.int16)
        number[self.slots] = np.arange(len(self.slots))
        owner, slot = features(column)
        found = number[slot]
        hit = np.flatnonzero(found >= 0)
        once = np.unique(owner[hit] * len(self.slots) + found[hit]) if len(hit) else hit
        total = np.bincount(once // max(1, len(self.slots)), self.weights[once % max(1, len(self.slots))], len(column))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


NOTHING = Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "text"):
        owner, slot = features(chunk.column(1))
        pairs = np.unique(owner * SLOTS + slot)
        cuts = np.searchsorted(pairs // SLOTS, np.arange(chunk.num_rows + 1))
        slots = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pairs % SLOTS, pa.int32()))
        yield pa.RecordBatch.from_arrays([chunk.column(0), slots], ["doc_id", "slots"])


def nn_pu(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on ``x`` under the non-negative risk; by Adam, full batch."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second, mean = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    n_p, n_u = positive.sum(), unlabelled.sum()
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        as_negative = -np.log1p(-np.minimum(p, 1 - 1e-12))
        corrected = as_negative[unlabelled].mean() - prior * as_negative[positive].mean()
        # Slopes of the losses by the classifier's output.
        up = np.where(positive, prior * (p - 1) / n_p, 0)
        down = np.where(unlabelled, p / n_u, 0) - np.where(positive, prior * p / n_p, 0)
        slope = up + down if corrected >= 0 else -down
        grad = np.append(slope @ x + DECAY * w[:-1], slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        # Steps go to and fro where the corrected risk meets zero; their mean stands still.
        if step > STEPS // 2:
            mean += w / (STEPS - STEPS // 2)
    return mean[:-1], float(mean[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    """A model from the labelled rows that are not held out."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return NOTHING
    prior = min(0.99, toxic / n)
    positive = sampled_ids(known.filter("toxic = 1"), POSITIVE)
    unlabelled = sampled_ids(known.select("doc_id"), UNLABELLED)
    sample = rows_of(texts(docs, id_col, text_col), sorted({*positive, *unlabelled}))
    kinds = docs.sparkSession.createDataFrame(
        [(i, int(i in set(positive)), int(i in set(unlabelled))) for i in sorted({*positive, *unlabelled})],
        "doc_id long, p int, u int",
    )
    rows = sample.mapInArrow(_features, "doc_id long, slots array<int>").join(F.broadcast(kinds), "doc_id")
    return _fit(cut(rows.withColumn("row", F.monotonically_increasing_id())), prior)


def _chosen(rows: DataFrame, n_p: int, n_u: int) -> list[int]:
    """The slots that toxic rows have more often than others, counted in Spark; at most ``FEATURES``."""
    has = rows.select("p", "u", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    mean = (F.col("p") + F.col("u") + 1) / F.lit(float(n_p + n_u + 2))
    spread = F.sqrt(mean * (1 - mean) * F.lit(1 / n_p + 1 / n_u))
    z = (F.col("p") / F.lit(float(n_p)) - F.col("u") / F.lit(float(n_u))) / spread
    best = has.select("slot", z.alias("z")).filter(F.col("z") >= SIGNIFICANT).orderBy(F.desc("z"), "slot").limit(FEATURES)
    return sorted(r.slot for r in best.collect())


def _fit(rows: DataFrame, prior: float) -> Model:
    """A model of the sampled rows (row, slots, p, u); only the chosen slots of each reach the driver."""
    n_p, n_u = rows.agg(F.sum("p"), F.sum("u")).first()
    if not n_p or not n_u:
        return NOTHING
    best = _chosen(rows, n_p, n_u)
    # A sorted array of at most FEATURES numbers is a constant of the plan.
    own = F.array_intersect("slots", F.lit(best).cast("array<int>") if best else F.array().cast("array<int>"))
    gathered = sorted((r.doc_id, r.p, r.u, sorted(r.own)) for r in rows.select("doc_id", "p", "u", own.alias("own")).collect())
    x = np.zeros((len(gathered), len(best)), np.float32)
    number = {slot: i for i, slot in enumerate(best)}
    for i, (_, _, _, slots) in enumerate(gathered):
        x[i, [number[s] for s in slots]] = 1
    is_p = np.array([p for _, p, _, _ in gathered], bool)
    is_u = np.array([u for _, _, u, _ in gathered], bool)
    weights, bias = nn_pu(x, is_p, is_u, prior)
    return Model(np.array(best, np.int64), weights, bias)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            found = model.scores(chunk.column(1))
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return texts(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double, predicted int")
