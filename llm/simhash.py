"""Near-duplicate documents by SimHash and pigeonring filtering.

A fingerprint has 64 bits, each the majority of that bit among the hashes of all word shingles. Two
fingerprints link if at most ``max_bits`` bits differ. The bits stand in a ring of segments. By the pigeonring
principle a linking pair has a segment from which every chain of ``l`` consecutive segments differs in at most
``l * max_bits / segments`` bits in all. The chain of length one asks for an equal segment, which is an equi-join;
longer chains prune what that join finds, and the full Hamming distance decides.

Equal fingerprints are merged first, so copies never meet each other. Where more fingerprints than
``DENSE`` share a segment's value, they are not paired: each is written under itself and under the 64 values that
differ from it in one bit. All that stand under one value are at most two bits apart, so each links to the least
of them, and any two that are at most two bits apart have a value in common. This is exact and linear.

* Null and empty texts have no words; their fingerprint is zero, and they link like any others.
* Rows that share an id are linked by their fingerprints like any others; null ids get a component, but never
  name one unless it has no other id. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators.components import component_roots
from llm.tables import cut, texts

BITS = 64
#: Most fingerprints that share a segment's value and are still paired with each other.
DENSE = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of all shingles of ``width`` words, repeats included; fewer words: of the whole sequence."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    return np.array(found, np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # Sums of up to 255 rows fit a byte; they are added up in wide numbers.
    whole = len(ones) // 255 * 255
    counts = ones[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += ones[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _print_udf(width: int, seed: int):
    @F.arrow_udf("long")
    def print_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = (majority_bits(shingle_hashes((t.as_py() or "").encode(), width, seed)) for t in column)
            yield pa.array(found, pa.int64())

    return print_of


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed number."""
    return texts(docs, id_col, text_col).select("doc_id", _print_udf(width, seed)("text").alias("fp"))


def ring(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments: one more than the bits that may differ, so that one is equal."""
    n = max_bits + 1
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(fp: Column, segment: tuple[int, int]) -> Column:
    first, width = segment
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _chain_holds(a: Column, b: Column, start: int, segments: list[tuple[int, int]], max_bits: int) -> Column:
    """Whether each chain of consecutive segments from ``start`` stays within its proportional budget."""
    n = len(segments)
    total, holds = F.lit(0), F.lit(True)
    for length in range(1, n + 1):
        segment = segments[(start + length - 1) % n]
        total = total + F.bit_count(_segment(a.bitwiseXOR(b), segment))
        holds = holds & (total <= length * max_bits // n)
    return holds


def links(distinct: DataFrame, max_bits: int = 2, dense: int = DENSE) -> DataFrame:
    """(src, dst) pairs of different fingerprints that connect all that link, directly or by others.

    ``distinct`` has one row for each ``fp``.
    """
    segments = ring(max_bits)
    keyed = distinct.select(
        "fp",
        F.posexplode(F.array(*[_segment(F.col("fp"), s) for s in segments])).alias("segment", "value"),
    )
    sizes = keyed.groupBy("segment", "value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["segment", "value"]))
    some = shared.filter(F.col("n") <= dense)
    a = some.select("segment", "value", F.col("fp").alias("src"))
    b = some.select("segment", "value", F.col("fp").alias("dst"))
    chain = F.lit(False)
    for start in range(len(segments)):
        chain = chain | (
            (F.col("segment") == start) & _chain_holds(F.col("src"), F.col("dst"), start, segments, max_bits)
        )
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits
    paired = a.join(b, ["segment", "value"]).filter(F.col("src") < F.col("dst")).filter(chain & near)
    many = shared.filter(F.col("n") > dense).select("fp").distinct()
    return paired.select("src", "dst").union(_star_links(many, max_bits))


def _star_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints through the values that differ from them in at most one bit."""
    if max_bits != 2:
        raise ValueError("values one bit away connect pairs that are two bits apart, no others")
    flips = [0] + [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(BITS)]
    around = fps.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("under")
    )
    # The least is taken in each task first; the join's other side has one row for each value.
    least = around.groupBy("under").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return (
        around.join(least.select("under", "least"), "under")
        .filter(F.col("fp") != F.col("least"))
        .select(F.col("least").alias("src"), F.col("fp").alias("dst"))
    )


def _named(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id, keeper) for every different ``fp`` of (doc_id, key, fp)."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(order).alias("first")))
    roots = component_roots(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(
        F.min("first_id").alias("component_id"), F.min("first").alias("first")
    )
    return rooted.select("fp", "root").join(names, "root").select("fp", "component_id", F.col("first.key").alias("keeper"))


def near_duplicates(
    docs: DataFrame, width: int = 3, max_bits: int = 2, id_col="doc_id", text_col="text"
) -> DataFrame:
    """(doc_id, fp, component_id) of every row; a component is named by its smallest id."""
    prints = cut(fingerprints(docs, width, id_col=id_col, text_col=text_col))
    named = _named(prints.withColumn("key", F.lit(0)), max_bits)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id.

    Of rows that share that id, the one with the least hash of id and text. Rows equal in id and text are one
    document: one of them stays.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    print_of = _print_udf(width, 42)
    prints = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            key.alias("key"),
            print_of(F.col(text_col).cast("string")).alias("fp"),
        )
    )
    keepers = _named(prints, max_bits).select("keeper").distinct()
    columns = docs.columns
    kept = docs.withColumn("__row_key", key).join(
        keepers.withColumnRenamed("keeper", "__row_key"), "__row_key", "left_semi"
    )
    return kept.dropDuplicates(["__row_key"]).select(*[f"`{c}`" for c in columns])
