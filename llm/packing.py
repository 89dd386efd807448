"""Bounded-space online best-fit packing of tokenised documents into sequences.

Each task tokenises its documents and packs them as they come. It keeps a fixed number of open sequences in a
bitset keyed by free space: a piece goes where it leaves the least room; if it fits nowhere and no more may be
opened, the fullest one is closed. Only what is still open when a task ends is packed once more, as wholes, in
far fewer tasks. So texts are never shuffled, and memory does not depend on the input.

* A null or empty text has no ids but the closing 0: one piece of length 1.
* Only a document longer than a sequence is cut; full pieces are sequences of their own.
* Repeated rows and equal ids are packed like any others. Null ids are kept. No rows: no sequences.
* The ids of a piece are not returned but their start, length and CRC-32; ``keep_ids=True`` adds them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import chunks
from llm.pretokens import PieceMemory, pieces
from llm.rank_merge import merger
from llm.tables import cut, texts

#: Sequences a task holds open.
OPEN_BINS = 256
#: Open ends that one task of the second round packs.
ENDS_PER_TASK = 200_000

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "bin long, offset long, closed boolean, ids binary"
)


class OpenBins:
    """Open sequences keyed by free space; bit ``f`` of the bitset says that one with ``f`` free is there."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self._by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self._bits = 0
        self._open = 0
        self._made = 0

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """(sequence, offset in it, sequences closed by this) for a piece of ``length`` > 0."""
        closed = []
        fitting = self._bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self._open == self.most:
                closed.append(self._take((self._bits & -self._bits).bit_length() - 1))
                self._open -= 1
            number, free = self._made, self.size
            self._made += 1
            self._open += 1
        if free == length:
            closed.append(number)
            self._open -= 1
        else:
            self._by_free[free - length].append(number)
            self._bits |= 1 << (free - length)
        return number, self.size - free, closed

    def _take(self, free: int) -> int:
        same = self._by_free[free]
        number = same.pop()
        if not same:
            self._bits ^= 1 << free
        return number


def _encoder(path: str):
    def encode(new: list[str]) -> list[bytes]:
        ids, counts = merger(path).encode(new)
        data = ids.astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    return encode


def _first_round(path: str, size: int, open_bins: int, keep_ids: bool):
    """Packs one task's documents; a sequence's number starts with the task's."""
    width = 4 * size

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins, memory = OpenBins(size, open_bins), PieceMemory(_encoder(path))
        waiting: dict[int, list[tuple]] = {}
        full = 1 << 39  # numbers of sequences that one piece fills
        for chunk in chunks(batches, "text"):
            lists = [pieces(t) for t in chunk.column(1).to_pylist()]
            of = memory.lookup(lists)
            done: list[tuple] = []
            for doc_id, words in zip(chunk.column(0).to_pylist(), lists, strict=True):
                ids = b"".join(map(of, words)) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    kept = part if keep_ids else None
                    if len(part) == width:
                        done.append((*row, base + full, 0, True, kept))
                        full += 1
                        continue
                    number, offset, closed = bins.place(len(part) // 4)
                    waiting.setdefault(number, []).append((*row, base + number, offset, kept))
                    for c in closed:
                        done += [(*r[:7], True, r[7]) for r in waiting.pop(c)]
            yield _batch(done)
        yield _batch([(*r[:7], False, r[7]) for rows in waiting.values() for r in rows])

    return pack


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("bin", pa.int64()),
        ("offset", pa.int64()),
        ("closed", pa.bool_()),
        ("ids", pa.binary()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
    )


def _second_round(size: int, open_bins: int):
    """Packs whole open ends; rows come grouped, the longest first."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for batch in batches:
            out = []
            for g, number, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    group, bins = g, OpenBins(size, open_bins)
                place, offset, _ = bins.place(length)
                out.append((number, -1 - ((g << 40) + place), offset))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 3)],
                ["bin", "sequence_id", "shift"],
            )

    return pack


def packed(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    open_bins: int = OPEN_BINS,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every row."""
    first = cut(
        texts(docs, id_col, text_col).mapInArrow(_first_round(path, size, open_bins, keep_ids), PIECES)
    )
    ends = first.filter("NOT closed").groupBy("bin").agg(F.sum("length").alias("length"))
    n_groups = max(1, -(-ends.count() // ENDS_PER_TASK))
    moved = (
        ends.select(F.pmod(F.xxhash64("bin"), F.lit(n_groups)).alias("g"), "bin", "length")
        .repartition(n_groups, "g")
        .sortWithinPartitions("g", F.desc("length"), "bin")
        .mapInArrow(_second_round(size, open_bins), "bin long, sequence_id long, shift long")
    )
    joined = first.join(moved, "bin", "left")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    return joined.select(
        *columns,
        F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
