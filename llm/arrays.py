"""Whole texts as byte arrays: the vectorised reading that the operators share inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def lowered(values: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[values]


def chunks(
    batches: Iterable[pa.RecordBatch], text: str, most: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in column ``text``; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = pc.fill_null(batch.column(at), "")
        batch = batch.set_column(at, text, column)
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and the offset of each (with one more for the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return values, offsets - offsets[0]


def word_spans(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, and each text's first word (and one for the end)."""
    n = len(values)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[values]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of ``byte * odd^place`` modulo 2^64, from which the hash of any span follows."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_ODD, len(values)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mixed((sums[ends] - sums[starts]) * _power(_ODD_INVERSE, len(sums))[starts])


def window_hashes(words: np.ndarray, shape: Iterable[int]) -> np.ndarray:
    """For each place, the hash of the words at the given distances from it; the last places have none."""
    shape = list(shape)
    n = max(0, len(words) - max(shape))
    out = np.full(n, len(shape), np.uint64)
    for d in shape:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + words[d : d + n]
    return mixed(out)


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``marks`` between neighbouring offsets."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
