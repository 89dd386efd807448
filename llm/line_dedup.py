"""Fuzzy line deduplication: MinHash signatures, banding, exact Jaccard verification, distributed union-find.

A line's signature is the least hash of its character shingles in each of ``BANDS * ROWS`` bins (one permutation;
an empty bin borrows from the next full one). All lines with an equal band meet. Where up to ``NEAREST + 1`` lines
share a band's value, all their pairs are candidates. The lines of a value that more share are put into blocks, and
each pair of blocks is settled by one task: every two lines of it are similar by a chain of links found already, or
apart by a bound from their sketches, or compared. What is handed on are the links that connect them, so near copies
give a linear number of pairs. Candidates are compared by the exact Jaccard similarity of their shingle sets, and
those at or above the threshold are joined to components; pairs that their sketches tell apart are left out before. Of each component the first line (least document id, then
least line number) stays.

A pair at the threshold of 0.8 shares a band with a probability of 0.998.

* A line is what stands between line feeds, without white space at its ends. Lines without a word are never
  duplicates and stay. A line shorter than a shingle is one shingle.
* Lines are known by a 64-bit hash (XXH3): equal lines are one, however often they occur.
* Null texts have no lines and stay null. Null ids come last among the documents.
* Rows equal in id and text are one document; they are treated alike. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.operators.components import component_roots
from llm.arrays import chunks, mixed
from llm.bitmap import bitmap_of, is_set, may_hold
from llm.tables import cut, texts

SHINGLE = 7
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Most others in a band's value that a line is paired with one by one; lines of larger values meet in blocks.
NEAREST = 64
#: What the lines of a block weigh: each one, and one more for every ``BLOCK_CHARS`` characters.
BLOCK, BLOCK_CHARS = 2048, 256
#: Bits of a sketch; each is the parity of the shingles that fall on it.
SKETCH_BITS = 512
#: Characters of lines that are hashed or sorted at once, and what a line weighs beside its own.
PART_CHARS, _LINE_WEIGHT = 1 << 17, 32
_SKETCH = [f"bits{i}" for i in range(SKETCH_BITS // 64)]
#: Low bits of a band's key that order the lines of its value.
ORDER_BITS = 16
_NO_CODE_POINT = 0x110000
_EMPTY = np.iinfo(np.uint64).max
#: Lines a task remembers having signed; at the limit it starts anew and may sign some again.
REMEMBERED = 500_000
_BLANKS = " \t\n\r\x0b\x0c"


def line_id(line: str) -> int:
    """A line's 64-bit hash as a signed number."""
    h = xxhash.xxh3_64_intdigest(line.encode())
    return h - (1 << 64) if h >> 63 else h


def lines_of(text: str) -> list[str]:
    return [line.strip(_BLANKS) for line in text.split("\n")]


def shingles(line: str, width: int = SHINGLE) -> set[str]:
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _parts(lines: list[str]) -> Iterator[list[str]]:
    """The lines in parts of some ``PART_CHARS``, which the processor's caches hold; a longer line is one of its own."""
    ends = np.cumsum([len(line) + _LINE_WEIGHT for line in lines])
    start = 0
    while start < len(lines):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PART_CHARS, side="right")))
        yield lines[start:stop]
        start = stop


def _windows(codes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Each place's polynomial of the ``width`` codes from there on, put together from those of half the width."""
    if width == 1:
        return codes
    half = width // 2
    part = _windows(codes, half, base)
    h = part[: len(part) - half] * np.uint64(pow(base, half, 1 << 64))
    h += part[half:]
    if width % 2:
        h = h[:-1] * np.uint64(base)
        h += codes[width - 1 :]
    return h


def _shingle_hashes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line number) of all shingles, repeats included; lines are not empty."""
    lengths = np.array([len(line) for line in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.concatenate([codes, np.zeros(width, np.uint64)])
    n = len(codes) - width
    h = _windows(codes, width)[:n]
    # A line shorter than a shingle hashes whole: what follows it is not looked at.
    starts = np.cumsum(lengths) - lengths
    for i in np.flatnonzero(lengths < width):
        h[starts[i]] = np.uint64(xxhash.xxh3_64_intdigest(lines[i].encode("utf-32-le", "surrogatepass")))
    # The last places of a line begin no shingle; a shorter line has one at its start.
    counts = np.maximum(lengths - width, 0) + 1
    change = np.zeros(n + 1, np.int8)
    change[starts] += 1
    np.subtract.at(change, starts + counts, np.int8(1))
    inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    return mixed(h[inside]), np.repeat(np.arange(len(lines)), counts)


def _pieces(codes: np.ndarray, width: int) -> np.ndarray:
    """Numbers of each place's ``width`` codes from there on, equal for equal ones only; codes are below 2^32."""
    if width == 1:
        return codes
    half = (width + 1) // 2
    part = _pieces(codes, half)
    if half > 1:
        part = np.unique(part, return_inverse=True)[1].astype(np.uint64)
    return (part[: len(part) - (width - half)] << np.uint64(32)) | part[width - half :]


def _numbered(lines: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """The numbers of each line's shingles, repeats included: equal for equal shingles of these lines, and only for them."""
    lengths = [max(len(line), width) for line in lines]
    text = "".join(line.ljust(width, "\0") for line in lines)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    starts = (np.cumsum(lengths) - lengths).tolist()
    for at, line in zip(starts, lines, strict=True):
        # No code point: shorter lines equal no shingle of a longer one.
        codes[at + len(line) : at + width] = _NO_CODE_POINT
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    ranks = np.cumsum(there, dtype=np.uint64) - np.uint64(1)
    bits = 64 // width
    few = int(ranks[-1]) < 1 << bits
    # With few different code points their places among these make a number that fits 64 bits.
    h = _windows(ranks[codes], width, 1 << bits) if few else _pieces(ranks[codes], width)
    return [h[at : at + n - width + 1] for at, n in zip(starts, lengths, strict=True)]


class ShingleSets:
    """The sets of shingles of some lines, each made when it is first asked for."""

    def __init__(self, lines: list[str]):
        self._numbers = _numbered(lines)
        self._sets: dict[int, np.ndarray] = {}

    def _of(self, i: int) -> np.ndarray:
        if i not in self._sets:
            numbers = np.sort(self._numbers[i])
            first = np.empty(len(numbers), bool)
            first[0] = True
            np.not_equal(numbers[1:], numbers[:-1], out=first[1:])
            self._sets[i] = numbers[first]
        return self._sets[i]

    def similar(self, i: int, j: int, threshold: float) -> bool:
        """Whether the exact Jaccard similarity of two lines is at least ``threshold``."""
        a, b = self._of(i), self._of(j)
        if min(len(a), len(b)) / max(len(a), len(b)) < threshold:
            return False
        merged = np.concatenate([a, b])
        merged.sort(kind="stable")
        both = int(np.count_nonzero(merged[1:] == merged[:-1]))
        return both / (len(merged) - both) >= threshold


def signatures(lines: list[str], width: int = SHINGLE, bins: int = BANDS * ROWS) -> np.ndarray:
    """(lines, bins) least shingle hashes; lines are not empty."""
    return np.concatenate([_signatures(part, width, bins) for part in _parts(lines)])


def _signatures(lines: list[str], width: int, bins: int) -> np.ndarray:
    h, owner = _shingle_hashes(lines, width)
    bin_of = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    table = np.full(len(lines) * bins, _EMPTY, np.uint64)
    np.minimum.at(table, owner * bins + bin_of, h)
    table = table.reshape(len(lines), bins)
    # Most long lines have no empty bin.
    gaps = np.flatnonzero((table == _EMPTY).any(axis=1))
    table[gaps] = _filled(table[gaps])
    return table


def _filled(table: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the next full one, mixed with the distance to it."""
    bins = table.shape[1]
    out, distance = table.copy(), np.zeros(table.shape, np.uint64)
    step = 1
    while step < bins and (empty := out == _EMPTY).any():
        # Doubling: after each step a bin knows the next full one up to twice as far.
        ahead, far = np.roll(out, -step, axis=1), np.roll(distance, -step, axis=1) + np.uint64(step)
        take = empty & (ahead != _EMPTY)
        out[take], distance[take] = ahead[take], far[take]
        step *= 2
    return np.where(distance > 0, mixed(out + distance * np.uint64(0xD1342543DE82EF95)), out)


def band_keys(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(lines, bands) hashes of each band's values; the low ``ORDER_BITS`` are those of the next band's first bin."""
    n, bins = table.shape
    keys = np.zeros((n, bins // rows), np.uint64)
    for r in range(rows):
        keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + table[:, r::rows])
    keys ^= mixed(np.arange(1, bins // rows + 1, dtype=np.uint64))
    low = np.uint64((1 << ORDER_BITS) - 1)
    return (keys & ~low) | (mixed(np.roll(table[:, ::rows], -1, axis=1)) & low)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id): one row for each band's value and line."""
    seen: set[int] = set()
    for chunk in chunks(batches, "text"):
        fresh: dict[int, str] = {}
        for text in chunk.column(0).to_pylist():
            for line in lines_of(text):
                if line:
                    number = line_id(line)
                    if number not in seen:
                        fresh[number] = line
        if not fresh:
            continue
        if len(seen) > REMEMBERED:
            seen.clear()
        seen.update(fresh)
        keys = band_keys(signatures(list(fresh.values())))
        owner = np.repeat(np.array(list(fresh), np.int64), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(owner)], ["key", "id"])


def _met_in_values(docs: DataFrame) -> DataFrame:
    """(value, id, n) of the lines of all values that several share."""
    signed = docs.select("text").mapInArrow(_sign, "key long, id long")
    valued = signed.withColumn("value", F.shiftrightunsigned("key", ORDER_BITS))
    # Tasks that have the same line hand on the same rows, which stand together.
    by_id = Window.partitionBy("value").orderBy("id")
    beside = valued.select("value", "id", F.lag("id").over(by_id).alias("last"), F.lead("id").over(by_id).alias("next"))
    # Most values have one row; those are gone before rows are counted.
    several = beside.filter("last != id OR (last IS NULL AND next IS NOT NULL)")
    once = several.withColumn("n", F.count("*").over(Window.partitionBy("value")))
    return cut(once.filter("n > 1").select("value", "id", "n"))


def _paired(shared: DataFrame) -> DataFrame:
    """(src, dst): all pairs of the values with up to ``NEAREST + 1`` lines."""
    groups = shared.filter(F.col("n") <= NEAREST + 1).groupBy("value").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    ends = groups.select("ids", F.posexplode("ids").alias("at", "src"))
    return ends.select("src", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("dst")).distinct()


def sketches(lines: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(lines, words) bits, and how many different shingles each line has.

    Two sets differ in at least as many shingles as their sketches in bits.
    """
    return tuple(np.concatenate(x) for x in zip(*(_sketches(part, width) for part in _parts(lines)), strict=True))


def _sketches(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    h, owner = _shingle_hashes(lines, width)
    # One sort of line number and hash together; of a hash the upper 48 bits tell the shingles of a line apart.
    keys = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    owner = (keys >> np.uint64(48)).astype(np.int64)
    cells = owner * SKETCH_BITS + (keys % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(cells, minlength=len(lines) * SKETCH_BITS) & 1).astype(bool)
    bits = np.packbits(odd.reshape(len(lines), SKETCH_BITS), axis=1).view(np.uint64)
    return bits, np.bincount(owner, minlength=len(lines))


def connecting(lines: list[str], blocks: list[int], threshold: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of line numbers that connect all similar lines: of different blocks if there are two, else of the one."""
    bits, sizes = sketches(lines)
    block = np.array(blocks)
    apart = len(set(blocks)) > 1
    group, sets, out = np.arange(len(lines)), ShingleSets(lines), []
    for i in range(len(lines)):
        open_ = group[i + 1 :] != group[i]
        if apart:
            open_ &= block[i + 1 :] != block[i]
        others = i + 1 + np.flatnonzero(open_)
        # At the threshold, sets differ in at most this share of both their sizes.
        most = (1 - threshold) / (1 + threshold) * (sizes[others] + sizes[i]) + 1e-6
        others = others[np.abs(sizes[others] - sizes[i]) <= most]
        most = (1 - threshold) / (1 + threshold) * (sizes[others] + sizes[i]) + 1e-6
        others = others[np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most]
        for j in others.tolist():
            if group[j] != group[i] and sets.similar(i, j, threshold):
                group[group == group[j]] = group[i]
                out.append((i, j))
    return out


def _connect(threshold: float):
    def connect(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        pairs = connecting(table.column("line").to_pylist(), table.column("block").to_pylist(), threshold)
        ends = [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in pairs]
        return pa.table({"src": pa.array([e[0] for e in ends], pa.int64()), "dst": pa.array([e[1] for e in ends], pa.int64())})

    return connect


def _linked(shared: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): similar pairs that connect all similar lines of each value with more lines than are paired."""
    crowded = shared.filter(F.col("n") > NEAREST + 1).select("value", "id").join(lines.select("id", "line"), "id")
    weight = F.sum(1 + F.floor(F.length("line") / BLOCK_CHARS))
    before = Window.partitionBy("value").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(crowded.withColumn("block", F.coalesce(F.floor(weight.over(before) / BLOCK), F.lit(0))))
    # Only blocks that have lines: a long line may leave numbers unused.
    filled = blocks.groupBy("value").agg(F.collect_set("block").alias("all"))
    met = blocks.join(filled, "value").withColumn("with", F.explode("all")).select(
        "value", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "block", "id", "line"
    )
    return met.groupBy("value", "a", "b").applyInArrow(_connect(threshold), "src long, dst long").distinct()


def _line_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line, size, bits0, …): the bitmap drops nearly all other lines inside the scan."""
    lines = docs.select("text").mapInArrow(_texts_in(bitmap_of(ids, "id")), "id long, line string")
    lines = lines.groupBy("id").agg(F.min("line").alias("line"))
    words = ", ".join(f"{w} long" for w in _SKETCH)
    return cut(lines.mapInArrow(_sketched, f"id long, line string, size int, {words}"))


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the number of their different shingles and the words of their sketch."""
    for chunk in chunks(batches, "line"):
        bits, sizes = sketches(chunk.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*chunk.columns, pa.array(sizes.astype(np.int32)), *(pa.array(w.view(np.int64)) for w in np.ascontiguousarray(bits.T))],
            ["id", "line", "size", *_SKETCH],
        )


def _may_be_similar(threshold: float) -> Column:
    """Whether sizes and sketches of lines a and b leave it open: similar sets differ in at most a share of both sizes."""
    most = (F.col("a_size") + F.col("b_size")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
    apart = F.lit(0)
    for w in _SKETCH:
        apart = apart + F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}")))
    return (F.abs(F.col("a_size") - F.col("b_size")) <= most) & (apart <= most)


def _candidates_and_lines(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    shared = _met_in_values(docs)
    lines = _line_texts(docs, shared)
    return _paired(shared).union(_linked(shared, lines, threshold)).distinct(), lines


def candidates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(src, dst) ids of lines that may be similar, each pair once; with them all similar lines of a value connect."""
    return _candidates_and_lines(docs, threshold)[0]


def _texts_in(bits: bytes):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            found = {line_id(line): line for t in chunk.column(0).to_pylist() for line in lines_of(t) if line}
            ids = np.fromiter(found, np.int64, len(found))
            keep = is_set(bits, ids.view(np.uint64))
            lines = [line for line, k in zip(found.values(), keep, strict=True) if k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(lines, pa.string())], ["id", "line"])

    return find


class Groups:
    """Union-find over the ids one task has met."""

    def __init__(self):
        self._above: dict[int, int] = {}

    def root(self, i: int) -> int:
        above = self._above
        while (up := above.get(i, i)) != i:
            above[i] = above.get(up, up)
            i = up
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self._above[max(a, b)] = min(a, b)


def _similar(threshold: float):
    """Similar pairs; a pair that the pairs before it in this task connect already is neither compared nor given."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        for chunk in chunks(batches, "a", PART_CHARS):
            src, a, dst, b = (c.to_pylist() for c in chunk.columns)
            # What is connected already is left out before the shingles of the others are numbered.
            rows = [(s, x, d, y) for s, x, d, y in zip(src, a, dst, b, strict=True) if groups.root(s) != groups.root(d)]
            if not rows:
                continue
            line_of = {i: x for s, x, d, y in rows for i, x in ((s, x), (d, y))}
            place = {i: k for k, i in enumerate(line_of)}
            sets, out = ShingleSets(list(line_of.values())), []
            for s, _, d, _ in rows:
                if groups.root(s) != groups.root(d) and sets.similar(place[s], place[d], threshold):
                    groups.join(s, d)
                    out.append((s, d))
            columns = zip(*out, strict=True) if out else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["src", "dst"])

    return compare


def similar_lines(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(src, dst) ids of different lines with a Jaccard similarity of at least ``threshold``: enough to connect all such."""
    pairs, lines = _candidates_and_lines(docs, threshold)
    pairs = cut(pairs)
    told = ["size", *_SKETCH]
    a = lines.select(F.col("id").alias("src"), F.col("line").alias("a"), *[F.col(c).alias(f"a_{c}") for c in told])
    b = lines.select(F.col("id").alias("dst"), F.col("line").alias("b"), *[F.col(c).alias(f"b_{c}") for c in told])
    both = pairs.join(a, "src").join(b, "dst").filter(_may_be_similar(threshold)).select("src", "a", "dst", "b")
    return both.mapInArrow(_similar(threshold), "src long, dst long")


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "text"):
        rows, numbers, ids = [], [], []
        for row, text in enumerate(chunk.column(2).to_pylist()):
            for number, line in enumerate(lines_of(text)):
                if line:
                    rows.append(row)
                    numbers.append(number)
                    ids.append(line_id(line))
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [chunk.column(0).take(take), chunk.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(ids, pa.int64())],
            ["key", "doc_id", "line_no", "line_id"],
        )


def _marked(docs: DataFrame, threshold: float) -> DataFrame:
    """(key, doc_id, line_no, line_id, component_id, kept) of every line with a word of (key, doc_id, text)."""
    roots = component_roots(similar_lines(docs, threshold))
    # Documents that are equal in id and text count once.
    lines = docs.mapInArrow(_occurrences, "key long, doc_id long, line_no int, line_id long")
    lines = cut(
        lines.join(roots.withColumnRenamed("node", "line_id"), "line_id", "left").select(
            "key", "doc_id", "line_no", "line_id", F.coalesce("root", "line_id").alias("component_id")
        )
    )
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "line_no")
    firsts = lines.groupBy("component_id").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Cut, so that the join below is free to split what a frequent line brings; lines that occur once need none.
    firsts = cut(firsts.filter("n > 1").select("component_id", "first"))
    is_first = (F.col("key") == F.col("first.key")) & (F.col("line_no") == F.col("first.line_no"))
    return lines.join(firsts, "component_id", "left").select(
        "key",
        "doc_id",
        "line_no",
        "line_id",
        "component_id",
        F.coalesce(is_first, F.lit(True)).alias("kept"),
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def marked_lines(docs: DataFrame, threshold: float = SIMILARITY, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, line_no, line_id, component_id, kept) of every line with a word."""
    return _marked(_keyed(docs, id_col, text_col), threshold).drop("key")


def _without():
    """Drops the numbered lines (last column) from the text."""

    @F.arrow_udf("string")
    def keep(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts_, drops in pairs:
            out = []
            for text, drop in zip(texts_, drops, strict=True):
                gone = set(drop.as_py() or ())
                lines = (text.as_py() or "").split("\n")
                out.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
            yield pa.array(out, pa.string())

    return keep


def without_repeated_lines(
    docs: DataFrame, threshold: float = SIMILARITY, id_col="doc_id", text_col="text", count_col: str | None = None
) -> DataFrame:
    """``docs`` with only the kept lines in its texts; no row is dropped, and rows without drops keep their text.

    ``count_col`` names a column of text lengths in characters to set anew.
    """
    marked = _marked(_keyed(docs, id_col, text_col), threshold)
    drops = cut(
        marked.filter(~F.col("kept")).groupBy("key").agg(F.sort_array(F.collect_set("line_no")).alias("__drops"))
    ).withColumnRenamed("key", "__row_key")
    columns = docs.columns
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    keyed = docs.withColumn("__row_key", key)
    keyed = keyed.withColumn("__may", may_hold(bitmap_of(drops, "__row_key"))("__row_key"))
    same = keyed.filter(~F.col("__may")).select(*[f"`{c}`" for c in columns])
    joined = keyed.filter("__may").join(drops, "__row_key", "left")
    text = F.when(F.col("__drops").isNull(), F.col(text_col)).otherwise(
        _without()(F.col(text_col).cast("string"), "__drops")
    )
    edited = joined.withColumn(text_col, text)
    if count_col:
        edited = edited.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))
    return same.unionByName(edited.select(*[f"`{c}`" for c in columns]))
