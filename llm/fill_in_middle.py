"""Fill-in-the-middle examples, cut by rank and select over UTF-8 bytes in 64-bit words.

A text's bytes are viewed as uint64 words, eight bytes each. Arithmetic on whole words marks, by the top bit of each
byte, where a unit ends: units are runs of ASCII letters and all other single code points. ``bitwise_count`` per word
and a running sum give the units of every text; the word that holds the k-th unit's end is found by binary search in
that sum, and the byte in it by a select inside the word. Texts are never decoded or split into lists, and nothing is
shuffled.

* A null text is an empty one: 0 units, form ``plain``.
* A null id is hashed as an empty id. Repeated rows give repeated results. Other columns are ignored. No rows: no rows.
* A text that holds a marker itself stays plain, so that every output can be taken apart again.
* Texts are never cut. Memory is some eight times the longest text, or that of a chunk of 1 MB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.arrays import chunks, text_bytes
from llm.tables import texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
_SEVEN = np.uint64(0x7F7F7F7F7F7F7F7F)
_CASE = np.uint64(0x2020202020202020)
#: Added to a byte of at most 0x7F, these reach the top bit from "a" on, and from behind "z" on.
_FROM_A = _ONES * np.uint64(0x80 - ord("a"))
_PAST_Z = _ONES * np.uint64(0x80 - ord("z") - 1)
#: Words that are marked at a time: temporary arrays stay this small for a text of any length.
_BLOCK = 1 << 16

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def _shifted(marks: np.ndarray) -> np.ndarray:
    """Each byte's mark becomes that of the byte before it; the last word looks at nothing."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def _marked(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Top bits of the bytes that end a unit, and of those that begin a code point."""
    inner = words & ~(words << np.uint64(1)) & _TOPS
    folded = (words | _CASE) & _SEVEN
    letter = (folded + _FROM_A) & ~(folded + _PAST_Z) & ~words & _TOPS
    goes_on = _shifted(inner) | (letter & _shifted(letter))
    return ~goes_on & _TOPS, ~inner & _TOPS


class UnitIndex:
    """Rank and select of unit ends in a list of texts, each padded to whole words with a zero byte at least."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        self.first = np.concatenate([[0], np.cumsum(lengths // 8 + 1)])
        padded = np.zeros(8 * int(self.first[-1]), np.uint8)
        for at, a, b in zip((8 * self.first).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=False):
            padded[at : at + b - a] = values[a:b]
        words = padded.view("<u8")
        self.ends, self.starts = np.empty_like(words), np.empty_like(words)
        for at in range(0, len(words), _BLOCK):
            # One word more, so that the last byte of the block sees its follower.
            ends, starts = _marked(words[at : at + _BLOCK + 1])
            self.ends[at : at + _BLOCK], self.starts[at : at + _BLOCK] = ends[:_BLOCK], starts[:_BLOCK]
        if len(lengths):
            last = self.first[1:] - 1
            real = (np.uint64(1) << (8 * (lengths % 8)).astype(np.uint64)) - np.uint64(1)
            self.ends[last] &= real
            self.starts[last] &= real
        self._ends_before = self._running(self.ends)
        self._starts_before = self._running(self.starts)
        self.n_units = np.diff(self._ends_before[self.first])

    @staticmethod
    def _running(marks: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=sums[1:])
        return sums

    def end_of(self, k: np.ndarray) -> np.ndarray:
        """For each text, the number of bytes up to the end of its ``k``-th unit; 0 units end at 0."""
        base = self._ends_before[self.first[:-1]]
        word = np.searchsorted(self._ends_before, base + k, side="left") - 1
        word = np.where(k > 0, word, self.first[:-1])
        wanted = np.maximum(base + k - self._ends_before[word], 1).astype(np.uint64)
        # Marks up to each byte of the word, then the bytes that have not reached the wanted number.
        upto = (self.ends[word] >> np.uint64(7)) * _ONES
        reached = (upto + _ONES * (np.uint64(0x80) - wanted)) & _TOPS
        end = 8 * (word - self.first[:-1]) + 9 - np.bitwise_count(reached)
        return np.where(k > 0, end, 0)

    def chars_up_to(self, end: np.ndarray) -> np.ndarray:
        """For each text, the code points that begin in its first ``end`` bytes."""
        word = self.first[:-1] + end // 8
        below = (np.uint64(1) << (8 * (end % 8)).astype(np.uint64)) - np.uint64(1)
        inside = np.bitwise_count(self.starts[word] & below)
        return self._starts_before[word] - self._starts_before[self.first[:-1]] + inside


def _draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that depend on the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def assembled(form: str, text: bytes, a: int, b: int) -> bytes:
    """The example of a text whose middle is ``text[a:b]``."""
    if form == PLAIN:
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == PSM:
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(form: str, output: bytes) -> bytes:
    """The text of an example, found from its markers alone."""
    if form == PLAIN:
        return output
    second = PREFIX if form == SPM else SUFFIX
    at = output.index(second)
    to = output.index(MIDDLE, at)
    one, two, middle = output[len(PREFIX) : at], output[at + len(second) : to], output[to + len(MIDDLE) :]
    return one + middle + two if form == PSM else two + middle + one


def _examples(seed: int, plain_from: int, spm_below: int, digests: bool):
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            values, offsets = text_bytes(chunk.column(1))
            index = UnitIndex(values, offsets)
            ids = chunk.column(0).to_pylist()
            h = np.array([_draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
            cuts = np.sort(h[:, :2] % (index.n_units + 1)[:, None], axis=1)
            a, b = index.end_of(cuts[:, 0]), index.end_of(cuts[:, 1])
            to_a, to_b = index.chars_up_to(a), index.chars_up_to(b)
            forms, outputs, hashes = [], [], []
            data = memoryview(values)
            for row in range(len(ids)):
                text = bytes(data[offsets[row] : offsets[row + 1]])
                form = SPM if h[row, 3] % 100 < spm_below else PSM
                if not text or h[row, 2] % 100 >= plain_from or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    form = PLAIN
                output = assembled(form, text, int(a[row]), int(b[row]))
                forms.append(form)
                if digests:
                    hashes.append(
                        (hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(form, output)).hexdigest())
                    )
                else:
                    outputs.append(output)
            plain = np.array([f == PLAIN for f in forms], bool)
            columns = [
                chunk.column(0),
                pa.array(index.n_units),
                pa.array(forms, pa.string()),
                pa.array(to_a, pa.int64(), mask=plain),
                pa.array(to_b - to_a, pa.int64(), mask=plain),
            ]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
            if digests:
                columns += [pa.array([d[i] for d in hashes], pa.string()) for i in (0, 1)]
                names += ["output_sha256", "restored_sha256"]
            else:
                columns.append(pa.array(outputs, pa.binary()))
                names.append("output")
            yield pa.RecordBatch.from_arrays(columns, names)

    return make


def examples(
    docs: DataFrame,
    seed: int = 1,
    plain_from: int = 90,
    spm_below: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; output is UTF-8 text.

    Of 100 texts ``100 - plain_from`` stay plain, and of 100 others ``spm_below`` give the suffix first.
    """
    made = texts(docs, id_col, text_col).mapInArrow(_examples(seed, plain_from, spm_below, False), SCHEMA)
    return made.withColumn("output", made["output"].cast("string"))


def example_digests(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The examples with the SHA-256 of the output, and of the text taken from it again, in place of the output."""
    schema = SCHEMA.replace("output binary", "output_sha256 string, restored_sha256 string")
    return texts(docs, id_col, text_col).mapInArrow(_examples(seed, 90, 20, True), schema)


#: DuckDB SQL for the rows of ``example_digests`` over ``documents``.
ORACLE_SQL = r"""
WITH u AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents
), h AS (
    SELECT *, len(units) AS n,
           CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
           CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
    FROM u
), c AS (
    SELECT doc_id, text, n,
           array_to_string(units[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
           array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
           array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 : n], '') AS s,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM c
"""
