"""Small inputs that hold every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import itertools
import zlib

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, line_no string"
BLANKS = " \t\n\r\x0b\x0c"
WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll lemur maple nylon onyx pearl quill raven".split()


def prose(seed: int, n: int) -> str:
    """Words in an order that depends on the seed; lines of eleven."""
    out, x = [], seed * 7919 + 1
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 7) * ((x >> 5) % 3 == 0))
        out.append("\n" if i % 11 == 10 else " ")
    return "".join(out)


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    long_text = prose(99, 30_000)
    rows = [
        (1, prose(1, 60)),
        (2, prose(1, 60)),
        (3, prose(1, 60).replace("amber", "AMBER")),
        (4, prose(2, 80)),
        (4, prose(2, 80)),
        (4, prose(3, 50)),
        (None, prose(4, 40)),
        (None, None),
        (5, None),
        (6, ""),
        (7, " \n\t\n "),
        (8, "12 34 !! ..."),
        (9, long_text),
        (10, long_text + " tail"),
        (11, "x"),
        (12, "<|startoftext|>it's<|endoftext|> 'S ΣΑΣ İ é z \U0001f642"),
        (13, prose(1, 60) + "\n" + prose(5, 33)),
    ]
    full = [
        (i, t, None if n % 5 == 0 else ("xx", "yy")[n % 2], None if n % 4 == 0 else "s", None, "k", n, None)
        for n, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def fingerprint(text: str | None) -> int:
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n: int, linked) -> list[int]:
    """The least member of each one's component; ``linked(i, j)`` tells of links."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if find(i) != find(j) and linked(i, j):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(n)]
