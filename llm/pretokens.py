"""Texts as white-space separated pieces, so that a vocabulary is applied once to each different piece.

A blank or a line feed ends a word for the tokenizer wherever it stands, no added token holds one, and
neither composition nor lower-casing reaches across it. So the tokens of a text are those of its pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Different pieces a task remembers; at the limit it starts to collect anew. Results don't depend on it.
REMEMBERED = 600_000


def pieces(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class PieceMemory:
    """What ``compute`` returns for each piece, computed for the new pieces of many texts at once."""

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int = REMEMBERED):
        self._compute, self._most, self._known = compute, most, {}

    def lookup(self, lists: list[list[str]]) -> Callable:
        new = set().union(*lists).difference(self._known)
        if len(new) + len(self._known) > self._most:
            self._known.clear()
            new = set().union(*lists)
        # In a fixed order: sets of strings are ordered differently in every process.
        fresh = sorted(new)
        self._known.update(zip(fresh, self._compute(fresh), strict=True))
        return self._known.__getitem__
