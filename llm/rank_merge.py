"""Rank-synchronous merging: a byte-level word vocabulary applied to ragged arrays of symbols."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

_NEVER = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all members of spans that lie one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class PairTable:
    """Ranks of symbol pairs in a hash table of two halves: a pair stands in either, so two looks settle it."""

    _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, keys: list[int]):
        self._shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self._shift))
        self._keys = np.full((2, size), -1, np.int64)
        self._ranks = np.full((2, size), _NEVER, np.int64)
        slots = [self._slot(np.array(keys, np.int64), half).tolist() for half in (0, 1)]
        held: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for rank in range(len(keys)):
            moving, half = rank, 0
            for _ in range(200):
                slot = slots[half][moving]
                moving_out = held[half].get(slot)
                held[half][slot] = moving
                if moving_out is None:
                    break
                moving, half = moving_out, 1 - half
            else:
                raise ValueError("the vocabulary's pairs don't fit the table")
        for half in (0, 1):
            at, ranks = np.array(list(held[half]), np.int64), np.array(list(held[half].values()), np.int64)
            self._keys[half, at], self._ranks[half, at] = np.array(keys, np.int64)[ranks], ranks

    def _slot(self, keys: np.ndarray, half: int) -> np.ndarray:
        return ((keys.view(np.uint64) * self._MIX[half]) >> self._shift).view(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        first = self._slot(keys, 0)
        out = np.where(self._keys[0, first] == keys, self._ranks[0, first], _NEVER)
        open_ = np.flatnonzero(out == _NEVER)
        second = self._slot(keys[open_], 1)
        out[open_] = np.where(self._keys[1, second] == keys[open_], self._ranks[1, second], _NEVER)
        return out


class RankMerger:
    """A byte-level word vocabulary (a ``tokenizers`` JSON file), applied to many pieces at once."""

    def __init__(self, path: str):
        self._path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self._inner = np.array([vocab[s] for s in symbols], np.int64)
        self._last = np.array([vocab[s + end] for s in symbols], np.int64)
        self._size = len(vocab)
        merges = model["merges"]
        self._pairs = PairTable([vocab[a] * self._size + vocab[b] for a, b in merges])
        self._made = np.array([vocab[a + b] for a, b in merges], np.int64)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile("\n|" + split)
        self._added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self._added else None

    def encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each); pieces hold no blanks or line feeds."""
        joined = "\n".join(new)
        if self._marks and self._marks.search(joined):
            return self._encode_with_added(new)
        strange = {c for c in set(joined) if unicodedata.category(c) == "Cn"}
        if strange:
            return self._encode_strange(new, strange)
        joined = unicodedata.normalize("NFC", joined)
        # Letter by letter where the lower case of a string depends on a letter's neighbours.
        low = joined.lower() if "\u03a3" not in joined else "".join(c.lower() for c in joined)
        number = {"\n": 0}
        found = np.array([number.setdefault(w, len(number)) for w in self._words.findall(low)], np.int64)
        if len(number) == 1:
            return np.zeros(0, np.int64), np.zeros(len(new), np.int64)
        ids, counts = self.merged([w.encode() for w in list(number)[1:]])
        counts = np.concatenate([[0], counts])
        lengths = counts[found]
        per_piece = np.bincount(np.cumsum(found == 0), lengths, len(new)).astype(np.int64)
        return ids[ragged((np.cumsum(counts) - counts)[found], lengths)], per_piece

    def _encode_with_added(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What stands between added tokens is normalised and split on its own."""
        split = [self._marks.split(piece) for piece in new]
        parts = [part for s in split for part in s]
        ids, counts = self.encode(["" if part in self._added else part for part in parts])
        at = np.array([i for i, part in enumerate(parts) if part in self._added], np.int64)
        places = (np.cumsum(counts) - counts)[at]
        ids = np.insert(ids, places, [self._added[parts[i]] for i in at])
        counts[at] = 1
        owner = np.repeat(np.arange(len(new)), [len(s) for s in split])
        return ids, np.bincount(owner, counts, len(new)).astype(np.int64)

    def _encode_strange(self, new: list[str], strange: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of code points without a category here, only the vocabulary's own library knows where they split."""
        odd = {i for i, piece in enumerate(new) if not strange.isdisjoint(piece)}
        ids, counts = self.encode(["" if i in odd else piece for i, piece in enumerate(new)])
        library = Tokenizer.from_file(self._path)
        found = {i: library.encode(new[i], add_special_tokens=False).ids for i in sorted(odd)}
        ends = np.cumsum(counts)
        ids = np.insert(ids, [ends[i] for i, own in found.items() for _ in own], [x for own in found.values() for x in own])
        for i, own in found.items():
            counts[i] = len(own)
        return ids.astype(np.int64), counts

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols left of all words, number of each) when no pair can be merged any more."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self._inner[flat]
        symbols[ends - 1] = self._last[flat[ends - 1]]
        final, done = lengths.copy(), []
        open_words = np.arange(len(words))
        while len(open_words):
            starts = np.cumsum(lengths) - lengths
            ranks = self._pair_ranks(symbols, starts[1:] - 1)
            least = np.minimum.reduceat(ranks, starts)
            going = least < _NEVER
            # Words without a pair leave; the others merge theirs.
            stays = np.repeat(going, lengths)
            final[open_words[~going]] = lengths[~going]
            done.append((open_words[~going], symbols[~stays]))
            open_words, lengths = open_words[going], lengths[going]
            if not len(open_words):
                break
            symbols, ranks = symbols[stays], ranks[stays]
            merge = _first_of_overlaps(ranks == np.repeat(least[going], lengths))
            symbols[merge] = self._made[ranks[merge]]
            gone = np.zeros(len(symbols), bool)
            gone[1:] = merge[:-1]
            symbols = symbols[~gone]
            lengths = lengths - np.add.reduceat(gone, np.cumsum(lengths) - lengths, dtype=np.int64)
        starts = np.cumsum(final) - final
        out = np.empty(int(final.sum()), np.int64)
        for which, left in done:
            out[ragged(starts[which], final[which])] = left
        return out, final

    def _pair_ranks(self, symbols: np.ndarray, word_ends: np.ndarray) -> np.ndarray:
        """Rank of each symbol with its right neighbour in the word."""
        ranks = np.full(len(symbols), _NEVER, np.int64)
        ranks[:-1] = self._pairs.ranks(symbols[:-1] * self._size + symbols[1:])
        ranks[word_ends] = _NEVER
        return ranks


def _first_of_overlaps(marks: np.ndarray) -> np.ndarray:
    """Of a run of marks (a symbol repeated) every second one from the left: pairs may not overlap."""
    if not (marks[1:] & marks[:-1]).any():
        return marks
    place = np.arange(len(marks))
    run_start = np.maximum.accumulate(np.where(marks, -1, place))
    return marks & ((place - run_start) % 2 == 1)


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)
