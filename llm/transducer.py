"""A vocabulary as a minimal acyclic transducer from terms to their lexicographic ordinals.

Sorted terms are added one by one; what no later term can change is merged with an equal state at once, so the
automaton is minimal when the last term is in, and never much larger before. An arc weighs the terms that sort before
all terms beyond it; a term's ordinal is the sum along its path. Arcs lie in one array in which the rows of all
states overlap, so that many terms can take a step together, by a few array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Starting cells that are tried at a time for a state with several arcs.
_TRIED = 128


class _Builder:
    """States as (accepting, arcs), each kept once; ``below`` counts the terms from a state on."""

    def __init__(self):
        self.states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        self.below: list[int] = []
        self._known: dict[tuple, int] = {}

    def frozen(self, accepting: bool, arcs: list[tuple[int, int]]) -> int:
        state = (accepting, tuple(arcs))
        number = self._known.get(state)
        if number is None:
            number = self._known[state] = len(self.states)
            self.states.append(state)
            self.below.append(accepting + sum(self.below[to] for _, to in arcs))
        return number

    def root_of(self, terms: Iterable[bytes]) -> int:
        accepting, arcs, last = [False], [[]], b""
        for term in terms:
            if term <= last and (last or accepting[0]):
                raise ValueError("terms must be sorted and different")
            shared = 0
            for x, y in zip(last, term, strict=False):
                if x != y:
                    break
                shared += 1
            self._close(last, shared, accepting, arcs)
            for _ in range(len(term) - shared):
                accepting.append(False)
                arcs.append([])
            accepting[-1] = True
            last = term
        self._close(last, 0, accepting, arcs)
        return self.frozen(accepting[0], arcs[0])

    def _close(self, last: bytes, depth: int, accepting: list, arcs: list) -> None:
        for at in range(len(last), depth, -1):
            arcs[at - 1].append((last[at - 1], self.frozen(accepting.pop(), arcs.pop())))


class Transducer:
    """Ordinals, from 0, of terms given as byte spans."""

    FIELDS = ("base", "accepting", "owner", "target", "weight")

    def __init__(self, root: int, **arrays: np.ndarray):
        self.root = root
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def of(cls, terms: Iterable[bytes]) -> Transducer:
        made = _Builder()
        root = made.root_of(terms)
        n_states = len(made.states)
        n_arcs = sum(len(arcs) for _, arcs in made.states)
        base = np.zeros(n_states, np.int32)
        accepting = np.array([a for a, _ in made.states], bool)
        # Room for every arc and a full row at both ends.
        size = 2 * n_arcs + 2 * 256 + _TRIED
        owner = np.full(size, -1, np.int32)
        target, weight = np.zeros(size, np.int32), np.zeros(size, np.int32)
        free = np.ones(size, bool)
        lowest = 256
        # Where the last state with as many arcs was put: cells before it rarely fit another.
        reached: dict[int, int] = {}
        for number in sorted(range(n_states), key=lambda s: -len(made.states[s][1])):
            arcs = made.states[number][1]
            if not arcs:
                continue
            labels = np.array([b for b, _ in arcs])
            while not free[lowest]:
                lowest += 1
            at = (lowest if len(arcs) == 1 else max(lowest, reached.get(len(arcs), 0))) - int(labels[0])
            while len(arcs) > 1:
                rows = np.arange(at, at + _TRIED)
                while rows[-1] + 256 >= len(free):
                    free = np.concatenate([free, np.ones(size, bool)])
                fits = free[rows[:, None] + labels].all(axis=1)
                if fits.any():
                    at = int(rows[fits.argmax()])
                    break
                at += _TRIED
            cells = at + labels
            reached[len(arcs)] = int(cells[0])
            if cells[-1] >= len(owner):
                more = len(free) - len(owner)
                owner = np.concatenate([owner, np.full(more, -1, np.int32)])
                target, weight = (np.concatenate([x, np.zeros(more, np.int32)]) for x in (target, weight))
            base[number] = at
            free[cells] = False
            owner[cells] = number
            passed = int(accepting[number])
            for cell, (_, to) in zip(cells.tolist(), arcs, strict=True):
                target[cell], weight[cell] = to, passed
                passed += made.below[to]
        used = int(np.flatnonzero(~free)[-1]) + 1 if n_arcs else 0
        # A state that owns no cell at its look-up rejects; 512 more cells keep every look-up inside.
        owner = np.concatenate([owner[:used], np.full(512, -1, np.int32)])
        target, weight = (np.concatenate([x[:used], np.zeros(512, np.int32)]) for x in (target, weight))
        return cls(root, base=base, accepting=accepting, owner=owner, target=target, weight=weight)

    def ordinals(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of each span's bytes, -1 where they are no term; all spans take each step together."""
        out = np.full(len(starts), -1, np.int64)
        alive = np.arange(len(starts))
        at, end = starts.astype(np.int64), ends.astype(np.int64)
        state = np.full(len(starts), self.root, np.int32)
        ordinal = np.zeros(len(starts), np.int32)
        while len(alive):
            done = at == end
            if done.any():
                accepted = done & self.accepting[state]
                out[alive[accepted]] = ordinal[accepted]
                go = ~done
                alive, at, end, state, ordinal = alive[go], at[go], end[go], state[go], ordinal[go]
                if not len(alive):
                    break
            cell = self.base[state] + values[at]
            go = self.owner[cell] == state
            if not go.all():
                alive, at, end, cell, ordinal = alive[go], at[go], end[go], cell[go], ordinal[go]
            ordinal += self.weight[cell]
            state = self.target[cell]
            at = at + 1
        return out

    def as_bytes(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in self.FIELDS}

    @classmethod
    def from_bytes(cls, root: int, parts: dict[str, bytes]) -> Transducer:
        kinds = {"accepting": bool}
        return cls(root, **{n: np.frombuffer(parts[n], kinds.get(n, np.int32)) for n in cls.FIELDS})
