"""Per-batch search for dwell windows; Spark decides which rows a call sees."""

from __future__ import annotations

import copy
import math

import numpy as np

from dwellgrid.functions.geo import DISTANCE_TICKS, EARTH_RADIUS

# Rows of a box; a distance bound this far below the reach is surely within it, rounding included.
_BOX_ROWS = 1024
_SURELY = 0.01

# Means are taken of whole pico-degrees.
PICO = 1e12

# Fractions of a candidate window that are probed before it is walked in full.
_PROBES = (1.0, 0.5, 0.25, 0.75)


class Track:
    """Rows of whole trajectories laid end to end, ready for distance tests."""

    def __init__(self, lat, lon, seconds, known, reach: float, dwell: float, exact: bool):
        self.lat = np.radians(lat)
        self.lon = np.radians(lon)
        self.cos = np.cos(self.lat)
        self.seconds = seconds
        self.known = known
        self.reach = reach
        self.dwell = dwell
        self.exact = exact
        self._boxes = None

    def part(self, start: int, stop: int) -> Track:
        """The same track, rows [start, stop) only."""
        sub = copy.copy(self)
        for name in ("lat", "lon", "cos", "seconds", "known"):
            setattr(sub, name, getattr(self, name)[start:stop])
        sub._boxes = None
        return sub

    def unordered(self) -> bool:
        """Whether a time is unknown or runs backwards."""
        return bool((~self.known).any() or (np.diff(self.seconds) < 0).any())

    def _surely_near(self, anchor: int, first: int, last: int) -> np.ndarray:
        """Whether all rows of each box [first, last) lie within reach of the anchor.

        Along the anchor's parallel and then a meridian is never shorter than the great circle.
        """
        if self._boxes is None:
            edges = np.arange(0, len(self.lat), _BOX_ROWS)
            self._boxes = [f.reduceat(v, edges) for v in (self.lat, self.lon) for f in (np.minimum, np.maximum)]
        south, north, west, east = (b[first:last] for b in self._boxes)
        up = np.maximum(north - self.lat[anchor], self.lat[anchor] - south)
        over = np.maximum(east - self.lon[anchor], self.lon[anchor] - west)
        return EARTH_RADIUS * (up + self.cos[anchor] * over) <= self.reach - _SURELY

    def near(self, i, j):
        """Whether rows i and j lie within reach (index arrays or slices)."""
        u = np.sin((self.lat[i] - self.lat[j]) / 2)
        v = np.sin((self.lon[i] - self.lon[j]) / 2)
        h = u * u + self.cos[i] * self.cos[j] * v * v
        d = 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
        if not self.exact:
            d = np.floor(d * DISTANCE_TICKS + 0.5) // DISTANCE_TICKS
        return d <= self.reach

    def leaves_at(self, anchor: int, start: int, stop: int) -> int:
        """First row in [start, stop) out of the anchor's reach, else ``stop``.

        In long windows, boxes of rows that surely lie within reach are passed over.
        """
        first, last = -(-start // _BOX_ROWS), stop // _BOX_ROWS
        if last - first > 4:
            left = self._walk_to(anchor, start, first * _BOX_ROWS)
            if left < first * _BOX_ROWS:
                return left
            for box in np.flatnonzero(~self._surely_near(anchor, first, last)) + first:
                upto = int(box + 1) * _BOX_ROWS
                left = self._walk_to(anchor, int(box) * _BOX_ROWS, upto)
                if left < upto:
                    return left
            start = last * _BOX_ROWS
        return self._walk_to(anchor, start, stop)

    def _walk_to(self, anchor: int, start: int, stop: int) -> int:
        step = 64
        while start < stop:
            upto = min(start + step, stop)
            inside = self.near(anchor, slice(start, upto))
            if not inside.all():
                return start + int(inside.argmin())
            start, step = upto, step * 2
        return stop

    def lasts(self, anchor: int, stop: int) -> bool:
        """Whether the window [anchor, stop) is a stay; an unknown time gives no gap."""
        gap = 0
        if self.known[anchor] and self.known[stop - 1]:
            gap = abs(int(self.seconds[stop - 1]) - int(self.seconds[anchor]))
        return stop - anchor > 1 and gap >= self.dwell

    def stays(self, firsts) -> tuple[np.ndarray, np.ndarray]:
        """Start and end rows of all stays; ``firsts`` are the trajectories' first rows."""
        n = len(self.seconds)
        firsts = np.asarray(firsts, dtype=np.int64)
        sizes = np.diff(np.append(firsts, n))
        track = np.repeat(np.arange(len(firsts)), sizes)
        last = np.repeat(firsts + sizes, sizes)

        back = np.zeros(n, dtype=bool)
        back[1:] = (np.diff(self.seconds) < 0) & (track[1:] == track[:-1])
        unordered = np.zeros(len(firsts), dtype=bool)
        unordered[track[back | ~self.known]] = True

        # A window is a stay only if it still holds the first row that is `dwell` later,
        # so that row (and some between) is tested for all anchors at once.
        wait = max(0, math.ceil(self.dwell))
        clock = self.seconds - self.seconds.min()
        key = track * (int(clock.max()) + wait + 2) + clock
        if unordered.any():
            key = np.maximum.accumulate(key)
        rows = np.arange(n)
        needed = np.maximum(np.searchsorted(key, key + wait, side="left"), rows + 1)
        anchors = rows[(needed < last) & ~unordered[track]]
        for part in _PROBES:
            span = needed[anchors] - anchors
            anchors = anchors[self.near(anchors, anchors + np.ceil(span * part).astype(np.int64))]

        found = []
        k = 0
        while k < len(anchors):
            a = int(anchors[k])
            stop = self.leaves_at(a, a + 1, int(last[a]))
            if stop > needed[a]:
                found.append((a, stop))
                k = int(np.searchsorted(anchors, stop, side="left"))
            else:
                k += 1

        for g in np.nonzero(unordered)[0]:
            found.extend(self.walk(int(firsts[g]), int(firsts[g] + sizes[g]))[0])
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        found.sort()
        starts, ends = np.array(found, dtype=np.int64).T
        return starts, ends

    def walk(self, row: int, stop: int) -> tuple[list[tuple[int, int]], list[int], int]:
        """Anchor by anchor, where the clock runs backwards or is unknown somewhere.

        Behind a window that is no stay the search goes on at the next row that lies within reach of the row
        that closed the window (at the end: of the last row). Returns the stays, the anchors, and the first
        anchor whose window holds the last row.
        """
        found, anchors, holding = [], [], stop - 1
        together = self._together_from(row, stop)
        while row < stop - 1:
            if row >= together:
                # All rows that are left lie within reach of each other, so every window runs to the end.
                holding = min(holding, row)
                long = self._long_to_end(row, stop)
                anchors.extend(range(row, long + 1))
                if long < stop - 1:
                    found.append((long, stop))
                return found, anchors, holding
            anchors.append(row)
            left = self.leaves_at(row, row + 1, stop)
            if left == stop:
                holding = min(holding, row)
            if self.lasts(row, left):
                found.append((row, left))
                row = left
            else:
                row = self._next_near(min(left, stop - 1), row + 1, left)
        if row == stop - 1:
            anchors.append(row)
        return found, anchors, holding

    def _next_near(self, closing: int, start: int, stop: int) -> int:
        """First row in [start, stop) within reach of ``closing``, else ``stop``."""
        step = 64
        while start < stop:
            upto = min(start + step, stop)
            inside = self.near(slice(start, upto), closing)
            if inside.any():
                return start + int(inside.argmax())
            start, step = upto, step * 2
        return stop

    def _together_from(self, row: int, stop: int) -> int:
        """The first row from which all up to ``stop`` surely lie within reach of each other."""

        def spread(v):
            back = v[row:stop][::-1]
            return (np.maximum.accumulate(back) - np.minimum.accumulate(back))[::-1]

        wide = EARTH_RADIUS * (spread(self.lat[:stop]) + spread(self.lon[:stop])) > self.reach - _SURELY
        return row + (int(np.flatnonzero(wide)[-1]) + 1 if wide.any() else 0)

    def _long_to_end(self, row: int, stop: int) -> int:
        """First row from which a window up to ``stop`` is a stay, else the last row."""
        known = self.known[row : stop - 1] & self.known[stop - 1]
        gap = np.where(known, np.abs(self.seconds[stop - 1] - self.seconds[row : stop - 1]), 0)
        long = np.flatnonzero(gap >= self.dwell)
        return row + int(long[0]) if len(long) else stop - 1


class Run:
    """The search over rows [start, stop) of one trajectory that may go on behind them.

    ``starts`` and ``ends`` are its stays before ``open``, the first anchor whose window
    still holds the last row. With ``final`` the trajectory ends here and nothing is open.
    """

    def __init__(self, track: Track, start: int, stop: int, final: bool):
        sub = track.part(start, stop)
        self._visited = None
        if sub.unordered():
            found, self._visited, first_open = sub.walk(0, stop - start)
            starts, ends = np.array(found, dtype=np.int64).reshape(-1, 2).T
        else:
            starts, ends = sub.stays([0])
            first_open = None if final else self._first_open(sub, starts, ends)
        self.open = stop if final else start + first_open
        sure = starts + start < self.open
        self.start, self.stop = start, stop
        self.starts, self.ends = starts[sure] + start, ends[sure] + start

    @staticmethod
    def _first_open(sub: Track, starts, ends) -> int:
        n = len(sub.lat)
        maybe = np.nonzero(sub.near(slice(0, n), n - 1))[0]
        middle = maybe + (n - 1 - maybe) // 2
        maybe = maybe[sub.near(maybe, middle)]
        for row in maybe:
            held = np.searchsorted(starts, row, side="left") - 1
            if held >= 0 and row < ends[held]:
                continue  # inside an earlier stay, so never an anchor
            if sub.leaves_at(int(row), int(row) + 1, n) == n:
                return int(row)
        return n - 1

    def anchors(self) -> np.ndarray:
        """Whether each row of [start, stop) is an anchor of this search, up to ``open``.

        While time rises, the rows that the search passes over could not begin a stay: they count as anchors.
        """
        is_anchor = np.ones(self.stop - self.start, dtype=bool)
        if self._visited is not None:
            is_anchor[:] = False
            is_anchor[self._visited] = True
        for a, b in zip(self.starts - self.start, self.ends - self.start):
            is_anchor[a + 1 : b] = False
        is_anchor[self.open - self.start + 1 :] = False
        return is_anchor


def mean_degrees(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[float]:
    """Means of spans from exact sums of whole pico-degrees: the same however rows are grouped."""
    whole = np.rint(values * PICO).astype(np.int64)
    # Two sums, as one of a million rows would not fit 64 bits.
    sums = np.zeros((2, len(values) + 1), dtype=np.int64)
    np.cumsum(whole // 1_000_000, out=sums[0, 1:])
    np.cumsum(whole % 1_000_000, out=sums[1, 1:])
    high, low = (sums[:, ends] - sums[:, starts]).tolist()
    counts = (ends - starts).tolist()
    return [float(h * 1_000_000 + m) / n / PICO for h, m, n in zip(high, low, counts)]
