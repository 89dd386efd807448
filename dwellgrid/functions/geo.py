"""Distances, projection, grid cells and rectangles as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius in metres and the Miller projection's constants.
EARTH_RADIUS = 6378137.0
MILLER_SPAN = 2.3
MILLER_OUTER = 1.25
MILLER_INNER = 0.4

# Distances are rounded to 1/10000 m before they are cut to whole metres.
DISTANCE_TICKS = 10000


def _col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def rad(degrees: Column | str) -> Column:
    return F.radians(_col(degrees))


def great_circle(lat1, lon1, lat2, lon2) -> Column:
    """Unrounded haversine distance in metres."""
    lat1, lon1, lat2, lon2 = (_col(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((F.radians(lat1) - F.radians(lat2)) / 2)
    half_lon = F.sin((F.radians(lon1) - F.radians(lon2)) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Rounding near antipodes can push h past 1, where asin has no value.
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_RADIUS)


def distance_m(lat1, lon1, lat2, lon2, exact: bool = False) -> Column:
    """Distance in whole metres (default) or exactly."""
    d = great_circle(lat1, lon1, lat2, lon2)
    if exact:
        return d
    ticks = F.floor(d * DISTANCE_TICKS + 0.5)
    return F.floor(ticks / DISTANCE_TICKS).cast("double")


def miller_x(lon) -> Column:
    return F.radians(_col(lon)) * EARTH_RADIUS + EARTH_RADIUS * math.pi


def miller_y(lat) -> Column:
    stretched = F.log(F.tan(F.radians(_col(lat)) * MILLER_INNER + math.pi / 4)) * MILLER_OUTER
    half_height = EARTH_RADIUS * math.pi / 2
    return F.lit(half_height) - stretched * (EARTH_RADIUS * math.pi / (2 * MILLER_SPAN))


def planar_distance_sq(x1, y1, x2, y2) -> Column:
    dx = _col(x1) - _col(x2)
    dy = _col(y1) - _col(y2)
    return dx * dx + dy * dy


def whole_seconds(ts) -> Column:
    """Wall-clock seconds since 1970, floored; no time zone or DST plays a part."""
    ts = _col(ts)
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def between_seconds(a, b) -> Column:
    """Absolute gap in whole seconds; 0 where either side is missing."""
    return F.coalesce(F.abs(whole_seconds(b) - whole_seconds(a)), F.lit(0).cast("bigint"))


def parse_ts(text) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to TIMESTAMP_NTZ, NULL where it does not parse."""
    return F.try_to_timestamp(_col(text), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def between_seconds_text(a, b) -> Column:
    return between_seconds(parse_ts(a), parse_ts(b))


def grid_index(v, side: float) -> Column:
    """Index of the grid stripe of width ``side`` holding ``v``."""
    return F.floor(_col(v) / F.lit(float(side)))


@dataclass(frozen=True)
class Rect:
    """Axis-parallel rectangle whose bounds are columns or numbers."""

    x: Column | str | float
    y: Column | str | float
    x2: Column | str | float
    y2: Column | str | float

    def contains_rect(self, other: Rect) -> Column:
        return (
            (_col(self.x) <= _col(other.x))
            & (_col(self.y) <= _col(other.y))
            & (_col(self.x2) >= _col(other.x2))
            & (_col(self.y2) >= _col(other.y2))
        )

    def contains(self, px, py) -> Column:
        return _col(px).between(_col(self.x), _col(self.x2)) & _col(py).between(
            _col(self.y), _col(self.y2)
        )

    def contains_strictly(self, px, py) -> Column:
        px, py = _col(px), _col(py)
        return (px > _col(self.x)) & (px < _col(self.x2)) & (py > _col(self.y)) & (py < _col(self.y2))

    def inset(self, amount) -> Rect:
        """Move every side inwards; a negative amount grows the rectangle."""
        a = _col(amount)
        return Rect(_col(self.x) + a, _col(self.y) + a, _col(self.x2) - a, _col(self.y2) - a)
