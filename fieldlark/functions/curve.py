"""A Z-order key of places, and circles as a few ranges of it.

Latitude and longitude are cut into cells and the bits of both cell numbers are
interleaved, so places that are near share leading bits. Stored in the order of this key,
files and row groups are small tiles; a circle is then covered by a few ranges of keys,
plain comparisons that a scan can skip row groups by on both axes at once.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from fieldlark.functions.geo import EARTH_RADIUS_KM

BITS = 20  # a side: cells of about 19 m by 38 m at the equator
MOST_RANGES = 16

# fixed values: masks that move bit i of a number to bit 2 * i, in steps
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


class Box(NamedTuple):
    """Degrees; west is not east of east."""

    south: float
    north: float
    west: float
    east: float


def _cell(value: Column, least: float, extent: float) -> Column:
    place = (value - F.lit(least)) / F.lit(extent) * F.lit(float(1 << BITS))
    clipped = F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(float((1 << BITS) - 1)))).cast("long")
    return F.when(value.isNotNull() & ~F.isnan(value), clipped)  # greatest and least pass over nulls


def _spread_bits(number: Column) -> Column:
    return reduce(lambda x, step: x.bitwiseOR(F.shiftleft(x, step[0])).bitwiseAND(F.lit(step[1])), SPREAD, number)


def z_key(lat: Column, lon: Column) -> Column:
    """Key of a place; null without coordinates or with one that is no number. What lies outside counts as the edge."""
    return F.shiftleft(_spread_bits(_cell(lat, -90.0, 180.0)), 1).bitwiseOR(_spread_bits(_cell(lon, -180.0, 360.0)))


def boxes_around(lat: float, lon: float, radius_km: float) -> list[Box]:
    """One or two boxes that hold the circle: two where it crosses the date line, all longitudes where it holds a pole."""
    angle = radius_km / EARTH_RADIUS_KM
    d_lat = math.degrees(angle) + 1e-9
    south, north = max(lat - d_lat, -90.0), min(lat + d_lat, 90.0)
    reach = math.sin(min(angle, math.pi / 2)) / max(math.cos(math.radians(lat)), 1e-12)
    if lat - d_lat <= -90 or lat + d_lat >= 90 or reach >= 1:
        return [Box(south, north, -180.0, 180.0)]
    d_lon = math.degrees(math.asin(reach)) + 1e-9
    west, east = lon - d_lon, lon + d_lon
    if west < -180:
        return [Box(south, north, -180.0, east), Box(south, north, west + 360, 180.0)]
    if east > 180:
        return [Box(south, north, west, 180.0), Box(south, north, -180.0, east - 360)]
    return [Box(south, north, west, east)]


def _number(value: float, least: float, extent: float) -> int:
    return math.floor(min(max((value - least) / extent * float(1 << BITS), 0.0), float((1 << BITS) - 1)))


def ranges_of(boxes: list[Box], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most *most* ranges of keys that hold every place in the boxes.

    Tiles are split while they stick out of the boxes and the number of pieces allows; then the smallest gaps are closed.
    """
    cells = [(_number(b.south, -90.0, 180.0), _number(b.north, -90.0, 180.0),
              _number(b.west, -180.0, 360.0), _number(b.east, -180.0, 360.0)) for b in boxes]

    def relation(y: int, x: int, side: int) -> int:
        """0 apart, 1 partly inside, 2 inside one box."""
        found = 0
        for south, north, west, east in cells:
            if y > north or y + side - 1 < south or x > east or x + side - 1 < west:
                continue
            found = 1
            if south <= y and y + side - 1 <= north and west <= x and x + side - 1 <= east:
                return 2
        return found

    open_, whole = [(0, 0, 0, 1 << BITS)], []  # key, y, x, side
    while open_ and open_[0][3] > 1 and len(open_) + len(whole) <= 4 * most:
        halves = []
        for key, y, x, side in open_:
            half = side // 2
            for i, (dy, dx) in enumerate(((0, 0), (0, half), (half, 0), (half, half))):
                tile = key + i * half * half, y + dy, x + dx, half
                inside = relation(*tile[1:])
                if inside:
                    (whole if inside == 2 else halves).append(tile)
        open_ = halves
    ranges: list[tuple[int, int]] = []
    for low, high in sorted((key, key + side * side - 1) for key, _, _, side in open_ + whole):
        if ranges and low <= ranges[-1][1] + 1:
            ranges[-1] = ranges[-1][0], max(high, ranges[-1][1])
        else:
            ranges.append((low, high))
    while len(ranges) > most:
        i = min(range(len(ranges) - 1), key=lambda i: ranges[i + 1][0] - ranges[i][1])
        ranges[i:i + 2] = [(ranges[i][0], ranges[i + 1][1])]
    return ranges


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [key.between(low, high) for low, high in ranges])


def near(key: Column, lat: float, lon: float, radius_km: float) -> Column:
    """Plain comparisons that every place within the radius satisfies."""
    return in_ranges(key, ranges_of(boxes_around(lat, lon, radius_km)))
