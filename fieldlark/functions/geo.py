"""Distances, bounding boxes and grid keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0

# fixed values: the default place of the nearby query
DEFAULT_LAT = 55.6918
DEFAULT_LON = 12.5559
DEFAULT_RADIUS_KM = 2.0


def haversine_km(lat: Column, lon: Column, from_lat: float, from_lon: float) -> Column:
    """Great-circle distance from a fixed point."""
    north = F.sin(F.radians(lat - F.lit(from_lat)) / 2)
    east = F.sin(F.radians(lon - F.lit(from_lon)) / 2)
    chord = north * north + F.cos(F.radians(lat)) * F.lit(math.cos(math.radians(from_lat))) * east * east
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def inside_box(lat: Column, lon: Column, from_lat: float, from_lon: float, radius_km: float) -> Column:
    """Plain range predicate that every point within the radius satisfies.

    Made of comparisons with literals, so it reaches the file scan. The box is
    split where it crosses the date line and spans all longitudes at a pole.
    """
    angle = radius_km / EARTH_RADIUS_KM
    slack = 1e-9
    d_lat = math.degrees(angle) + slack
    south, north = from_lat - d_lat, from_lat + d_lat
    in_lat = lat.between(south, north)
    reach = math.sin(min(angle, math.pi / 2)) / max(math.cos(math.radians(from_lat)), 1e-12)
    if south <= -90 or north >= 90 or reach >= 1:
        return in_lat
    d_lon = math.degrees(math.asin(reach)) + slack
    west, east = from_lon - d_lon, from_lon + d_lon
    if west < -180:
        return in_lat & ((lon >= west + 360) | (lon <= east))
    if east > 180:
        return in_lat & ((lon >= west) | (lon <= east - 360))
    return in_lat & lon.between(west, east)


def grid_key(lat: Column, lon: Column) -> Column:
    """Key of the roughly 10 m cell: four decimals, '-' as N and '.' as p.

    Half-way values round on their decimal text (0.00005 -> 0.0001).
    """
    return F.translate(F.format_string("%.4f_%.4f", lat, lon), "-.", "Np")
