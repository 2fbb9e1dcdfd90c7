"""Distances on the globe and geohashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; fixed value.
EARTH_RADIUS = 6378137.0
_SIGNS = "0123456789bcdefghjkmnpqrstuvwxyz"


def valid(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def distance(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Metres between a column's points and one point (haversine); half the equator where a point is invalid."""
    a = F.pow(F.sin((F.radians(lat) - math.radians(lat0)) / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(F.sin((F.radians(lon) - math.radians(lon0)) / 2), 2)
    far = math.pi * EARTH_RADIUS
    return F.when(F.coalesce(valid(lon, lat), F.lit(False)), 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))).otherwise(F.lit(far))


def within(lon: Column, lat: Column, lon0: float, lat0: float, metres: float) -> Column:
    """Points at most so far away. A box of degrees comes first, as it can prune a scan."""
    dlat = math.degrees(metres / EARTH_RADIUS)
    box = lat.between(lat0 - dlat, lat0 + dlat)
    return box & (distance(lon, lat, lon0, lat0) <= metres)


def geohash(lon: Column, lat: Column, length: int = 8) -> Column:
    """The standard geohash: bits of longitude and latitude in turn, five to a sign."""
    n = 5 * length
    nx, ny = (n + 1) // 2, n // 2
    cell = lambda v, lo, width, bits: F.least(F.floor((v - lo) / width * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    x, y = cell(lon, -180.0, 360.0, nx), cell(lat, -90.0, 180.0, ny)
    signs = []
    for k in range(length):
        value = F.lit(0).cast("long")
        for i in range(5 * k, 5 * k + 5):
            source, bits, at = (x, nx, i // 2) if i % 2 == 0 else (y, ny, i // 2)
            value = value * 2 + F.shiftright(source, bits - 1 - at).bitwiseAND(F.lit(1))
        signs.append(F.substr(F.lit(_SIGNS), (value + 1).cast("int"), F.lit(1)))
    return F.when(valid(lon, lat), F.concat(*signs))
