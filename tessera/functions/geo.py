"""Geohashes and distances on a sphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_M = 6_371_008.8
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lng: Column, precision: int = 6) -> Column:
    """Longitude bit first; a value on a boundary belongs to the upper half."""
    bits = 5 * precision
    lng_bits, lat_bits = (bits + 1) // 2, bits // 2

    def cell(c: Column, low: float, span: float, n: int) -> Column:
        return F.least(F.greatest(F.floor((c - low) / span * (1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("long")

    x, y = cell(lng, -180.0, 360.0, lng_bits), cell(lat, -90.0, 180.0, lat_bits)
    letters = []
    for i in range(precision):
        value = F.lit(0)
        for j in range(5):
            k = 5 * i + j
            source, n = (x, lng_bits) if k % 2 == 0 else (y, lat_bits)
            value = value * 2 + F.shiftright(source, n - 1 - k // 2).bitwiseAND(1)
        letters.append(F.substring(F.lit(BASE32), 1, 32).substr((value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def decoded(code: str) -> tuple[float, float, float, float]:
    """Latitude, longitude and their errors; an unknown letter is an error."""
    lat, lng, even = [-90.0, 90.0], [-180.0, 180.0], True
    for c in code:
        value = BASE32.index(c)
        for bit in (16, 8, 4, 2, 1):
            span = lng if even else lat
            mid = sum(span) / 2
            span[0 if value & bit else 1] = mid
            even = not even
    return sum(lat) / 2, sum(lng) / 2, (lat[1] - lat[0]) / 2, (lng[1] - lng[0]) / 2


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """A box with west > east crosses the antimeridian."""
    wide = (lng >= west) | (lng <= east) if west > east else (lng >= west) & (lng <= east)
    return (lat >= south) & (lat <= north) & wide
