"""Distances and geohashes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the digits of geohashes.
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_M, EARTH_KM = 6_371_000.0, 6_371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance, in the unit of the radius."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """The geohash of 1 to 12 digits: bits of longitude and latitude in turn, longitude first, five to a digit."""
    if not 1 <= precision <= 12:
        raise ValueError("precision is 1 to 12")
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2

    def cell(x: Column, low: float, span: float, n: int) -> Column:
        return F.greatest(F.least(F.floor((x - low) / span * float(1 << n)), F.lit((1 << n) - 1)), F.lit(0)).cast("bigint")

    x, y = cell(lon, -180.0, 360.0, lon_bits), cell(lat, -90.0, 180.0, lat_bits)
    digits = []
    for d in range(precision):
        value = F.lit(0).cast("bigint")
        for b in range(5 * d, 5 * d + 5):
            source, place = (x, lon_bits - 1 - b // 2) if b % 2 == 0 else (y, lat_bits - 1 - b // 2)
            value = value * 2 + F.shiftright(source, place).bitwiseAND(1)
        digits.append(F.substr(F.lit(GEOHASH_DIGITS), value.cast("int") + 1, F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*digits))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a place lies in the box. Boxes are right side up and within 85 degrees of latitude."""
    if south > north or west > east or south < -85 or north > 85:
        raise ValueError("the box is upside down or beyond 85 degrees")
    return lat.between(south, north) & lon.between(west, east)
