"""Morton codes and distances as Column expressions; all stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# Masks that spread 16 bits over 32, by shift.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def part1by1(x: Column) -> Column:
    """The low 16 bits of a long, a zero before each."""
    x = x.bitwiseAND(F.lit(0xFFFF).cast("long"))
    for shift, mask in SPREAD:
        x = x.bitwiseXOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def compact1by1(x: Column) -> Column:
    """Every second bit of a long, from the lowest: the inverse of part1by1."""
    x = x.bitwiseAND(F.lit(0x55555555).cast("long"))
    for (shift, _), mask in zip(reversed(SPREAD), (0x33333333, 0x0F0F0F0F, 0x00FF00FF, 0x0000FFFF)):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def quantised(c: Column) -> Column:
    """A coordinate of [0, 1] on 16 bits."""
    return F.floor(c * 65535 + 0.5).cast("long")


def dequantised(q: Column) -> Column:
    return q / F.lit(65535.0)


def morton_encode(qx: Column, qy: Column) -> Column:
    return F.shiftleft(part1by1(qy), 1) + part1by1(qx)


def morton_decode_x(code: Column) -> Column:
    return compact1by1(code)


def morton_decode_y(code: Column) -> Column:
    return compact1by1(F.shiftrightunsigned(code, 1))


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def deg2rad(d: Column) -> Column:
    return d * F.lit(3.141592653589793) / F.lit(180.0)


def rad2deg(r: Column) -> Column:
    return r * F.lit(180.0) / F.lit(3.141592653589793)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres; x is the latitude and y the longitude, in degrees."""
    a, b = deg2rad(lat1), deg2rad(lat2)
    u, v = F.sin((b - a) / 2), F.sin((deg2rad(lon2) - deg2rad(lon1)) / 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), u * u + F.cos(a) * F.cos(b) * v * v)))


def distance(metric: str, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return haversine(x1, y1, x2, y2) if metric == "earth" else euclid(x1, y1, x2, y2)


def hash_uniform(seed: int, *parts: Column) -> Column:
    """A value of (0, 1) from a hash of the seed and the parts: the same whatever the partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def uniform(low: float, high: float, u: Column) -> Column:
    return F.lit(low) + (F.lit(high) - F.lit(low)) * u
