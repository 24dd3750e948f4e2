"""Column expressions over plots and satellite bands. A polygon is array<struct<x: double, y: double>> in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(p: Column) -> Column:
    """(x1, y1, x2, y2) of the sides, the last back to the first vertex."""
    turned = F.concat(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, 1, 1))
    return F.zip_with(p, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _sum(edges: Column, f) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + f(e))


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def signed_area(p: Column) -> Column:
    return _sum(_edges(p), _cross) / 2


def area_hectares(p: Column) -> Column:
    return F.abs(signed_area(p)) / 10_000


def perimeter(p: Column) -> Column:
    return _sum(_edges(p), lambda e: F.sqrt(F.pow(e["x2"] - e["x1"], F.lit(2)) + F.pow(e["y2"] - e["y1"], F.lit(2))))


def compactness(p: Column) -> Column:
    return 4 * math.pi * F.abs(signed_area(p)) / F.pow(perimeter(p), F.lit(2))


def centroid(p: Column) -> Column:
    a = 6 * signed_area(p)
    return F.struct((_sum(_edges(p), lambda e: (e["x1"] + e["x2"]) * _cross(e)) / a).alias("x"), (_sum(_edges(p), lambda e: (e["y1"] + e["y2"]) * _cross(e)) / a).alias("y"))


def contains(p: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of sides to the right."""
    crossed = lambda e: F.when(((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]), 1.0).otherwise(0.0)
    return _sum(_edges(p), crossed) % 2 == 1


def area_mismatch(claimed: Column, p: Column) -> Column:
    a = area_hectares(p)
    return (claimed - a) / F.when(a > 0, a)


def ndvi(nir: Column, red: Column) -> Column:
    """A zero denominator is an error, not a null."""
    return F.when(nir + red == 0, F.raise_error(F.lit("both bands are zero"))).otherwise((nir - red) / (nir + red))


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1)


def backscatter_db(power: Column) -> Column:
    return 10 * F.log10(power)


def drought_category(z: Column) -> Column:
    return (
        F.when(z >= 2, "extremely_wet").when(z >= 1.5, "severely_wet").when(z >= 1, "moderately_wet").when(z > -1, "near_normal").when(z > -1.5, "moderate_drought").when(z > -2, "severe_drought").when(z.isNotNull(), "extreme_drought")
    )


#: The alphabet of geohashes.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(latitude: Column, longitude: Column, precision: int = 6) -> Column:
    """Interleaved bits of the cell numbers, five to a letter, by arithmetic alone."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    cell = lambda v, low, width, n: F.least(F.floor((v - low) / width * (1 << n)), F.lit((1 << n) - 1)).cast("bigint")
    lon, lat = cell(longitude, -180, 360, lon_bits), cell(latitude, -90, 180, lat_bits)
    letters = []
    for i in range(precision):
        value = F.lit(0)
        for k in range(5):
            n = 5 * i + k
            source, left = (lon, lon_bits - 1 - n // 2) if n % 2 == 0 else (lat, lat_bits - 1 - n // 2)
            value = value * 2 + F.shiftright(source, left).bitwiseAND(1)
        letters.append(F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1)))
    return F.concat(*letters)
