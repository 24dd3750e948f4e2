"""Special functions of positive arguments as column expressions: asymptotic series after a shift upwards."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments are moved up by this before a series is used.
SHIFT = 8


def log_gamma(x: Column) -> Column:
    z = x + SHIFT
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - sum([F.log(x + i) for i in range(1, SHIFT)], F.log(x))


def digamma(x: Column) -> Column:
    z = x + SHIFT
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    return series - sum([1 / (x + i) for i in range(1, SHIFT)], 1 / x)


def trigamma(x: Column) -> Column:
    z = x + SHIFT
    series = 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) - 1 / (30 * z**9)
    return series + sum([1 / (x + i) ** 2 for i in range(1, SHIFT)], 1 / x**2)
