"""Interval estimates as column expressions."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantiles used as they stand for the usual confidence levels (fixed values).
USUAL_Z = {0.90: 1.6449, 0.95: 1.9600, 0.99: 2.5758}


def z_value(confidence: float) -> float:
    """Two-sided normal quantile: the table above, else Abramowitz and Stegun 26.2.23, else 1.96."""
    near = [z for level, z in USUAL_Z.items() if abs(level - confidence) < 0.001]
    if near:
        return near[0]
    tail = (1 - confidence) / 2
    if not 0 < tail < 0.5:
        return 1.96
    t = sqrt(-2 * log(tail))
    over = 2.515517 + t * (0.802853 + t * 0.010328)
    under = 1 + t * (1.432788 + t * (0.189269 + t * 0.001308))
    return t - over / under


def wilson(matches: Column, total: Column, confidence: float = 0.95) -> Column:
    """struct(lo, hi): Wilson score interval within [0, 1], rounded to 4; (0, 0) for an empty total."""
    z = z_value(confidence)
    n, p = total.cast("double"), matches.cast("double") / total
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    reach = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    lo = F.round(F.greatest(F.lit(0.0), middle - reach), 4)
    hi = F.round(F.least(F.lit(1.0), middle + reach), 4)
    filled = total > 0
    return F.struct(F.when(filled, lo).otherwise(0.0).alias("lo"), F.when(filled, hi).otherwise(0.0).alias("hi"))


def interval_width(interval: Column) -> Column:
    return F.round(interval["hi"] - interval["lo"], 4)


def is_confident(matches: Column, total: Column, threshold: float, confidence: float = 0.95) -> Column:
    """True where the interval's lower end reaches the threshold."""
    return wilson(matches, total, confidence)["lo"] >= threshold


def samples_needed(matches: Column, total: Column, width: float = 0.1, confidence: float = 0.95) -> Column:
    """Samples for an interval of that width; at least 10."""
    z = z_value(confidence)
    p = matches.cast("double") / total
    spread = p * (1 - p)
    wanted = F.ceil(4 * (z / width) ** 2 * spread)
    ten = F.lit(10).cast("bigint")
    return (
        F.when(total == 0, F.lit(max(10, int(100 / width))).cast("bigint"))
        .when(spread == 0, F.greatest(ten, total.cast("bigint")))
        .otherwise(F.greatest(ten, wanted.cast("bigint")))
    )
