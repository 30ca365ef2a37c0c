"""Click-probability arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12
NO_POSITIVES = "undefined (0 observed positives)"


def check_rate(rate: float) -> float:
    if not 0.0 < rate <= 1.0:
        raise ValueError(f"{rate!r} is not a share of rows to keep: more than 0, at most 1")
    return float(rate)


def recalibrate(p: Column, rate: float) -> Column:
    """Probability before negatives were thinned to ``rate``."""
    if check_rate(rate) == 1.0:
        return p
    return p / (p + (F.lit(1.0) - p) / F.lit(float(rate)))


def clip(p: Column, eps: float = EPSILON) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def log_loss_term(y: Column, p: Column) -> Column:
    """Loss of one row; ``p`` must already be clipped."""
    return F.when(y == 1, -F.log(p)).otherwise(-F.log(F.lit(1.0) - p))


def ratio_or_null(predicted: Column, observed: Column) -> Column:
    return F.when(observed > 0, predicted / observed)


def ratio_note(observed: Column) -> Column:
    return F.when(observed > 0, F.lit(None).cast("string")).otherwise(F.lit(NO_POSITIVES))


def safe_ratio(num: Column, den: Column, when_empty: float | None = None) -> Column:
    """``num / den`` as a double, with ``when_empty`` on a zero denominator."""
    empty = F.lit(when_empty).cast("double")
    return F.when(den == 0, empty).otherwise(num.cast("double") / den.cast("double"))


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value.

    Spark SQL has no error function; this is formula 26.2.17 of Abramowitz and
    Stegun (absolute error below 7.5e-8).
    """
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = F.lit(0.0)
    # Fixed coefficients, highest power first.
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + F.lit(c)) * t
    density = F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))
    return F.lit(2.0) * density * poly
