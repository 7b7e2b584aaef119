"""Shaping single values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def compress_spikes(x: Column, knee: float = 5.0, slope: float = 0.2) -> Column:
    """Linear up to the knee, flatter beyond it, odd in x."""
    size = F.abs(x)
    return F.signum(x) * F.when(size <= knee, size).otherwise(knee + slope * (size - knee))


def clip(x: Column, low, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.greatest(lit(low), F.least(lit(high), x)))


def sigmoid_gate(x: Column, low: Column, high: Column) -> Column:
    """Soft step from 0 to 1 between `low` and `high`, exponent held within 60."""
    z = clip((x - (low + high) / 2) / ((high - low) / 8), -60.0, 60.0)
    return 1 / (1 + F.exp(-z))


def unit_scale(x: Column, low: Column, high: Column) -> Column:
    """x mapped from [low, high] to [0, 1]; a flat range gives 0."""
    span = high - low
    return F.when(span <= 2.220446049250313e-16, F.lit(0.0)).otherwise(
        clip((x - low) / span, 0.0, 1.0)
    )


# fixed values: power (W) at which a zone begins, and the RGB colour there
POWER_STOPS = ((0, (0, 0, 0)), (300, (46, 204, 113)), (600, (195, 196, 15)), (1000, (231, 76, 60)))


def power_colour(watt: Column) -> Column:
    """RGB of a power value, linear between the stops and continued beyond the last."""
    (w0, c0), (w1, c1), (w2, c2), (w3, c3) = POWER_STOPS
    blend = lambda lo, hi, a, b: F.struct(
        *[
            (F.lit(p) + F.lit(q - p) * (watt - lo) / F.lit(float(hi - lo))).cast("int").alias(n)
            for n, p, q in zip(("r", "g", "b"), a, b)
        ]
    )
    return (
        F.when(watt < w1, blend(w0, w1, c0, c1))
        .when(watt < w2, blend(w1, w2, c1, c2))
        .otherwise(blend(w2, w3, c2, c3))
    )
