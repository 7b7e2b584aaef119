"""Clock text and seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"^[+]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _number(text: Column) -> Column:
    """A finite, non-negative number, or null."""
    clean = F.trim(text)
    value = F.when(clean.rlike(_NUMBER), clean.try_cast("double"))
    return F.when(value < F.lit(float("inf")), value)


def seconds_of(text: Column) -> Column:
    """Seconds of ``SS``, ``MM:SS`` or ``HH:MM:SS`` text; null when it is not one.

    Fractions are allowed in every field. Fields below the first must be under 60;
    in ``MM:SS`` the minutes are the first field and are free.
    """
    parts = F.transform(F.split(F.trim(text), ":"), _number)
    fine = (
        (F.size(parts) <= 3)
        & F.forall(parts, lambda x: x.isNotNull())
        & F.forall(F.slice(parts, 2, 2), lambda x: x < 60)
    )
    return F.when(fine, F.aggregate(parts, F.lit(0.0), lambda total, x: total * 60 + x))


def clock_of(seconds: Column) -> Column:
    """``MM:SS`` or, from one hour on, ``HH:MM:SS``; fractions are cut off."""
    whole = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    text = F.when(hours > 0, F.concat_ws(":", two(hours), two(minutes), two(rest))).otherwise(
        F.concat_ws(":", two(minutes), two(rest))
    )
    return F.when((seconds >= 0) & (seconds < F.lit(float("inf"))), text)


def rate_of(text: Column) -> Column:
    """A frame rate from ``30000/1001`` or a number; anything else is 0."""
    clean = F.trim(text)
    parts = F.split(clean, "/", 2)
    quotient = F.try_divide(
        F.trim(parts[0]).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")
    )
    return F.coalesce(
        F.when(clean.contains("/"), quotient).otherwise(clean.try_cast("double")), F.lit(0.0)
    )


def whole_second(duration: Column) -> Column:
    """The nearest whole second, halves up: the precision annotations are written with."""
    return F.floor(duration + 0.5).cast("double")


def window_count(duration: Column, window: float, stride: float) -> Column:
    """How many complete windows a recording of this duration holds."""
    n = F.floor((duration - window + 1e-9) / stride) + 1
    return F.when(duration + 1e-9 < window, F.lit(0)).otherwise(F.greatest(F.lit(0), n)).cast("long")
