"""Filters and derivatives along time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ordered import CHUNK, HALO, halo_by_distance, halo_one_row, running
from ..session import freeze


def rolling_median(
    df: DataFrame,
    names: Sequence[str],
    seconds: float,
    *,
    keys: Sequence[str] = ("video_id",),
    width: float = 300.0,
) -> DataFrame:
    """Each column replaced by its median over the samples within seconds/2 on either side.

    Both ends count; at the borders of a recording the range is cut to what exists.
    """
    if not 0 <= seconds < float("inf"):
        raise ValueError("the smoothing time must be finite and not negative")
    if seconds == 0:
        return df
    half = seconds / 2
    cut = halo_by_distance(df, "t", max(width, seconds), before=half, after=half)
    part = ", ".join(f"`{k}`" for k in [*keys, CHUNK])
    frame = f"over (partition by {part} order by t range between {half!r}D preceding and {half!r}D following)"
    return (
        cut.select(
            *[F.expr(f"percentile(`{c}`, 0.5D) {frame}").alias(c) if c in names else F.col(c) for c in cut.columns]
        )
        .where(~F.col(HALO))
        .drop(CHUNK, HALO)
    )


def time_derivative(
    df: DataFrame,
    rates: Mapping[str, str],
    *,
    keys: Sequence[str] = ("video_id",),
    width: float = 300.0,
) -> DataFrame:
    """Add d(column)/dt for unevenly spaced times; `rates` maps new name to source column.

    Second order inside, one-sided at both ends of a key. Times are strictly increasing.
    """
    near = halo_one_row(df, keys, "t", width)
    w = W.partitionBy(*keys, CHUNK).orderBy("t")
    t = F.col("t")
    back, ahead = t - F.lag("t").over(w), F.lead("t").over(w) - t

    def rate(name: str) -> Column:
        x, x0, x1 = F.col(name), F.lag(name).over(w), F.lead(name).over(w)
        inner = (back * back * x1 + (ahead * ahead - back * back) * x - ahead * ahead * x0) / (
            back * ahead * (back + ahead)
        )
        return F.when(back.isNull(), (x1 - x) / ahead).when(ahead.isNull(), (x - x0) / back).otherwise(inner)

    return near.withColumns({n: rate(s) for n, s in rates.items()}).where(~F.col(HALO)).drop(CHUNK, HALO)


def _fit_weights(length: int, degree: int) -> np.ndarray:
    """Row p: weights that evaluate at position p the least-squares polynomial over 0..length-1."""
    x = np.arange(length, dtype=float) - length // 2
    powers = np.vander(x, degree + 1, increasing=True)
    return powers @ np.linalg.pinv(powers)


def polynomial_smooth(
    df: DataFrame,
    names: Sequence[str],
    *,
    length: int = 9,
    degree: int = 2,
    keys: Sequence[str] = ("video_id",),
    chunk: int = 4096,
) -> DataFrame:
    """Savitzky-Golay smoothing along `sample_idx` = 0, 1, 2, ...

    Inside, each value becomes that of the polynomial fitted to the `length` samples
    around it; the first and last half use the fit to the first and last `length`
    samples. A key with fewer samples fails the job.
    """
    if length < 3 or length % 2 == 0 or not 0 <= degree < length:
        raise ValueError("length must be odd and at least 3, degree between 0 and length - 1")
    half = length // 2
    weights = _fit_weights(length, degree)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cut = halo_by_distance(df.join(sizes, list(keys)), "sample_idx", chunk, before=length - 1, after=length - 1)
    w = W.partitionBy(*keys, CHUNK).orderBy("sample_idx")
    idx, n = F.col("sample_idx"), F.col("_n")

    def smooth(name: str) -> Column:
        x = F.col(name).cast("double")
        at = lambda k: x if k == 0 else (F.lag(x, -k) if k < 0 else F.lead(x, k)).over(w)
        # position p of the fitting window, whose first sample is p steps back
        value = lambda p: sum((at(j - p) * float(weights[p][j]) for j in range(length)), F.lit(0.0))
        out = F.when(n < length, F.raise_error(F.lit("fewer samples than the smoothing length")).cast("double"))
        for p in range(half):
            out = out.when(idx == p, value(p)).when(idx == n - 1 - p, value(length - 1 - p))
        return out.otherwise(value(half))

    return (
        cut.withColumns({c: smooth(c) for c in names}).where(~F.col(HALO)).drop(CHUNK, HALO, "_n")
    )


def high_pass(
    df: DataFrame,
    names: Sequence[str],
    *,
    seconds: float = 1.0,
    keys: Sequence[str] = ("video_id",),
    width: float = 300.0,
) -> DataFrame:
    """Each column minus its centred moving mean over about `seconds`.

    The half width in rows comes from the mean sample rate of the key. Gaps count as
    the mean of the column. Moving sums are differences of running sums, looked up by
    row position, so the width may differ per key.
    """
    keys = list(keys)
    means = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.max("t") - F.min("t")).alias("_span"),
        *[F.avg(c).alias(f"_m_{c}") for c in names],
    )
    rate = (F.col("_n") - 1) / F.col("_span")
    half = F.when(F.col("_span") > 0, F.greatest(F.lit(1), F.bround(rate * seconds / 2))).otherwise(1)
    rows = df.join(means, keys).withColumn("_half", half.cast("long"))
    filled = {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in names}
    scan = running(
        rows,
        keys,
        F.col("t"),
        width,
        [F.col("t")],
        {"_pos": ("sum", F.lit(1))} | {f"_sum_{c}": ("sum", v) for c, v in filled.items()},
    )
    scan = scan.withColumns(
        {"_lo": F.greatest(F.lit(0), F.col("_pos") - F.col("_half")),
         "_hi": F.least(F.col("_n"), F.col("_pos") + F.col("_half") + 1)}
    )
    scan = freeze(scan)  # read three times below
    # running sum before row p, for p = 0..n: the last one is the sum up to the end
    upto = scan.select(*keys, (F.col("_pos") + 1).alias("_p"), *[(F.col(f"_sum_{c}") + filled[c]).alias(f"_upto_{c}") for c in names])
    low = upto.select(*keys, F.col("_p").alias("_lo"), *[F.col(f"_upto_{c}").alias(f"_low_{c}") for c in names])
    high = upto.select(*keys, F.col("_p").alias("_hi"), *[F.col(f"_upto_{c}").alias(f"_high_{c}") for c in names])
    both = scan.join(high, [*keys, "_hi"]).join(low, [*keys, "_lo"], "left")
    mean = lambda c: (F.col(f"_high_{c}") - F.coalesce(F.col(f"_low_{c}"), F.lit(0.0))) / (F.col("_hi") - F.col("_lo"))
    return both.select(*[(F.col(c) - mean(c)).alias(c) if c in names else F.col(c) for c in df.columns])
