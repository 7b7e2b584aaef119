"""Scaling columns by their distribution inside a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scaling import unit_scale
from ..plans.quantiles import exact_quantiles, join_on

FLAT = 1e-8


def zscore(
    df: DataFrame, names: Sequence[str], *, keys: Sequence[str] = ("video_id",), dtype: str = "float"
) -> DataFrame:
    """(x - mean) / population std within the keys; a flat column is only centred.

    Means and deviations are combined map-side to one row per key and joined back;
    with one row per key Spark turns that join into a broadcast when it is small, and
    AQE splits a key that dominates otherwise.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(
        *[F.avg(F.col(n).cast("double")).alias(f"_avg_{n}") for n in names],
        *[F.stddev_pop(F.col(n).cast("double")).alias(f"_std_{n}") for n in names],
    )
    scale = lambda n: F.when(F.col(f"_std_{n}") > FLAT, F.col(f"_std_{n}")).otherwise(1.0)
    scaled = {n: ((F.col(n).cast("double") - F.col(f"_avg_{n}")) / scale(n)).cast(dtype) for n in names}
    return df.join(stats, keys).select(*[scaled[c].alias(c) if c in scaled else c for c in df.columns])


def robust_scale(
    df: DataFrame,
    columns: Mapping[str, Column],
    *,
    keys: Sequence[str] = ("video_id",),
    low: float = 5.0,
    high: float = 95.0,
) -> DataFrame:
    """Add each of `columns` mapped to [0, 1] by its percentile range within the keys."""
    if not 0 <= low < high <= 100:
        raise ValueError("percentiles must satisfy 0 <= low < high <= 100")
    with_values = df.withColumns({f"_v_{n}": c for n, c in columns.items()})
    bounds = exact_quantiles(
        with_values, keys, {f"_q_{n}": F.col(f"_v_{n}") for n in columns}, [low / 100, high / 100]
    )
    out = join_on(with_values, bounds, list(keys))
    for n in columns:
        q = F.col(f"_q_{n}")
        out = out.withColumn(n, unit_scale(F.col(f"_v_{n}"), q[0], q[1]))
    return out.drop(*[f"_v_{n}" for n in columns], *[f"_q_{n}" for n in columns])
