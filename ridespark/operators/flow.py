"""Statistics of dense flow fields, stored as one row per pixel: ids, y, x, u, v.

A group is one frame, so groups are bounded by the frame size whatever the video.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schemas import GRID

FRAME = ("video_id", "sample_idx")
EPSILON = 1e-6


def frame_statistics(flow: DataFrame, *, keys: Sequence[str] = FRAME) -> DataFrame:
    """Mean, 90th percentile and spread of the flow length, mean vector and its length."""
    size = F.hypot("u", "v")
    mean_u, mean_v = F.avg("u"), F.avg("v")
    return flow.groupBy(*keys).agg(
        F.avg(size).alias("flow_mean"),
        F.percentile(size, 0.9).alias("flow_p90"),
        F.stddev_pop(size).alias("flow_std"),
        mean_u.alias("flow_u"),
        mean_v.alias("flow_v"),
        F.hypot(mean_u, mean_v).alias("flow_net"),
    )


def _slope(value: Column, w, step: float) -> Column:
    """Central difference inside, one-sided at both ends of the line."""
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return (
        F.when(before.isNull(), after - value)
        .when(after.isNull(), value - before)
        .otherwise((after - before) / 2)
    ) / step


def field_statistics(
    flow: DataFrame, *, width: int, height: int, keys: Sequence[str] = FRAME
) -> DataFrame:
    """Divergence and curl of the flow, in units of the frame size.

    Both directional windows and the aggregate share the exchange on the frame.
    """
    if width < 2 or height < 2:
        raise ValueError("slopes need at least two pixels each way")
    un, vn = F.col("u") / width, F.col("v") / height
    along_x = W.partitionBy(*keys, "y").orderBy("x")
    along_y = W.partitionBy(*keys, "x").orderBy("y")
    dx, dy = 1 / (width - 1), 1 / (height - 1)
    slopes = (
        flow.repartition(*[F.col(k) for k in keys])
        .select(*keys, "y", "x", un.alias("un"), vn.alias("vn"))
        .select(
            *keys,
            F.hypot("un", "vn").alias("size"),
            (_slope(F.col("un"), along_x, dx) + _slope(F.col("vn"), along_y, dy)).alias("div"),
            (_slope(F.col("vn"), along_x, dx) - _slope(F.col("un"), along_y, dy)).alias("curl"),
        )
    )
    base = F.avg("size") + EPSILON
    return slopes.groupBy(*keys).agg(
        (F.avg(F.abs("div")) / base).alias("div_normalized_mean"),
        F.percentile(F.abs("div"), 0.9).alias("div_abs_p90"),
        F.stddev_pop("div").alias("div_std"),
        F.avg((F.col("div") > 0).cast("double")).alias("div_pos_fraction"),
        (F.avg(F.abs("curl")) / base).alias("curl_normalized_mean"),
        F.percentile(F.abs("curl"), 0.9).alias("curl_abs_p90"),
        F.stddev_pop("curl").alias("curl_std"),
    )


def _band(position: Column, size: int) -> Column:
    edges = [int(size * i / GRID) for i in range(1, GRID)]
    band = F.lit(0)
    for e in edges:
        band = band + (position >= e).cast("int")
    return band


def grid_statistics(
    flow: DataFrame, *, width: int, height: int, keys: Sequence[str] = FRAME
) -> DataFrame:
    """Mean vector, mean length and length of the mean vector in each cell of a 3x3 grid."""
    cells = flow.select(
        *keys,
        "u",
        "v",
        F.hypot("u", "v").alias("size"),
        F.concat_ws("_", _band(F.col("y"), height), _band(F.col("x"), width)).alias("cell"),
    )
    out = []
    for r in range(GRID):
        for c in range(GRID):
            mine = F.col("cell") == f"{r}_{c}"
            u, v = (F.avg(F.when(mine, F.col(p))) for p in "uv")
            name = f"grid_{r}_{c}"
            out += [
                u.alias(f"{name}_u"),
                v.alias(f"{name}_v"),
                F.avg(F.when(mine, F.col("size"))).alias(f"{name}_magnitude"),
                F.hypot(u, v).alias(f"{name}_net"),
            ]
    return cells.groupBy(*keys).agg(*out)


def frame_features(
    flow: DataFrame, *, width: int, height: int, keys: Sequence[str] = FRAME
) -> DataFrame:
    """All per-frame columns of the sample table except the differences between samples."""
    on = list(keys)
    return (
        frame_statistics(flow, keys=keys)
        .join(field_statistics(flow, width=width, height=height, keys=keys), on)
        .join(grid_statistics(flow, width=width, height=height, keys=keys), on)
    )
