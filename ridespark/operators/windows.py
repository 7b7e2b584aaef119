"""Overlapping windows over the sample lattice, and their statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ordered import CHUNK, HALO, halo_by_distance, halo_one_row
from ..plans.quantiles import exact_quantiles, quantile_of
from ..schemas import SIGNAL_COLUMNS, WINDOW_STATS

LATTICE_TOLERANCE = 1e-6
WINDOWS_PER_CHUNK = 512


def whole_steps(span: float, step: float, what: str) -> int:
    n = round(span / step)
    if abs(span / step - n) > LATTICE_TOLERANCE or n < 1:
        raise ValueError(f"{what} of {span} s is not a whole number of {step} s steps")
    return n


def sampling_grid(
    samples: DataFrame,
    *,
    window: float,
    stride: float,
    keys: Sequence[str] = ("video_id",),
    chunk_seconds: float = 3600.0,
) -> DataFrame:
    """Per key: median step `dt`, first and last time, rows per window and stride, window count.

    A key whose window or stride is not a whole number of steps, or that is too short,
    gets ``issue`` set and a window count of 0.
    """
    if not window > 0 or not stride > 0:
        raise ValueError("window and stride must be positive")
    keys = list(keys)
    near = halo_one_row(samples.select(*keys, "t"), keys, "t", chunk_seconds)
    w = W.partitionBy(*keys, CHUNK).orderBy("t")
    steps = near.select(*keys, HALO, (F.col("t") - F.lag("t").over(w)).alias("step")).where(
        ~F.col(HALO) & F.col("step").isNotNull()
    )
    dt = exact_quantiles(steps, keys, {"step": F.col("step")}, [0.5]).select(
        *keys, F.col("step")[0].alias("dt")
    )
    extent = samples.groupBy(*keys).agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("t").alias("n_samples")
    )
    n_w, n_s = (F.round(F.try_divide(F.lit(float(x)), F.col("dt"))) for x in (window, stride))
    off = lambda x, n: F.abs(F.try_divide(F.lit(float(x)), F.col("dt")) - n) > LATTICE_TOLERANCE
    span = F.col("last_t") - (F.col("first_t") - F.col("dt"))
    by_time = F.floor((span - window + 1e-9) / stride) + 1
    by_rows = F.floor(F.try_divide(F.col("n_samples") - n_w, n_s)) + 1
    issue = (
        F.when(F.col("dt").isNull(), "too_few_samples")
        .when(off(window, n_w), "window_off_lattice")
        .when(off(stride, n_s), "stride_off_lattice")
        .when(n_w < 2, "window_too_short")
        .when((span - window < -1e-9) | (F.col("n_samples") < n_w), "sequence_too_short")
    )
    return extent.join(dt, keys, "left").select(
        *keys,
        "dt",
        "first_t",
        "last_t",
        "n_samples",
        n_w.cast("int").alias("rows_per_window"),
        n_s.cast("int").alias("rows_per_stride"),
        F.when(issue.isNull(), F.least(by_time, by_rows)).otherwise(0).cast("long").alias("n_windows"),
        issue.alias("issue"),
    )


def windowed(
    samples: DataFrame,
    aggregates: Mapping[str, Column],
    *,
    window: float,
    stride: float,
    dt: float | None = None,
    grid: DataFrame | None = None,
    keys: Sequence[str] = ("video_id",),
) -> DataFrame:
    """One row per complete window: keys, window_index, start_s, end_s and the aggregates.

    Window k covers rows ``[k*S, k*S + W)`` of `sample_idx`; a sample's time is the end
    of its step, so a window starts one step before its first sample. The step comes
    from `dt` (the sampling contract: one constant step, no gaps) or, per key, from a
    `sampling_grid`.

    Rows move once. They are shuffled by (keys, chunk of windows) with the W - S rows
    that the last windows of a chunk share with the next, multiplied into windows after
    that exchange, and aggregated there, since (keys, chunk, window) is already clustered.
    """
    if (dt is None) == (grid is None):
        raise ValueError("give either dt or grid")
    keys = list(keys)
    idx = F.col("sample_idx")
    if dt is not None:
        n_w, n_s = whole_steps(window, dt, "window"), whole_steps(stride, dt, "stride")
        if n_w < 2:
            raise ValueError("a window needs at least two samples")
        rows, w_rows, s_rows = samples, F.lit(n_w), F.lit(n_s)
    else:
        per_key = grid.where(F.col("issue").isNull()).select(
            *keys, "dt", "first_t", "rows_per_window", "rows_per_stride", "n_windows"
        )
        rows = samples.join(per_key, keys)
        w_rows, s_rows = F.col("rows_per_window"), F.col("rows_per_stride")

    width = s_rows * WINDOWS_PER_CHUNK
    cut = halo_by_distance(rows, "sample_idx", width, after=F.greatest(F.lit(0), w_rows - s_rows))
    cut = cut.where(F.col(CHUNK) >= 0).repartition(*[F.col(k) for k in keys], F.col(CHUNK))
    # windows holding row i: ceil((i-W+1)/S) .. floor(i/S), within this chunk
    first = F.greatest(F.ceil((idx - w_rows + 1) / s_rows), F.col(CHUNK) * WINDOWS_PER_CHUNK)
    last = F.least(F.floor(idx / s_rows), F.col(CHUNK) * WINDOWS_PER_CHUNK + WINDOWS_PER_CHUNK - 1)
    spread = cut.where(first <= last).withColumn(
        "window_index", F.explode(F.sequence(first.cast("long"), last.cast("long")))
    )
    extra = [F.count(F.lit(1)).alias("_rows"), F.min("t").alias("_t")]
    if grid is not None:
        extra += [
            F.first(c).alias(c) for c in ("dt", "first_t", "rows_per_window", "rows_per_stride", "n_windows")
        ]
    grouped = spread.groupBy(*keys, CHUNK, "window_index").agg(
        *[c.alias(n) for n, c in aggregates.items()], *extra
    )
    if dt is not None:
        start = F.col("_t") - dt
        full = grouped.where(F.col("_rows") == w_rows)
    else:
        start = F.col("first_t") - F.col("dt") + F.col("window_index") * F.col("rows_per_stride") * F.col("dt")
        full = grouped.where(
            (F.col("_rows") == F.col("rows_per_window")) & (F.col("window_index") < F.col("n_windows"))
        )
    return full.select(
        *keys,
        F.col("window_index").cast("int").alias("window_index"),
        start.alias("start_s"),
        (start + window).alias("end_s"),
        *aggregates,
    )


def statistics(signals: Sequence[str] = SIGNAL_COLUMNS) -> dict[str, Column]:
    """What the six statistics of each signal are taken from, as aggregate expressions."""
    out: dict[str, Column] = {}
    for s in signals:
        x = F.col(s).cast("double")
        out[f"{s}_mean"] = F.avg(x)
        out[f"{s}_max"] = F.max(x)
        out[f"{s}_std"] = F.stddev_pop(x)
        out[f"{s}_all"] = F.sort_array(F.collect_list(x))  # a window's rows are few by construction
        out[f"{s}_min"] = F.min(x)
    return out


def window_statistics(
    signals: DataFrame,
    *,
    window: float = 4.0,
    stride: float = 2.0,
    dt: float | None = None,
    grid: DataFrame | None = None,
    names: Sequence[str] = SIGNAL_COLUMNS,
    keys: Sequence[str] = ("video_id",),
    dtype: str = "float",
) -> DataFrame:
    """Mean, max, population std, median, 90th percentile and min of every signal per window."""
    rows = windowed(signals, statistics(names), window=window, stride=stride, dt=dt, grid=grid, keys=keys)
    pick = {"median": lambda s: quantile_of(F.col(f"{s}_all"), 0.5), "q90": lambda s: quantile_of(F.col(f"{s}_all"), 0.9)}
    return rows.select(
        *keys,
        "window_index",
        "start_s",
        "end_s",
        *[
            (pick[st](s) if st in pick else F.col(f"{s}_{st}")).cast(dtype).alias(f"{s}_{st}")
            for s in names
            for st in WINDOW_STATS
        ],
    )


def append_window_value(
    windows: DataFrame, values: DataFrame, name: str, *, keys: Sequence[str] = ("video_id",)
) -> DataFrame:
    """Add one per-window value as the last column; null where a window has none."""
    on = [*keys, "window_index"]
    return windows.join(values.select(*on, name), on, "left").select(*windows.columns, name)


def spread_to_steps(
    windows: DataFrame, name: str, *, window: float, stride: float, dt: float, keys: Sequence[str] = ("video_id",)
) -> DataFrame:
    """A per-window value repeated for every sample row of its window."""
    n_w, n_s = whole_steps(window, dt, "window"), whole_steps(stride, dt, "stride")
    step = F.explode(F.sequence(F.lit(0), F.lit(n_w - 1))).alias("step")
    return windows.select(*keys, "window_index", step, name).withColumn(
        "sample_idx", (F.col("window_index") * n_s + F.col("step")).cast("int")
    )


def interest_windows(
    channels: DataFrame,
    names: Sequence[str],
    *,
    sizes: Sequence[float] = (4.0,),
    stride: float | None = 2.0,
    keys: Sequence[str] = ("video_id",),
) -> DataFrame:
    """0.6 max + 0.4 mean of each channel in windows counted from the first sample.

    Windows are cut by time, the last ones may be partly filled and end with the last
    sample. Several sizes are computed at once; `stride` None means half the size.
    """
    keys = list(keys)
    sizes_col = F.array(
        *[
            F.struct(F.lit(float(s)).alias("size_s"), F.lit(float(stride or s / 2)).alias("stride_s"))
            for s in sizes
        ]
    )
    extent = channels.groupBy(*keys).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    size, step = F.col("size_s"), F.col("stride_s")
    since = F.col("t") - F.col("first_t")
    rows = (
        channels.join(extent, keys)
        .withColumn("_w", F.explode(sizes_col))
        .select("*", "_w.*")
        .drop("_w")
    )
    first = F.greatest(F.lit(0), F.floor((since - size) / step)).cast("long")
    last = (F.floor(since / step) + 1).cast("long")
    start = F.col("first_t") + F.col("window_index") * step
    inside = rows.withColumn("window_index", F.explode(F.sequence(first, last))).where(
        (F.col("t") >= start) & (F.col("t") < start + size) & (start <= F.col("last_t"))
    )
    return inside.groupBy(*keys, "size_s", "window_index").agg(
        F.min(start).alias("start_s"),
        F.min(F.least(start + size, F.col("last_t"))).alias("end_s"),
        *[(0.6 * F.max(n) + 0.4 * F.avg(n)).alias(n) for n in names],
    )
