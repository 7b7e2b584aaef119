"""Structured Streaming forms of windows, differences, islands and deduplication.

Streams carry an event time `ts`. Windows sit on the epoch, not on the first sample of
a video as in batch; late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_windows(
    stream: DataFrame,
    aggregates: Mapping[str, Column],
    *,
    window: str = "4 seconds",
    stride: str = "2 seconds",
    lateness: str = "10 seconds",
    keys: Sequence[str] = ("video_id",),
) -> DataFrame:
    """Sliding windows, emitted once the watermark has passed their end."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window, stride), *keys)
        .agg(*[c.alias(n) for n, c in aggregates.items()])
        .select(*keys, F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), *aggregates)
    )


def live_islands(stream: DataFrame, gap: str, *, lateness: str = "10 seconds", keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Groups of events less than `gap` apart: first and last event time and their number."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap), *keys)
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
        .select(*keys, F.col("session_window.start").alias("first_ts"), "last_ts", "events")
    )


def live_distinct(stream: DataFrame, columns: Sequence[str], *, within: str = "10 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Each combination of `columns` once in every span `within` of the epoch, whose start is added as `span_ts`.

    A combination leaves the state when the watermark has passed `within` and `lateness` after it, so the
    state holds the combinations of that time only, and the rows do not depend on how the source is cut
    into batches.
    """
    spans = stream.withColumn("span_ts", F.window("ts", within)["start"])
    return spans.withWatermark("ts", f"{within} {lateness}").dropDuplicatesWithinWatermark([*columns, "span_ts"])


def live_delta(stream: DataFrame, value: str, *, key_type: str = "long", keep_hours: int | None = None) -> DataFrame:
    """First difference of `value` per video across micro-batches; 0 for the first row.

    Rows of a video arrive in time order. The state is one value per video. With
    `keep_hours` it is dropped when a video has been silent that long; such a stream never
    runs out of batches, so leave it unset for runs that end (`availableNow`).
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else None
        # a video's rows of one micro-batch come in Arrow batches that are not in time order
        pdf = pd.concat(list(batches)).sort_values("t", kind="stable")
        x = pdf[value].astype(float)
        delta = x.diff()
        delta.iloc[0] = 0.0 if before is None else x.iloc[0] - before
        yield pd.DataFrame({"video_id": key[0], "t": pdf["t"], "delta": delta})
        state.update((float(x.iloc[-1]),))
        if keep_hours is not None:
            state.setTimeoutDuration(keep_hours * 3600 * 1000)

    timeout = GroupStateTimeout.NoTimeout if keep_hours is None else GroupStateTimeout.ProcessingTimeTimeout
    return (
        stream.select("video_id", "t", value)
        .groupBy("video_id")
        .applyInPandasWithState(
            step, f"video_id {key_type}, t double, delta double", "x double", "append", timeout
        )
    )
