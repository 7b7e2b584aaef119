"""Streams over a finite source, complete: what a stream has emitted, and what it still holds at its end.

Append mode emits a window or an island only when the watermark has passed its end, so a stream that
runs to the end of its source keeps the last ones in its state. They are read from the state store,
where a running aggregate of the kinds below is its value, and closed in batch. Emitted groups have
left the state, so no row comes twice and no source row is read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_folder
from .live import live_islands, live_windows

#: Aggregates whose state is one value.
KINDS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def run_available(stream: DataFrame, *, folder: str | None = None) -> tuple[DataFrame, str]:
    """Run to the end of what is there now. Returns the emitted rows and the place of the stream's state.

    A second run with the same `folder` goes on where the first ended.
    """
    spark = stream.sparkSession
    base = folder or f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows"), f"{base}/state"


def state_rows(spark: SparkSession, place: str, operator: int = 0) -> DataFrame:
    """key, value: the state of a stream's operator after its last batch."""
    return spark.read.format("statestore").option("operatorId", operator).load(place).select("key", "value")


def complete_windows(
    stream: DataFrame,
    aggregates: Mapping[str, tuple[str, Column]],
    *,
    window: str = "4 seconds",
    stride: str = "2 seconds",
    lateness: str = "10 seconds",
    keys: Sequence[str] = ("video_id",),
    folder: str | None = None,
) -> DataFrame:
    """`live_windows` of a finite source with all windows. `aggregates` maps names to (kind, column)."""
    if wrong := [kind for kind, _ in aggregates.values() if kind not in KINDS]:
        raise ValueError(f"{wrong} are not among {list(KINDS)}")
    columns = {n: KINDS[kind](c) for n, (kind, c) in aggregates.items()}
    live = live_windows(stream, columns, window=window, stride=stride, lateness=lateness, keys=keys)
    closed, place = run_available(live, folder=folder)
    state = state_rows(stream.sparkSession, place)
    kinds = [f.name for f in state.schema["value"].dataType]
    if kinds != [kind for kind, _ in aggregates.values()]:
        raise RuntimeError(f"the state holds {kinds}")
    # by place: two aggregates of one kind have one name in the state
    named = ", ".join(f"`{n}`: {f.dataType.simpleString()}" for n, f in zip(aggregates, state.schema["value"].dataType, strict=True))
    value = F.col("value").cast(f"struct<{named}>")
    still = state.select(
        *[F.col("key")[k].alias(k) for k in keys], F.col("key.window.start").alias("start_ts"), F.col("key.window.end").alias("end_ts"), value.alias("_v")
    ).select(*keys, "start_ts", "end_ts", *[F.col("_v")[n].alias(n) for n in aggregates])
    return closed.unionByName(still)


def complete_islands(
    stream: DataFrame, gap: str, *, lateness: str = "10 seconds", keys: Sequence[str] = ("video_id",), folder: str | None = None
) -> DataFrame:
    """`live_islands` of a finite source with all islands.

    Sessions of a key that arrive in one batch are merged in the tasks that read them, before they are
    shuffled by key.
    """
    spark = stream.sparkSession
    merge = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(merge, "false")
    spark.conf.set(merge, "true")
    try:
        closed, place = run_available(live_islands(stream, gap, lateness=lateness, keys=keys), folder=folder)
    finally:
        spark.conf.set(merge, before)
    v = F.col("value")
    still = state_rows(spark, place).select(
        *[v[k].alias(k) for k in keys], v["session_window"]["start"].alias("first_ts"), v["max"].alias("last_ts"), v["count"].alias("events")
    )
    return closed.unionByName(still)
