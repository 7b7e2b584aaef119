"""Top windows, islands of intervals, and ranked segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ordered import CHUNK, chunk_of, running
from ..session import freeze

KEYS = ("video_id",)


def top_windows(
    scores: DataFrame, k: int = 10, *, keys: Sequence[str] = KEYS, tie: Sequence[str] = ("window_index",)
) -> DataFrame:
    """The k best windows of each key: score, then earlier start, then `tie`.

    Spark limits each task to k rows per key before the shuffle (window group limit).
    """
    if k < 1:
        raise ValueError("k must be positive")
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "start_s", *tie)
    return scores.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def merge_ranges(
    intervals: DataFrame, *, gap: float = 0.0, keys: Sequence[str] = KEYS, width: float = 600.0
) -> DataFrame:
    """The union of intervals per key, with how many went into each piece (`members`).

    Intervals that touch, overlap or lie within `gap` of the latest end so far become one.
    First every chunk of `width` seconds merges its own intervals, which is where almost
    all of them go; what is left is merged across chunks with running values carried from
    chunk to chunk. No key is ever in one task as a whole.
    """
    keys = list(keys)
    cut = intervals.select(*keys, "start_s", "end_s").withColumn(CHUNK, chunk_of(F.col("start_s"), width))
    w = W.partitionBy(*keys, CHUNK).orderBy("start_s", "end_s").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys, CHUNK).orderBy("start_s", "end_s").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max("end_s").over(w)
    opens = (reach.isNull() | (F.col("start_s") - reach > gap)).cast("long")
    local = (
        cut.withColumn("_opens", opens)
        .withColumn("_piece", F.sum("_opens").over(upto))
        .groupBy(*keys, CHUNK, "_piece")
        .agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("members"))
        .drop(CHUNK, "_piece")
    )
    local = freeze(local)  # the pieces are read once per running value
    order = [F.col("start_s"), F.col("end_s")]
    seen = running(local, keys, F.col("start_s"), width, order, {"_reach": ("max", F.col("end_s"))})
    flag = (F.col("_reach").isNull() | (F.col("start_s") - F.col("_reach") > gap)).cast("long")
    flagged = seen.withColumn("_opens", flag)
    numbered = running(flagged, keys, F.col("start_s"), width, order, {"_before": ("sum", F.col("_opens"))})
    return (
        numbered.groupBy(*keys, (F.col("_before") + F.col("_opens")).alias("_piece"))
        .agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("members").alias("members"))
        .drop("_piece")
    )


def merge_top_windows(
    top: DataFrame, gap: float, *, keys: Sequence[str] = KEYS, tie: Sequence[str] = ("window_index",)
) -> DataFrame:
    """Merge the few chosen windows of each key into segments with their evidence.

    Input is bounded by k rows per key (see `top_windows`), so plain windows per key do.
    """
    order = list(dict.fromkeys(["start_s", "end_s", *tie]))
    w = W.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("end_s").over(before)
    opens = (reach.isNull() | (F.col("start_s") - reach > gap)).cast("int")
    proof = F.struct(*order, "score")
    return (
        top.withColumn("_opens", opens)
        .withColumn("_segment", F.sum("_opens").over(w))
        .groupBy(*keys, "_segment")
        .agg(
            F.min("start_s").alias("start_s"),
            F.max("end_s").alias("end_s"),
            F.max("score").alias("max_score"),
            F.count(F.lit(1)).cast("int").alias("window_count"),
            F.avg("score").alias("mean_score"),
            F.array_sort(F.collect_list(proof)).alias("evidence"),
        )
        .withColumn("duration", F.col("end_s") - F.col("start_s"))
        .drop("_segment")
    )


SEGMENT_ORDER = ("max_score", "window_count", "mean_score", "duration")


def segment_order() -> list[Column]:
    return [F.desc(c) for c in SEGMENT_ORDER] + [F.asc("start_s")]


def ranked_segments(
    scores: DataFrame,
    *,
    k: int = 10,
    gap: float = 2.0,
    keys: Sequence[str] = KEYS,
    tie: Sequence[str] = ("window_index",),
) -> DataFrame:
    """The k best windows per key, merged by gap, segments ranked within the key."""
    if not 0 <= gap < float("inf"):
        raise ValueError("gap must be finite and not negative")
    merged = merge_top_windows(top_windows(scores, k, keys=keys, tie=tie), gap, keys=keys, tie=tie)
    w = W.partitionBy(*keys).orderBy(*segment_order())
    return merged.withColumn("segment_rank", F.row_number().over(w))
