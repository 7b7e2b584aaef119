"""How good a ranking of windows is, per video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.intervals import overlap_pairs
from ..schemas import GAINS
from .segments import merge_ranges

KEYS = ("video_id",)
TOUCH = 1e-9
EVENT_GRADE = 3


def gain(label: Column) -> Column:
    out = F.lit(GAINS[0])
    for grade, g in enumerate(GAINS):
        out = F.when(label == grade, F.lit(g)).otherwise(out)
    return out


def top_k(scored: DataFrame, k: int, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """The k best windows; equal scores in window order."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "window_index")
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def segment_recall_by_video(
    scored: DataFrame, *, k: int = 5, keys: Sequence[str] = KEYS, width: float = 600.0
) -> DataFrame:
    """Events (islands of grade 3) per video, and how many hold a window of the top k.

    `scored` has start_s, end_s, label, score. Videos without events are absent.
    """
    if k < 1:
        raise ValueError("k must be positive")
    best = scored.where(F.col("label") == EVENT_GRADE)
    events = merge_ranges(best, gap=TOUCH, keys=keys, width=width)
    # a window of this grade lies in exactly one event, so overlap is membership
    top = top_k(scored, k, keys=keys).where(F.col("label") == EVENT_GRADE)
    found = overlap_pairs(
        events, top.select(*keys, F.col("start_s").alias("_s"), F.col("end_s").alias("_e")), keys,
        ("start_s", "end_s"), ("_s", "_e"), width=width,
    )
    hit = found.select(*keys, "start_s").distinct().withColumn("hit", F.lit(1))
    events = events.join(hit, [*keys, "start_s"], "left").na.fill({"hit": 0})
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("hit").cast("long").alias("hits"),
        (F.sum("hit") / F.count(F.lit(1))).alias("recall"),
    )


def segment_recall(scored: DataFrame, *, k: int = 5, keys: Sequence[str] = KEYS, width: float = 600.0) -> DataFrame:
    """One row: mean recall over videos that have events (null without any), and the counts."""
    per_video = segment_recall_by_video(scored, k=k, keys=keys, width=width)
    none = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_video.agg(
        F.avg("recall").alias("segment_recall"),
        F.count(F.lit(1)).alias("videos_with_events"),
        none("events").alias("events"),
        none("hits").alias("hit_events"),
    ).withColumn("k", F.lit(k))


def ndcg_by_video(scored: DataFrame, *, k: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Discounted gain of the k best-scored windows over that of the best possible order.

    A video without any gain counts as 1.
    """
    by_score = W.partitionBy(*keys).orderBy(F.desc("score"), "window_index")
    by_gain = W.partitionBy(*keys).orderBy(F.desc("gain"), "window_index")
    gains = scored.select(*keys, "window_index", "score", gain(F.col("label")).alias("gain"))

    def dcg(w, name: str) -> DataFrame:
        ranked = gains.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
        return ranked.groupBy(*keys).agg(F.sum(F.col("gain") / F.log2(F.col("_rank") + 1)).alias(name))

    return (
        dcg(by_score, "dcg")
        .join(dcg(by_gain, "ideal"), list(keys))
        .withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(1.0))
    )
