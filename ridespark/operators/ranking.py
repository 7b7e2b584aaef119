"""Ranks and summaries of window scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.ordered import ordinal
from ..plans.quantiles import exact_quantiles, join_on

KEYS = ("video_id",)


def rank_in_key(scores: DataFrame, *, keys: Sequence[str] = KEYS, name: str = "rank_in_video") -> DataFrame:
    """1 for the best score of the key; equal scores in window order."""
    return ordinal(scores, [F.desc("score"), F.asc("window_index")], keys, name)


def rank_global(scores: DataFrame, *, keys: Sequence[str] = KEYS, name: str = "rank_global") -> DataFrame:
    """1 for the best score of all; equal scores by key, then window."""
    order = [F.desc("score"), *[F.asc(k) for k in keys], F.asc("window_index")]
    return ordinal(scores, order, (), name)


def score_summary(scores: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key: how many windows, the spread of the scores, and the best window."""
    best = F.max_by(
        F.struct("window_index", "start_s", "end_s", "score"), F.struct(F.col("score"), -F.col("window_index"))
    )
    plain = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("window_count"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
        F.avg("score").alias("score_mean"),
        F.stddev_pop("score").alias("score_std"),
        best.alias("_best"),
    )
    median = exact_quantiles(scores, keys, {"score_median": F.col("score")}, [0.5])
    return join_on(plain, median, list(keys)).select(
        *keys,
        "window_count",
        "score_min",
        "score_max",
        (F.col("score_max") - F.col("score_min")).alias("score_range"),
        "score_mean",
        F.col("score_median")[0].alias("score_median"),
        "score_std",
        F.col("_best.window_index").alias("best_window_index"),
        F.round("_best.start_s", 3).alias("best_window_start_s"),
        F.round("_best.end_s", 3).alias("best_window_end_s"),
        F.col("_best.score").alias("best_window_score"),
    )


# fixed values: columns of the score report, in file order
REPORT_COLUMNS = (
    "rank_global",
    "video_id",
    "group_id",
    "window_index",
    "start_s",
    "end_s",
    "duration_s",
    "score",
    "rank_in_video",
    "score_min",
    "score_max",
    "score_range",
    "window_count",
)


def score_report(scores: DataFrame, manifest: DataFrame, *, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Every scored window with its ranks and its video's range, and the summary per video.

    The two results are tables to be ordered and written by `sources.sinks`. A video that the manifest
    does not list stays, without a group (see `unlisted`).
    """
    groups = manifest.select(*keys, "group_id").dropDuplicates(list(keys))
    summary = score_summary(scores, keys=keys).join(groups, list(keys), "left")
    ranked = rank_in_key(rank_global(scores, keys=keys), keys=keys)
    per_key = summary.select(*keys, "group_id", "score_min", "score_max", "score_range", "window_count")
    rows = ranked.join(per_key, list(keys)).withColumns(
        {
            "duration_s": F.round(F.col("end_s") - F.col("start_s"), 3),
            "start_s": F.round("start_s", 3),
            "end_s": F.round("end_s", 3),
        }
    )
    return rows.select(*REPORT_COLUMNS), summary


def unlisted(scores: DataFrame, manifest: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Findings: keys with rows in `scores` and none in the manifest, and how many rows."""
    return (
        scores.join(manifest.select(*keys), list(keys), "left_anti")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumns({"severity": F.lit("error"), "code": F.lit("not_in_manifest")})
    )


def best_per_bounds(scores: DataFrame, *, keys: Sequence[str] = KEYS, digits: int = 6) -> DataFrame:
    """Windows with the same rounded bounds once, with the highest score."""
    return scores.groupBy(
        *keys, F.round("start_s", digits).alias("start_s"), F.round("end_s", digits).alias("end_s")
    ).agg(F.max("score").alias("score"))
