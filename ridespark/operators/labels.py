"""Grades of windows from annotated intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.times import window_count
from ..plans.intervals import overlap_pairs, overlap_seconds

TIE = 1e-9


def window_grade_seconds(
    windows: DataFrame, annotations: DataFrame, *, keys: Sequence[str] = ("video_id",), bucket: float = 60.0
) -> DataFrame:
    """Seconds of each grade inside each window, for grades that occur."""
    spans = annotations.select(*keys, F.col("start_s").alias("a_start"), F.col("end_s").alias("a_end"), "score")
    win = windows.select(*keys, "window_index", "start_s", "end_s")
    pairs = overlap_pairs(win, spans, keys, ("start_s", "end_s"), ("a_start", "a_end"), width=bucket)
    seconds = overlap_seconds(*[F.col(c) for c in ("start_s", "end_s", "a_start", "a_end")])
    return pairs.groupBy(*keys, "window_index", "score").agg(F.sum(seconds).alias("seconds"))


def majority_grade(
    windows: DataFrame, annotations: DataFrame, *, keys: Sequence[str] = ("video_id",), bucket: float = 60.0
) -> DataFrame:
    """The grade with most seconds per window; ties go to the higher grade.

    Windows without annotated time are left out.
    """
    seconds = window_grade_seconds(windows, annotations, keys=keys, bucket=bucket)
    per_window = seconds.groupBy(*keys, "window_index").agg(
        F.max("seconds").alias("most"), F.collect_list(F.struct("score", "seconds")).alias("all")
    )  # at most one entry per grade
    leaders = F.filter("all", lambda g: g["seconds"] >= F.col("most") - TIE)
    return per_window.where(F.col("most") > 0).select(
        *keys,
        "window_index",
        F.array_max(F.transform(leaders, lambda g: g["score"])).alias("label"),
    )


def label_windows(
    windows: DataFrame, annotations: DataFrame, *, keys: Sequence[str] = ("video_id",), bucket: float = 60.0
) -> DataFrame:
    """The windows that have a grade, with it."""
    grades = majority_grade(windows, annotations, keys=keys, bucket=bucket)
    return windows.join(grades, [*keys, "window_index"])


def planned_windows(
    videos: DataFrame, *, window: float, stride: float, keys: Sequence[str] = ("video_id",)
) -> DataFrame:
    """The windows a recording of this duration would give, counted from time 0."""
    n = window_count(F.col("duration"), window, stride)
    k = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    return (
        videos.where(n > 0)
        .select(*keys, k.alias("k"))
        .select(
            *keys,
            F.col("k").cast("int").alias("window_index"),
            (F.col("k") * float(stride)).alias("start_s"),
            (F.col("k") * float(stride) + float(window)).alias("end_s"),
        )
    )


def window_purity(
    videos: DataFrame,
    annotations: DataFrame,
    *,
    window: float = 4.0,
    stride: float = 2.0,
    keys: Sequence[str] = ("video_id",),
    bucket: float = 60.0,
) -> DataFrame:
    """Per video: windows in all, and how many touch one grade, several, or none."""
    touched = (
        window_grade_seconds(
            planned_windows(videos, window=window, stride=stride, keys=keys), annotations, keys=keys, bucket=bucket
        )
        .groupBy(*keys, "window_index")
        .agg(F.count(F.lit(1)).alias("grades"))
        .groupBy(*keys)
        .agg(
            F.sum((F.col("grades") == 1).cast("long")).alias("pure_windows"),
            F.sum((F.col("grades") > 1).cast("long")).alias("conflicting_windows"),
        )
    )
    total = window_count(F.col("duration"), window, stride)
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return (
        videos.select(*keys, total.alias("total_windows"))
        .join(touched, list(keys), "left")
        .select(
            *keys,
            "total_windows",
            none("pure_windows").alias("pure_windows"),
            none("conflicting_windows").alias("conflicting_windows"),
            (F.col("total_windows") - none("pure_windows") - none("conflicting_windows")).alias("uncovered_windows"),
        )
    )
