"""Grids of music events, one row per event: track_id, kind, t."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.ordered import running


def within_track(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Distinct events inside [0, duration] of their track."""
    lengths = tracks.select("track_id", F.col("duration").alias("_d"))
    return (
        events.join(lengths, "track_id")
        .where((F.col("t") >= 0) & (F.col("t") <= F.col("_d")))
        .select("track_id", "kind", "t")
        .distinct()
    )


def combined_grid(events: DataFrame, tracks: DataFrame, *, digits: int = 3) -> DataFrame:
    """Beats and onsets together, rounded, distinct, inside the track before and after rounding."""
    lengths = tracks.select("track_id", F.col("duration").alias("_d"))
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) <= F.col("_d"))
    return (
        events.where(F.col("kind").isin("beat", "onset"))
        .join(lengths, "track_id")
        .where(inside("t"))
        .withColumn("t", F.round("t", digits))
        .where(inside("t"))
        .select("track_id", F.lit("combined").alias("kind"), "t")
        .distinct()
    )


def measure_grid(events: DataFrame, *, beats_per_measure: int = 4, width: float = 60.0) -> DataFrame:
    """Every fourth beat of a track, from the first."""
    beats = events.where(F.col("kind") == "beat").select("track_id", "t").distinct()
    numbered = running(beats, ["track_id"], F.col("t"), width, [F.col("t")], {"_n": ("sum", F.lit(1))})
    return numbered.where(F.col("_n") % beats_per_measure == 0).select(
        "track_id", F.lit("measure").alias("kind"), "t"
    )


def full_grid(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """The given events with the measure and combined grids derived from them."""
    own = within_track(events, tracks)
    return own.unionByName(measure_grid(own)).unionByName(combined_grid(own, tracks))
