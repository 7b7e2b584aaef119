"""From edit requests to timelines: many edits in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..schemas import FEATURE_COLUMNS, SAMPLE_COLUMNS
from ..session import freeze
from .normalize import zscore
from .ranking import best_per_bounds
from .segments import merge_ranges, ranked_segments
from .selection import EDIT, candidate_order, first_request, mandatory_clips, pad_and_clamp, select_greedy, unprobed, video_order
from .signals import engineered_signals
from .telemetry import window_rms
from .timeline import assemble_timeline, synchronize
from .windows import append_window_value, window_statistics

REQUEST = ("edit_id", "annotation_order", "video_id")


@dataclass(frozen=True)
class EditSettings:
    window: float = 4.0
    stride: float = 2.0
    dt: float = 0.5
    pitch_time_offset: float = 0.0
    top_windows: int = 10
    min_clip: float = 3.0
    max_clip: float = 0.0
    max_gap: float = 3.0
    padding: float = 2.0
    sync_mode: str = "off"
    max_synced_clip: float = 0.0


#: A sample belongs to the nearest step of its request's grid if it lies within this share of a step.
NEAR_STEP = 0.45


def _inside_requests(clips: DataFrame, samples: DataFrame, dt: float, bucket: float) -> DataFrame:
    """Samples inside optional requests with `_step`, the nearest step from the request's first sample, and `_off`, how far it is (in steps)."""
    asked = clips.where(~F.col("mandatory")).select(*REQUEST, "start_s", "end_s")
    at = lambda x: F.floor(x / bucket).cast("long")
    spread = asked.withColumn("_b", F.explode(F.sequence(at(F.col("start_s")), at(F.col("end_s")))))
    rows = samples.select("video_id", "t", *[c for c in SAMPLE_COLUMNS if c in samples.columns]).withColumn("_b", at(F.col("t")))
    inside = spread.join(rows, ["video_id", "_b"]).where(
        (F.col("t") > F.col("start_s") + 1e-6) & (F.col("t") < F.col("end_s") - 1e-6)
    )
    first = inside.groupBy(*REQUEST).agg(F.min("t").alias("_first"))
    n = (F.col("t") - F.col("_first")) / dt
    rows = inside.join(first, list(REQUEST)).withColumns({"_step": F.round(n).cast("int"), "_off": F.abs(n - F.round(n))})
    return rows.drop("_b", "start_s", "end_s", "_first")


def samples_of_requests(clips: DataFrame, samples: DataFrame, *, dt: float = 0.5, bucket: float = 60.0) -> DataFrame:
    """The stored samples of each optional request, numbered from the first one inside it.

    A request may start anywhere, also off the lattice of its video's samples; its own grid
    then starts at its first sample, and every sample goes to the nearest step. Of several near one
    step the nearest stays; the others, and those between steps, are in `left_out_samples`. Requests
    are spread over time buckets.
    """
    rows = _inside_requests(clips, samples, dt, bucket).where(F.col("_off") <= NEAR_STEP)
    names = [c for c in rows.columns if c not in (*REQUEST, "_step")]
    best = rows.groupBy(*REQUEST, "_step").agg(F.min_by(F.struct(*names), F.struct("_off", "t")).alias("_s"))
    return best.select(*REQUEST, F.col("_step").alias("sample_idx"), "_s.*").drop("_off")


def left_out_samples(clips: DataFrame, samples: DataFrame, *, dt: float = 0.5, bucket: float = 60.0) -> DataFrame:
    """Per optional request with samples that its grid has no place for: how many are inside and how many of them are used."""
    rows = _inside_requests(clips, samples.select("video_id", "t"), dt, bucket)
    near = F.countDistinct(F.when(F.col("_off") <= NEAR_STEP, F.col("_step")))
    counts = rows.groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("inside"), near.alias("used"))
    return counts.where("used < inside")


def unserved(clips: DataFrame, scored: DataFrame) -> DataFrame:
    """Optional requests from which no window was scored."""
    return clips.where(~F.col("mandatory")).join(scored.select(*REQUEST).distinct(), list(REQUEST), "left_anti")


def off_lattice(clips: DataFrame, samples: DataFrame, *, dt: float = 0.5) -> DataFrame:
    """Optional requests that do not start on the sample lattice of their video."""
    phase = samples.groupBy("video_id").agg(F.min("t").alias("_t0"))
    n = (F.col("start_s") - F.col("_t0")) / dt
    return clips.where(~F.col("mandatory")).join(phase, "video_id").where(F.abs(n - F.round(n)) > 1e-6).drop("_t0")


def score_requests(
    clips: DataFrame,
    samples: DataFrame,
    pitch: DataFrame | None,
    score: Callable[[DataFrame], DataFrame],
    settings: EditSettings = EditSettings(),
) -> DataFrame:
    """Scored windows of every optional request, normalized within the request.

    `score` takes the normalized windows and adds a column `score`.
    """
    own = samples_of_requests(clips, samples, dt=settings.dt)
    stats = window_statistics(
        engineered_signals(own, ids=[*REQUEST, "sample_idx", "t"]),
        window=settings.window,
        stride=settings.stride,
        dt=settings.dt,
        keys=REQUEST,
    )
    names = [n for n in FEATURE_COLUMNS if n in stats.columns]
    if pitch is not None:
        rms = window_rms(
            stats,
            pitch,
            offset=settings.pitch_time_offset,
            bucket=settings.stride,
            ids=("edit_id", "annotation_order", "window_index"),
        )
        stats = append_window_value(stats, rms, "pitch_rate_rms", keys=REQUEST)
        names.append("pitch_rate_rms")
        stats = stats.where(F.col("pitch_rate_rms").isNotNull())  # before normalizing, as in training
    stats = freeze(stats)  # read for the statistics and for the scaling
    return score(zscore(stats, names, keys=REQUEST)).select(*REQUEST, "window_index", "start_s", "end_s", "score")


def candidates_of(scored: DataFrame, clips: DataFrame, videos: DataFrame, settings: EditSettings = EditSettings()) -> DataFrame:
    """Pool the windows of an edit's requests per video, keep the best, merge, pad, and find their line.

    Windows of a video without a known length give no candidate (`EditPlan.unprobed`).
    """
    per_video = (EDIT, "video_id")
    pooled = best_per_bounds(scored, keys=per_video)
    segments = ranked_segments(pooled, k=settings.top_windows, gap=settings.max_gap, keys=per_video, tie=("end_s",))
    padded = pad_and_clamp(segments, videos, min_clip=settings.min_clip, padding=settings.padding, strict=False)
    asked = clips.where(~F.col("mandatory"))
    lined = first_request(padded, asked)
    return lined.join(video_order(clips), [EDIT, "video_id"]).select(
        EDIT,
        "video_id",
        "video_order",
        "start_s",
        "end_s",
        "duration",
        "max_score",
        "mean_score",
        "evidence",
        "annotation_order",
    )


@dataclass(frozen=True)
class EditPlan:
    candidates: DataFrame
    selected: DataFrame
    timeline: DataFrame
    #: optional requests too short for a window, or without samples or telemetry
    unserved: DataFrame
    #: optional requests with samples off their grid, and how many of theirs were used
    left_out: DataFrame
    #: scored windows of videos without a known length
    unprobed: DataFrame


def plan_edits(
    clips: DataFrame,
    samples: DataFrame,
    videos: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    *,
    pitch: DataFrame | None = None,
    music: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    settings: EditSettings = EditSettings(),
) -> EditPlan:
    """Requests to timeline. `music` is (events, tracks, edit_id -> track_id); a track's length is the budget."""
    scored = score_requests(clips, samples, pitch, score, settings)
    candidates = freeze(candidates_of(scored, clips, videos, settings))
    fixed = mandatory_clips(clips)
    budgets = None
    if music is not None:
        events, tracks, edits = music
        budgets = edits.join(tracks, "track_id").select(EDIT, F.col("duration").alias("budget"))
    selected = select_greedy(
        candidates, fixed, budgets=budgets, min_clip=settings.min_clip, max_clip=settings.max_clip
    )
    timeline = assemble_timeline(selected, fixed)
    if music is not None:
        timeline = synchronize(
            timeline, events, tracks, edits, mode=settings.sync_mode, max_synced=settings.max_synced_clip
        )
    off_grid = left_out_samples(clips, samples, dt=settings.dt)
    return EditPlan(candidates, selected, timeline, unserved(clips, scored), off_grid, unprobed(scored, videos))


def processing_ranges(clips: DataFrame) -> DataFrame:
    """Merged requested ranges per edit and video."""
    return merge_ranges(clips, keys=(EDIT, "video_id")).drop("members")


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of an edit in the order they are considered."""
    return candidates.orderBy(EDIT, *candidate_order())
