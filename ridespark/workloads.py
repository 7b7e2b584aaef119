"""The registered queries: every operator run over the benchmark tables.

Each query takes (spark, folder of parquet tables) and returns a DataFrame. Numbers are
rounded so that results can be compared with the SQL in `workload_sql`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import adapters as A
from .functions import metadata
from .functions.digests import content_digest
from .functions.scaling import compress_spikes, power_colour
from .functions.text import path_kind
from .functions.times import clock_of, rate_of, seconds_of, whole_second, window_count
from .operators import (
    asof,
    audit,
    edits,
    flow,
    interest,
    labels,
    learning,
    metrics,
    music,
    normalize,
    ranking,
    segments,
    selection,
    signals,
    smoothing,
    stats,
    store,
    telemetry,
    timeline,
    windows,
)
from .plans.intervals import drop_overlapping
from .schemas import DELTA_SOURCES, SAMPLE_COLUMNS, SIGNAL_COLUMNS
from .session import checkpoint_folder, freeze
from .sources import flightlog, lists, manifest as manifests, sinks
from .streaming import finite, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WINDOW, STRIDE, DT = 4.0, 2.0, 0.5
IDS = ("video_id", "window_index", "start_s", "end_s")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    x = F.round((F.col(x) if isinstance(x, str) else x).cast("double"), digits)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def rounded(df: DataFrame, digits: int = 6, but: tuple[str, ...] = ()) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(
        *[r(c, digits).alias(c) if kinds[c] in ("double", "float") and c not in but else F.col(c) for c in df.columns]
    )


# -- shared steps -----------------------------------------------------------


def signal_table(spark, folder) -> DataFrame:
    return signals.engineered_signals(A.samples(spark, folder))


def scored_windows(spark, folder) -> DataFrame:
    """Windows scored by the z-score of the centre residual's 90th percentile."""
    stats_ = windows.window_statistics(
        signal_table(spark, folder), window=WINDOW, stride=STRIDE, dt=DT, names=["center_residual"]
    )
    z = normalize.zscore(stats_, ["center_residual_q90"])
    return z.select(*IDS, F.col("center_residual_q90").cast("double").alias("score"))


def labelled_scores(spark, folder) -> DataFrame:
    return labels.label_windows(scored_windows(spark, folder), A.annotations(spark, folder))


def training(spark, folder) -> DataFrame:
    return learning.training_table(
        A.samples(spark, folder), A.rates(spark, folder), A.annotations(spark, folder), A.manifest(spark, folder)
    )


# -- signals and flow -------------------------------------------------------


@query
def signals_engineered(spark, folder):
    return rounded(signal_table(spark, folder))


@query
def signals_exploratory(spark, folder):
    return rounded(signals.exploratory_signals(A.samples(spark, folder)))


@query
def signal_deltas(spark, folder):
    rows = A.samples(spark, folder).select("video_id", "sample_idx", *DELTA_SOURCES.values())
    return rounded(signals.sample_deltas(rows).select("video_id", "sample_idx", *DELTA_SOURCES))


@query
def spike_compression(spark, folder):
    return A.rates(spark, folder).select("event_id", r(compress_spikes(F.col("rate"))).alias("compressed"))


@query
def flow_frame(spark, folder):
    return rounded(flow.frame_statistics(A.flow(spark, folder)))


@query
def flow_field(spark, folder):
    return rounded(flow.field_statistics(A.flow(spark, folder), width=A.FLOW_WIDTH, height=A.FLOW_HEIGHT))


@query
def flow_grid(spark, folder):
    return rounded(flow.grid_statistics(A.flow(spark, folder), width=A.FLOW_WIDTH, height=A.FLOW_HEIGHT))


# -- windows ----------------------------------------------------------------


@query
def sampling_grid(spark, folder):
    grid = windows.sampling_grid(A.samples(spark, folder), window=WINDOW, stride=STRIDE)
    return rounded(grid)


@query
def windows_stats(spark, folder):
    return rounded(windows.window_statistics(signal_table(spark, folder), window=WINDOW, stride=STRIDE, dt=DT))


@query
def windows_by_grid(spark, folder):
    rows = signal_table(spark, folder).select("video_id", "sample_idx", "t", "roll_index")
    grid = windows.sampling_grid(rows, window=WINDOW, stride=STRIDE)
    return rounded(
        windows.window_statistics(rows, window=WINDOW, stride=STRIDE, grid=grid, names=["roll_index"])
    )


@query
def window_zscore(spark, folder):
    return rounded(scored_windows(spark, folder))


@query
def window_labels(spark, folder):
    return labelled_scores(spark, folder).select("video_id", "window_index", "label")


@query
def window_purity(spark, folder):
    return labels.window_purity(A.videos(spark, folder), A.annotations(spark, folder), window=WINDOW, stride=STRIDE)


@query
def duration_estimates(spark, folder):
    d = F.col("duration")
    return A.videos(spark, folder).select(
        "video_id",
        whole_second(d + 0.3).alias("whole_s"),
        window_count(d + 0.3, WINDOW, STRIDE).alias("n_windows"),
    )


def _rms(spark, folder):
    spans = windows.windowed(A.samples(spark, folder).select("video_id", "sample_idx", "t"), {}, window=WINDOW, stride=STRIDE, dt=DT)
    rms = telemetry.window_rms(spans, A.rates(spark, folder), bucket=STRIDE)
    return windows.append_window_value(spans, rms, "pitch_rate_rms")


@query
def telemetry_rms(spark, folder):
    return rounded(_rms(spark, folder))


@query
def telemetry_missing(spark, folder):
    spans = windows.windowed(A.samples(spark, folder).select("video_id", "sample_idx", "t"), {}, window=WINDOW, stride=STRIDE, dt=DT)
    rms = telemetry.window_rms(spans, A.rates(spark, folder), bucket=STRIDE, offset=22.0)
    return telemetry.missing_telemetry(windows.append_window_value(spans, rms, "pitch_rate_rms"))


@query
def telemetry_rms_steps(spark, folder):
    return rounded(
        windows.spread_to_steps(_rms(spark, folder), "pitch_rate_rms", window=WINDOW, stride=STRIDE, dt=DT)
    )


# -- telemetry --------------------------------------------------------------


@query
def nearest_asof(spark, folder):
    left = A.samples(spark, folder).select("video_id", "sample_idx", "t")
    found = asof.nearest(left, A.rates(spark, folder).select("video_id", "event_id", "t", "rate"), width=5.0)
    return rounded(found.select("video_id", "sample_idx", "near_event_id", "near_t", "near_rate"))


@query
def next_asof(spark, folder):
    left = A.samples(spark, folder).select("video_id", "sample_idx", "t")
    found = asof.first_at_or_after(left, A.rates(spark, folder).select("video_id", "event_id", "t"), width=5.0)
    return rounded(found.select("video_id", "sample_idx", "next_event_id", "next_t"))


@query
def clock_alignment(spark, folder):
    frames = A.samples(spark, folder).select("video_id", "sample_idx", "t").withColumn("epoch", F.col("video_id") * 10.0)
    found = telemetry.align_clocks(
        frames,
        A.rates(spark, folder).select("video_id", "event_id", "t"),
        video_epoch=F.col("epoch"),
        ride_start=F.col("epoch") - 1.25,
        offset=0.4,
        width=5.0,
    )
    return rounded(found.select("video_id", "sample_idx", "ride_event_id"))


@query
def pitch_rate(spark, folder):
    return rounded(telemetry.pitch_series(A.attitude(spark, folder)), 5)


@query
def acceleration_units(spark, folder):
    units = telemetry.acceleration_units(A.attitude(spark, folder))
    return rounded(telemetry.axis_mapping(units).drop("unit_scale"))


@query
def vehicle_motion(spark, folder):
    motion = telemetry.vehicle_motion(A.attitude(spark, folder))
    return rounded(motion.select("video_id", "sample_idx", "lateral", "longitudinal", "vertical", "combined", "tilt"), 5)


@query
def camera_tilt(spark, folder):
    return rounded(telemetry.camera_tilt(telemetry.vehicle_motion(A.attitude(spark, folder))), 5)


@query
def high_pass(spark, folder):
    out = smoothing.high_pass(A.attitude(spark, folder).select("video_id", "t", "ax"), ["ax"], seconds=3.0)
    return rounded(out)


@query
def euler_angles(spark, folder):
    from .functions.rotation import euler_degrees

    angle = euler_degrees(telemetry.quaternion())
    return rounded(
        A.attitude(spark, folder).select(
            "video_id", "sample_idx", *[angle[n].alias(n) for n in ("roll", "pitch", "yaw")]
        ),
        5,
    )


@query
def gps_track(spark, folder):
    track = telemetry.gps_track(A.attitude(spark, folder).select("video_id", "sample_idx", "t", "lat", "lon"))
    return rounded(track.select("video_id", "sample_idx", "step_m", "distance_m", "speed_ms", "heading_deg"), 3)


@query
def gps_validity(spark, folder):
    raw = A.attitude(spark, folder).select(
        "video_id", "sample_idx", (F.col("qw") * 8).alias("lat"), (F.col("qx") * 8).alias("lon"),
        F.pmod("sample_idx", F.lit(2)).alias("unit"),
    )
    return rounded(telemetry.valid_fix(raw, unit="unit"))


@query
def upsampled(spark, folder):
    ride = A.rates(spark, folder).select("video_id", "event_id", "t", F.col("rate").alias("speed"))
    return rounded(telemetry.upsample(ride, 4).select("event_id", "step", "speed"))


@query
def cadence(spark, folder):
    return rounded(telemetry.cadence(A.rates(spark, folder)), 4)


@query
def covered_cadence(spark, folder):
    log = A.clips(spark, folder).select("video_id", "start_s", "end_s")
    return rounded(telemetry.covered_cadence(log))


@query
def display_range(spark, folder):
    return rounded(telemetry.display_range(A.attitude(spark, folder), "az"))


@query
def telemetry_slice(spark, folder):
    return rounded(
        telemetry.between_times(A.rates(spark, folder), 5.0, 10.0).groupBy("video_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
        )
    )


def _device_rows(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("frame"),
        F.when(F.col("event_type") != "error", us).alias("timestamp_us"),
        (F.col("event_id") / 30).alias("track_time"),
        F.when(F.col("event_type") == "view", F.col("ts").cast("timestamp")).alias("gps_time"),
    )


@query
def sample_times(spark, folder):
    rows = telemetry.sample_times(_device_rows(spark, folder))
    return rounded(rows.select("video_id", "frame", "t"))


@query
def recording_start(spark, folder):
    rows = telemetry.sample_times(_device_rows(spark, folder))
    key = F.pmod("video_id", F.lit(3))
    videos = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).select(
        "video_id",
        F.concat(F.lit("a/DJI_2025092310"), F.lpad(F.pmod("video_id", F.lit(60)).cast("string"), 2, "0"), F.lit("00_1.MP4")).alias("video"),
        F.lit(None).cast("timestamp").alias("creation_time"),
    )
    without = rows.withColumn("gps_time", F.when(key != 0, F.col("gps_time")))
    start = telemetry.recording_start(without.where(F.col("t").isNotNull()), videos)
    return start.select("video_id", F.unix_micros("start_time").alias("start_us"), "start_source")


@query
def ride_channels(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    raw = e.select(
        "event_id",
        F.round(F.col("value") * 100).cast("long").alias("speed"),
        F.when(F.col("event_type") != "view", F.col("event_id")).alias("distance_km"),
        F.when(F.col("event_type") != "click", -F.col("user_id")).alias("altitude"),
        F.when(F.col("event_type") == "error", F.lit(-99900).cast("long")).otherwise(F.col("user_id")).alias("temperature"),
        F.pmod("event_id", F.lit(5)).alias("pressure"),
    )
    zero = [c for c in (*telemetry.RIDE_ZERO_WHEN_MISSING, *telemetry.RIDE_NULL_WHEN_MISSING) if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(None).cast("long") for c in zero})
    return rounded(
        telemetry.ride_channels(raw).select("event_id", "speed", "distance_km", "cadence", "altitude", "gradient", "temperature", "pressure")
    )


# -- smoothing and interest -------------------------------------------------


@query
def rolling_median(spark, folder):
    rows = signal_table(spark, folder).select("video_id", "sample_idx", "t", F.col("roll_index").cast("double").alias("roll_index"))
    return rounded(smoothing.rolling_median(rows, ["roll_index"], 2.0))


@query
def rolling_median_uneven(spark, folder):
    rows = A.rates(spark, folder).select("video_id", "event_id", "t", "rate")
    return rounded(smoothing.rolling_median(rows, ["rate"], 1.5, width=5.0).select("event_id", "rate"))


@query
def polynomial_smooth(spark, folder):
    rows = signal_table(spark, folder).select("video_id", "sample_idx", F.col("roll_index").cast("double").alias("roll_index"))
    return rounded(smoothing.polynomial_smooth(rows, ["roll_index"]))


@query
def interest_channels(spark, folder):
    return rounded(interest.interest_channels(A.samples(spark, folder)))


@query
def interest_windows(spark, folder):
    rows = signal_table(spark, folder).select("video_id", "t", F.col("roll_index").cast("double").alias("roll_index"))
    return rounded(windows.interest_windows(rows, ["roll_index"], sizes=[4.0, 6.0], stride=2.0))


# -- ranking ----------------------------------------------------------------


@query
def rank_in_video(spark, folder):
    return ranking.rank_in_key(scored_windows(spark, folder)).select("video_id", "window_index", "rank_in_video")


@query
def rank_global(spark, folder):
    return ranking.rank_global(scored_windows(spark, folder)).select("video_id", "window_index", "rank_global")


@query
def video_summary(spark, folder):
    return rounded(ranking.score_summary(scored_windows(spark, folder)))


@query
def score_report(spark, folder):
    rows, _ = ranking.score_report(scored_windows(spark, folder), A.manifest(spark, folder))
    return rounded(rows)


@query
def top_segments(spark, folder):
    out = segments.ranked_segments(scored_windows(spark, folder), k=10, gap=2.0)
    return rounded(
        out.select("video_id", "segment_rank", "start_s", "end_s", "max_score", "window_count", "mean_score", "duration")
    )


@query
def merge_ranges(spark, folder):
    return rounded(segments.merge_ranges(A.clips(spark, folder), width=5.0).drop("members"))


@query
def best_per_bounds(spark, folder):
    rows = A.clips(spark, folder).select(
        "video_id", F.round("start_s", 0).alias("start_s"), (F.round("start_s", 0) + 4).alias("end_s"), (F.col("end_s") - F.col("start_s")).alias("score")
    )
    return rounded(ranking.best_per_bounds(rows))


@query
def segment_recall(spark, folder):
    return rounded(metrics.segment_recall(labelled_scores(spark, folder), k=5))


@query
def segment_recall_by_video(spark, folder):
    return rounded(metrics.segment_recall_by_video(labelled_scores(spark, folder), k=3))


@query
def ndcg(spark, folder):
    return rounded(metrics.ndcg_by_video(labelled_scores(spark, folder), k=10))


# -- selection, timelines and music -----------------------------------------


def _optional(clips):
    return clips.where(~F.col("mandatory"))


@query
def free_of_mandatory(spark, folder):
    clips = A.clips(spark, folder)
    out = drop_overlapping(
        _optional(clips), clips.where("mandatory"), ["edit_id", "video_id"], ("start_s", "end_s"), ("start_s", "end_s"), width=2.0
    )
    return out.select("annotation_order")


@query
def video_order(spark, folder):
    return selection.video_order(A.clips(spark, folder))


@query
def mandatory_clips(spark, folder):
    return rounded(selection.mandatory_clips(A.clips(spark, folder)))


@query
def padded_segments(spark, folder):
    segs = segments.ranked_segments(scored_windows(spark, folder), k=10, gap=2.0)
    out = selection.pad_and_clamp(segs, A.videos(spark, folder), min_clip=5.0, padding=1.5)
    return rounded(out.select("video_id", "start_s", "end_s", "duration", "window_count"))


@query
def first_request(spark, folder):
    segs = segments.ranked_segments(scored_windows(spark, folder), k=10, gap=2.0).select(
        "video_id", F.col("start_s").alias("core_start"), F.col("end_s").alias("core_end")
    )
    found = selection.first_request(segs, A.clips(spark, folder), keys=("video_id",))
    return rounded(found)


@query
def trimmed_segments(spark, folder):
    segs = segments.ranked_segments(scored_windows(spark, folder), k=10, gap=2.0)
    out = selection.trim_to_evidence(segs, max_clip=5.0, min_clip=3.0)
    return rounded(out.select("video_id", "start_s", "end_s", "duration", "max_score", "mean_score", F.size("evidence").alias("evidence_count")))


def _event_candidates(spark, folder):
    c = _optional(A.clips(spark, folder))
    length = F.col("end_s") - F.col("start_s")
    proof = F.struct("start_s", "end_s", F.col("annotation_order").alias("window_index"), length.alias("score"))
    rows = c.select(
        "edit_id", "video_id", F.lit(0).alias("video_order"), "start_s", "end_s", length.alias("duration"),
        length.alias("max_score"), length.alias("mean_score"), F.array(proof).alias("evidence"), "annotation_order",
    )
    return rows


@query
def select_greedy(spark, folder):
    fixed = A.clips(spark, folder).where("mandatory")
    out = selection.select_greedy(_event_candidates(spark, folder), fixed, min_clip=0.5)
    return rounded(out.select("edit_id", "video_id", "start_s", "end_s", "max_score", "annotation_order"))


@query
def select_greedy_budget(spark, folder):
    clips = A.clips(spark, folder)
    budgets = clips.groupBy("edit_id").agg(
        (F.sum(F.when(F.col("mandatory"), F.col("end_s") - F.col("start_s")).otherwise(0.0)) + 40.0).alias("budget")
    )
    out = selection.select_greedy(
        _event_candidates(spark, folder), clips.where("mandatory"), budgets=budgets, min_clip=0.5
    )
    return rounded(out.select("edit_id", "video_id", "start_s", "end_s", "max_score", "annotation_order"))


def _clip_rows(spark, folder):
    c = A.clips(spark, folder)
    return c.select(
        "edit_id",
        "video_id",
        F.col("start_s").alias("source_start"),
        F.col("end_s").alias("source_end"),
        "mandatory",
        F.col("annotation_order").alias("line"),
    )


@query
def timeline_positions(spark, folder):
    return rounded(timeline.place_clips(_clip_rows(spark, folder)).select("line", "position", "output_start", "output_end"))


@query
def timeline_sync(spark, folder):
    clips = _clip_rows(spark, folder)
    edits_ = clips.groupBy("edit_id").agg(F.min("video_id").alias("track_id"))
    out = timeline.synchronize(
        timeline.place_clips(clips), A.music(spark, folder), A.tracks(spark, folder), edits_, mode="beat", max_synced=4.0, width=5.0
    )
    return rounded(out.select("line", "source_start", "source_end", "output_start", "position"))


def _cut_points(spark, folder):
    return A.clips(spark, folder).select(
        F.col("video_id").alias("track_id"), "annotation_order", (F.col("end_s") + 0.05).alias("t")
    )


@query
def snap_beats(spark, folder):
    out = timeline.snap_times(_cut_points(spark, folder), A.music(spark, folder), mode="beat", width=5.0)
    return rounded(out.select("annotation_order", "snapped"))


@query
def snap_forward(spark, folder):
    out = timeline.snap_times(_cut_points(spark, folder), A.music(spark, folder), mode="forward-beat", width=5.0)
    return rounded(out.select("annotation_order", "snapped"))


@query
def snap_measure(spark, folder):
    events, tracks = A.music(spark, folder), A.tracks(spark, folder)
    grid = music.full_grid(events, tracks)
    out = timeline.snap_times(_cut_points(spark, folder), grid, mode="measure", width=5.0)
    return rounded(out.select("annotation_order", "snapped"))


@query
def combined_grid(spark, folder):
    return music.combined_grid(A.music(spark, folder), A.tracks(spark, folder))


@query
def measure_grid(spark, folder):
    return rounded(music.measure_grid(A.music(spark, folder), width=5.0))


def _edit_requests(spark, folder):
    """Whole-length requests of all videos, three videos per edit, plus short mandatory ones."""
    v = A.videos(spark, folder).withColumn("edit_id", F.floor(F.col("video_id") / 3).cast("long"))
    row = lambda start, end, must, line: v.select(
        "edit_id", "video_id", start.alias("start_s"), end.alias("end_s"), F.lit(must).alias("mandatory"), line.alias("annotation_order")
    )
    line = F.col("video_id") * 10
    return (
        row(F.lit(4.0), F.col("duration") - 6, False, line + 1)
        .unionByName(row(F.col("duration") - 12, F.col("duration"), False, line + 2))
        .unionByName(row(F.lit(0.0), F.lit(1.0), True, line + 3))
    )


def _edit_plan(spark, folder):
    clips = _edit_requests(spark, folder)
    edits_ = clips.select("edit_id").distinct().withColumn("track_id", F.col("edit_id"))
    settings = edits.EditSettings(min_clip=3.0, max_clip=9.0, sync_mode="combined")
    events, tracks = A.music(spark, folder), A.tracks(spark, folder)
    grid = music.full_grid(events, tracks)
    score = lambda w: w.withColumn("score", F.col("center_residual_q90").cast("double"))
    return edits.plan_edits(
        clips, A.samples(spark, folder), A.videos(spark, folder), score,
        pitch=A.rates(spark, folder), music=(grid, tracks, edits_), settings=settings,
    )


@query
def edit_timelines(spark, folder):
    t = _edit_plan(spark, folder).timeline
    return rounded(t.select("edit_id", "position", "video_id", "source_start", "source_end", "output_start", "output_end", "mandatory", "score"))


@query
def edit_results(spark, folder):
    doc = sinks.edit_results(_edit_plan(spark, folder))
    return doc.select("edit_id", "candidate_count", "selected_optional_count", "mandatory_count", F.to_json("timeline").alias("timeline"))


# -- learning ---------------------------------------------------------------


@query
def training_table(spark, folder):
    return rounded(training(spark, folder), 4)


@query
def class_counts(spark, folder):
    return learning.class_counts(labelled_scores(spark, folder).join(A.manifest(spark, folder), "video_id"))


@query
def query_sizes(spark, folder):
    return learning.query_sizes(labelled_scores(spark, folder))


@query
def ranker_boosted(spark, folder):
    table = training(spark, folder)
    model = learning.fit_boosted(table, learning.RankerSettings(max_iter=5, max_depth=3))
    return rounded(model.transform(table).select("video_id", "window_index", "label", "score"))


@query
def ranker_pairwise(spark, folder):
    table = training(spark, folder)
    return rounded(learning.fit_pairwise(table).transform(table).select("video_id", "window_index", "label", "score"))


@query
def class_probabilities(spark, folder):
    table = training(spark, folder)
    return rounded(learning.class_probabilities(learning.fit_classes(table, trees=5), table))


@query
def leave_one_group_out(spark, folder):
    return rounded(learning.leave_one_group_out(training(spark, folder), learning.fit_pairwise))


@query
def train_ranker(spark, folder):
    table = training(spark, folder)
    ranker, _ = learning.train_ranker(
        table, train=["g0", "g1"], validation=["g2"], settings=learning.RankerSettings(max_iter=4, max_depth=3)
    )
    raw = learning.feature_windows(A.samples(spark, folder), A.rates(spark, folder))
    return rounded(learning.score_windows(ranker, raw))


@query
def search_ranker(spark, folder):
    trials = learning.draw_trials(learning.search_space(max_iter=2, max_depth=learning.Choice((2, 3)), min_instances_per_node=5), 2)
    return learning.search_ranker(training(spark, folder), trials, proxy_groups=["g0", "g1"]).select("number", r("value").alias("value"), "videos")


def _trials(spark, folder):
    """One trial per user and event type: the share of high values against the share of low ones."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    return e.groupBy(F.col("event_type").alias("study"), F.col("user_id").alias("number")).agg(
        F.avg((F.col("value") > 20).cast("double")).alias("value_0"), F.avg((F.col("value") < 5).cast("double")).alias("value_1")
    )


@query
def pareto_trials(spark, folder):
    return rounded(stats.pareto_trials(_trials(spark, folder)))


@query
def study_choices(spark, folder):
    return stats.study_choices(_trials(spark, folder))


@query
def best_trial(spark, folder):
    return rounded(stats.best_trial(_trials(spark, folder).withColumnRenamed("value_0", "value")))


# -- statistics -------------------------------------------------------------


@query
def pearson(spark, folder):
    return rounded(stats.pearson(signal_table(spark, folder), SIGNAL_COLUMNS))


@query
def pearson_by_video(spark, folder):
    return rounded(stats.pearson(signal_table(spark, folder), SIGNAL_COLUMNS[:4], keys=["video_id"]))


@query
def spearman(spark, folder):
    return rounded(stats.spearman(signal_table(spark, folder), SIGNAL_COLUMNS, ids=["video_id", "sample_idx"]))


@query
def column_profile(spark, folder):
    return rounded(stats.column_profile(A.samples(spark, folder), SAMPLE_COLUMNS))


# -- audits -----------------------------------------------------------------


@query
def sequence_audit(spark, folder):
    return audit.audit_sequences(A.samples(spark, folder))


@query
def sequence_validity(spark, folder):
    return rounded(audit.sequence_validity(A.samples(spark, folder)))


@query
def window_audit(spark, folder):
    return audit.audit_windows(A.samples(spark, folder), A.annotations(spark, folder))


def _customer_manifest(spark, folder):
    c = spark.read.parquet(f"{folder}/customer.parquet")
    return c.select(
        F.concat(F.col("c_mktsegment"), F.lit("-"), F.pmod("c_custkey", F.lit(700)).cast("string")).alias("video_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("group_id"),
        F.lit("v.mp4").alias("video"),
        F.when(F.col("c_nationkey") <= 20, F.lit("a.txt")).alias("annotation"),
    )


@query
def manifest_findings(spark, folder):
    found = audit.manifest_findings(_customer_manifest(spark, folder))
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def manifest_summary(spark, folder):
    return audit.manifest_summary(A.manifest(spark, folder), A.videos(spark, folder), A.annotations(spark, folder))


@query
def annotation_findings(spark, folder):
    rows = A.clips(spark, folder).select(
        "video_id", "start_s", F.when(F.col("mandatory"), F.col("start_s")).otherwise(F.col("end_s")).alias("end_s"),
        F.pmod("annotation_order", F.lit(5)).cast("int").alias("score"),
    )
    return audit.annotation_findings(rows, width=5.0).groupBy("video_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def annotation_bounds(spark, folder):
    videos = A.tracks(spark, folder).select(F.col("track_id").alias("video_id"), F.lit(25.4).alias("duration"))
    return audit.annotation_bounds(A.clips(spark, folder), videos).select("video_id", "code", "message")


@query
def request_audit(spark, folder):
    videos = A.tracks(spark, folder).select(F.col("track_id").alias("video_id"), F.lit(25.4).alias("duration"))
    issues, summary = audit.audit_requests(A.clips(spark, folder), videos)
    return rounded(summary)


@query
def request_findings(spark, folder):
    videos = A.tracks(spark, folder).select(F.col("track_id").alias("video_id"), F.lit(25.4).alias("duration"))
    issues, _ = audit.audit_requests(A.clips(spark, folder), videos)
    return issues.groupBy("video_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def split_check(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    of = lambda *types: e.where(F.col("event_type").isin(*types)).select(F.floor(F.col("event_id") / 7).cast("string").alias("group_id"))
    known = e.where(F.col("value") > 3).select(F.floor(F.col("event_id") / 7).cast("string").alias("group_id"))
    return audit.split_check(known, of("click"), of("error", "view"))


@query
def id_mismatch(spark, folder):
    return audit.id_mismatch(A.samples(spark, folder), A.rates(spark, folder))


@query
def declared_video(spark, folder):
    m = A.manifest(spark, folder)
    declared = m.select("annotation", F.when(F.col("group_id") == "g1", F.lit("other.mp4")).otherwise(F.col("video")).alias("declared_video"))
    return audit.declared_video_findings(m, declared)


# -- stored sequences -------------------------------------------------------


@query
def content_digests(spark, folder):
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", content_digest(F.col("html")).alias("digest"))


@query
def contract_keys(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    key = store.contract_key({"rate": F.lit(2), "kind": F.col("event_type"), "source": F.col("user_id")})
    return e.select("event_id", key.alias("contract_key"))


@query
def sequence_digests(spark, folder):
    return store.sequence_digest(A.samples(spark, folder))


def _entries(spark, folder):
    c = A.clips(spark, folder)
    return c.select(
        F.col("annotation_order").alias("entry_id"),
        F.when(F.col("mandatory"), "k1").otherwise("k0").alias("contract_key"),
        F.col("video_id").alias("source"),
        (F.col("start_s") - 1).alias("start_s"),
        (F.col("end_s") + 1).alias("end_s"),
    )


def _wants(spark, folder):
    c = A.clips(spark, folder)
    return c.select(
        F.col("annotation_order").alias("request_id"),
        F.lit("k0").alias("contract_key"),
        F.col("video_id").alias("source"),
        "start_s",
        "end_s",
    )


@query
def covering_entries(spark, folder):
    return store.find_covering(_wants(spark, folder), _entries(spark, folder), bucket=4.0)


@query
def compatibility(spark, folder):
    have = _entries(spark, folder).withColumn("rate", F.lit(2.0))
    want = _wants(spark, folder).withColumns({"rate": F.lit(2.0), "entry_id": F.col("request_id"), "end_s": F.col("start_s") + 3})
    out = store.compatibility(want, have, ["contract_key", "rate"])
    return out.select("request_id", "compatible", F.array_join("reasons", ",").alias("reasons"))


@query
def lattice_requests(spark, folder):
    want = _wants(spark, folder).withColumns({"entry_id": F.col("request_id"), "start_s": F.col("start_s") + F.pmod("request_id", F.lit(4)) * 0.25})
    return store.on_lattice(want, _entries(spark, folder), rate=2.0).select("request_id")


def _catalogs(spark, folder):
    c = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".parquet")).alias("path"),
        (F.col("c_acctbal") > -500).alias("valid"),
        F.col("c_nationkey").alias("size_bytes"),
    )
    o = spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_custkey").agg(F.max("o_totalprice").alias("p")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".parquet")).alias("path"), F.col("p"), "o_custkey"
    )
    return c, o


@query
def retention_plan(spark, folder):
    catalog, keep = _catalogs(spark, folder)
    sound = keep.join(catalog.where("valid"), "path", "left_semi").select("path")
    plan, _ = store.retention_plan(catalog, sound)
    return plan.select("path")


@query
def retention_findings(spark, folder):
    catalog, keep = _catalogs(spark, folder)
    _, issues = store.retention_plan(catalog.where(F.col("size_bytes") < 20), keep.select("path"))
    return issues


@query
def reconciled_catalog(spark, folder):
    catalog, found = _catalogs(spark, folder)
    listing = found.select("path", F.lit(True).alias("valid"), F.pmod("o_custkey", F.lit(25)).cast("int").alias("size_bytes"))
    old = catalog.withColumn("size_bytes", F.col("size_bytes").cast("int"))
    return store.reconcile_catalog(old, listing).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query
def reusable_analyses(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    row = lambda df, version: df.groupBy(F.col("user_id")).agg(F.max("value").alias("v")).select(
        F.lit(version).alias("cache_version"),
        F.col("user_id").cast("string").alias("source_path"),
        F.floor("v").cast("string").alias("source_hash"),
        F.lit(0.15).alias("bass_sensitivity"),
        F.lit(0.3).alias("bass_min_gap_s"),
    )
    stored, wanted = row(e.where(F.col("event_type") != "view"), 2), row(e, 2)
    hit, miss = store.reusable_analyses(wanted, stored)
    tag = lambda df, s: df.select("source_path", "source_hash", F.lit(s).alias("state"))
    return tag(hit, "reused").unionByName(tag(miss, "missing"))


@query
def metadata_fields(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    return metadata.json_fields(e.select("event_id", "props"), "props", "k int").select("event_id", "k")


# -- lists, logs and text ---------------------------------------------------


@query
def clock_text(spark, folder):
    seconds = F.col("rate") * 37
    text = clock_of(seconds)
    return A.rates(spark, folder).select("event_id", text.alias("clock"), seconds_of(text).alias("seconds"))


@query
def rate_text(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    text = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.pmod("event_id", F.lit(7)).cast("string"))
    return e.select("event_id", r(rate_of(text)).alias("rate"))


@query
def path_kinds(spark, folder):
    p = spark.read.parquet(f"{folder}/pages.parquet")
    path = F.concat(F.col("url"), F.when(F.pmod("page_id", F.lit(3)) == 0, ".MP4").when(F.pmod("page_id", F.lit(3)) == 1, ".wav *").otherwise(""))
    return p.select("page_id", path_kind(path).alias("kind"))


@query
def power_colours(spark, folder):
    c = power_colour(F.col("rate") * 2.5)
    return A.rates(spark, folder).select("event_id", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


def _list_lines(spark, folder):
    rows = A.annotations(spark, folder).join(A.manifest(spark, folder), "video_id")
    video = F.concat(F.lit("Ride Day "), F.col("group_id"), F.lit("/"), F.col("video_id").cast("string"), F.lit(".mp4"))
    # lists are files in real use: written once, then parsed
    return freeze(lists.write_training_lines(rows.withColumns({"file": F.col("annotation"), "video": video})))


@query
def annotation_lists(spark, folder):
    parsed, _, _ = lists.parse_training_annotations(_list_lines(spark, folder))
    return parsed.select("file", "start_s", "end_s", "score")


@query
def annotation_list_findings(spark, folder):
    broken = _list_lines(spark, folder).withColumn(
        "line", F.when(F.col("line").endswith(" 2"), F.lit("00:10 00:05 2")).when(F.col("line").endswith(" 1"), F.lit("00:10 xx")).otherwise(F.col("line"))
    )
    _, _, issues = lists.parse_training_annotations(broken)
    return issues.groupBy("file", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def scanned_lists(spark, folder):
    return manifests.scan_lists(_list_lines(spark, folder))


def _request_lines(spark, folder):
    c = A.clips(spark, folder)
    file = F.concat(F.lit("edits/e"), F.col("edit_id").cast("string"), F.lit(".txt"))
    video = F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit(".mp4"))
    at = lambda x: F.format_string("%.3f", x)
    star = F.when(F.col("mandatory"), " *").otherwise("")
    line_no = F.col("annotation_order") * 2
    head = c.select(file.alias("file"), line_no.cast("long").alias("line_no"), video.alias("line"))
    body = c.select(
        file.alias("file"), (line_no + 1).cast("long").alias("line_no"),
        F.concat(at(F.col("start_s")), F.lit(" "), at(F.col("end_s")), star).alias("line"),
    )
    return freeze(head.unionByName(body))


@query
def request_lists(spark, folder):
    clips, _, _ = lists.parse_requests(_request_lines(spark, folder), min_clip=2.0)
    return rounded(clips)


@query
def served_requests(spark, folder):
    """Every optional request, the samples of its own grid, and whether they fill a window."""
    asked = A.clips(spark, folder).where(~F.col("mandatory"))
    own = edits.samples_of_requests(asked, A.samples(spark, folder))
    counts = own.groupBy(*edits.REQUEST).agg(F.count(F.lit(1)).alias("n_samples"))
    n = F.coalesce("n_samples", F.lit(0))
    return asked.join(counts, list(edits.REQUEST), "left").select(
        *edits.REQUEST, n.cast("long").alias("n_samples"), (n >= WINDOW / DT).alias("served")
    )


def _log_blocks(spark, folder):
    rows = A.rates(spark, folder).select(
        F.concat(F.lit("u"), F.col("video_id").cast("string")).alias("file"),
        F.col("event_id").alias("frame"),
        F.round("t", 3).alias("t"),
        (F.round("t", 3) + 0.5).alias("end_s"),
        F.pmod("event_id", F.lit(800)).alias("iso"),
        F.col("rate").alias("lat"),
        F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("rate") / 2).alias("lon"),
    )
    rows = rows.withColumn("lon", F.coalesce(F.col("lon").cast("string"), F.lit("n/a")))
    return freeze(rows.select("file", flightlog.block_text().alias("block")))  # a log is a file: written, then parsed


@query
def flight_log(spark, folder):
    log = flightlog.parse_blocks(_log_blocks(spark, folder))
    return rounded(log.select("file", "frame", "t", "end_s", "iso", "lat", "lon"))


# -- live forms -------------------------------------------------------------


def _event_stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "video_id")


@query
def live_windows(spark, folder):
    aggs = {"n": ("count", F.lit(1)), "total": ("sum", F.col("value"))}
    out = finite.complete_windows(_event_stream(spark, folder), aggs, window="4 hours", stride="2 hours", lateness="1 hour", keys=["event_type"])
    return out.select("event_type", F.unix_micros("start_ts").alias("start_us"), "n", r(F.col("total") / F.col("n")).alias("mean_value"))


@query
def live_islands(spark, folder):
    out = finite.complete_islands(_event_stream(spark, folder), "12 hours", lateness="1 hour")
    return out.select("video_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "events")


@query
def live_distinct(spark, folder):
    rows = _event_stream(spark, folder).select("video_id", "event_type", "ts")
    out = live.live_distinct(rows, ["video_id", "event_type"], within="1 day", lateness="1 hour")
    return finite.run_available(out)[0].select("video_id", "event_type", F.unix_micros("span_ts").alias("span_us"))


@query
def live_deltas(spark, folder):
    stream = _event_stream(spark, folder)
    t = (F.unix_micros("ts") - A.EPOCH_US) / A.US_PER_SECOND
    out = live.live_delta(stream.withColumn("t", t), "value")
    return rounded(finite.run_available(out)[0])


# -- files and findings -------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def score_report_files(spark, folder):
    """The report as its CSV files hold it."""
    rows, summary = ranking.score_report(scored_windows(spark, folder), A.manifest(spark, folder))
    path = _folder(spark, "score-report")
    sinks.write_score_report(rows, summary, path)
    return rounded(spark.read.schema(rows.schema).option("header", "true").csv(f"{path}/windows"))


@query
def correlation_files(spark, folder):
    """Both matrices as their CSV files hold them."""
    path = _folder(spark, "correlations")
    table = stats.correlation_table(signal_table(spark, folder), SIGNAL_COLUMNS, ids=["video_id", "sample_idx"])
    sinks.write_correlations(freeze(table), SIGNAL_COLUMNS, path)
    kind = "signal string, " + ", ".join(f"{n} double" for n in SIGNAL_COLUMNS)
    read = lambda m: spark.read.schema(kind).option("header", "true").csv(f"{path}/{m}").withColumn("measure", F.lit(m))
    return rounded(read("pearson").unionByName(read("spearman")))


@query
def telemetry_export(spark, folder):
    """Motion, positions and absolute times as the telemetry file holds them."""
    rows = A.attitude(spark, folder)
    track = telemetry.gps_track(rows.select("video_id", "sample_idx", "t", "lat", "lon"))
    starts = A.videos(spark, folder).select("video_id", F.timestamp_seconds(F.lit(1704067200) + F.col("video_id")).alias("start_time"))
    path = _folder(spark, "telemetry")
    sinks.write_csv(sinks.telemetry_table(telemetry.vehicle_motion(rows), track, starts), path)
    back = spark.read.option("header", "true").csv(path)
    number = lambda c, n, digits: r(F.col(f"`{c}`").cast("double"), digits).alias(n)
    return back.select(
        F.col("video_id").cast("long").alias("video_id"), number("Elapsed time (s)", "t", 3), number("Lateral acceleration (g)", "lateral", 5),
        number("Combined acceleration (g)", "combined", 5), number("GPS distance (m)", "distance_m", 3), F.unix_micros(F.col("Timestamp").cast("timestamp")).alias("us"),
    )


@query
def group_manifest(spark, folder):
    return manifests.records_of_group(A.manifest(spark, folder), "g1")


@query
def split_counts(spark, folder):
    split = learning.split_by_groups(training(spark, folder), ["g2"])
    side = lambda df, name: learning.class_counts(df, by=()).withColumn("side", F.lit(name))
    return side(split.train, "training").unionByName(side(split.validation, "validation"))


@query
def log_order(spark, folder):
    log = flightlog.parse_blocks(_log_blocks(spark, folder))
    return rounded(flightlog.order_findings(log.withColumn("file", F.lit("all"))))


@query
def paired_fixes(spark, folder):
    rows = A.attitude(spark, folder).withColumn("lon", F.when(F.pmod("sample_idx", F.lit(3)) > 0, F.col("lon")))
    return telemetry.paired_fixes(rows).select("video_id", "sample_idx")


@query
def off_lattice(spark, folder):
    return edits.off_lattice(A.clips(spark, folder), A.samples(spark, folder)).select("edit_id", "annotation_order")


@query
def unserved_requests(spark, folder):
    clips = A.clips(spark, folder)
    own = edits.samples_of_requests(clips, A.samples(spark, folder))
    rows = signals.engineered_signals(own, ids=[*edits.REQUEST, "sample_idx", "t"])
    made = windows.window_statistics(rows, window=WINDOW, stride=STRIDE, dt=DT, keys=edits.REQUEST)
    return edits.unserved(clips, made).select("edit_id", "annotation_order")


@query
def unprobed_segments(spark, folder):
    return selection.unprobed(A.clips(spark, folder), A.videos(spark, folder)).select("annotation_order")


@query
def windows_without_telemetry(spark, folder):
    rows = learning.feature_windows(A.samples(spark, folder), A.rates(spark, folder))
    return learning.without_telemetry(rows).select("video_id", "window_index")


@query
def manifest_audit(spark, folder):
    """Findings of the whole audit by code, each with the status of all. One video is not probed, one annotation of each is moved."""
    videos = A.videos(spark, folder).where("video_id <> 3")
    marks = A.annotations(spark, folder).withColumn("end_s", F.when(F.col("start_s") == 5, F.col("end_s") + 1).otherwise(F.col("end_s")))
    issues, _ = audit.audit_manifest(A.manifest(spark, folder), videos, marks, train=["g0"], validation=["g1", "g9"])
    issues = freeze(issues)
    counts = issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(audit.status(issues)))  # one row


@query
def shifted_requests(spark, folder):
    """Requests over recordings whose grid shifts by half a step in the middle, with the samples that this leaves out."""
    t = F.when(F.col("t") > 12, F.col("t") + 0.25).otherwise(F.col("t"))
    return edits.left_out_samples(_edit_requests(spark, folder), A.samples(spark, folder).withColumn("t", t))
