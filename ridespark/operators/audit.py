"""Audits of manifests, requests, sample sequences and windows.

Findings are rows (video_id, severity, code, message); severity is "error" or "warning".
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.times import whole_second
from ..plans.intervals import overlap_pairs
from ..plans.ordered import CHUNK, HALO, halo_by_distance, halo_one_row
from ..plans.quantiles import exact_quantiles, join_on
from ..schemas import DELTA_SOURCES, GRADES, GRID, SAMPLE_COLUMNS
from .labels import window_purity
from .signals import is_finite
from .windows import whole_steps, windowed

KEYS = ("video_id",)
BOUND = 1e-6


def findings(df: DataFrame, when: Column, severity: str, code: str, message: Column | str) -> DataFrame:
    text = message if isinstance(message, Column) else F.lit(message)
    return df.where(when).select(
        F.col("video_id").cast("string").alias("video_id"),
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        text.alias("message"),
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def status(issues: DataFrame) -> DataFrame:
    """One row: error, warning or ok, whichever is worst."""
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1))
    return issues.agg(
        F.when(worst == 2, "error").when(worst == 1, "warning").otherwise("ok").alias("status"),
        F.count(F.when(F.col("severity") == "error", 1)).alias("errors"),
        F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"),
    )


# -- manifests --------------------------------------------------------------


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")


def manifest_findings(manifest: DataFrame) -> DataFrame:
    """Missing ids, groups and paths, and ids used twice (case does not count)."""
    ids = F.lower(F.trim(F.col("video_id").cast("string")))
    twice = (
        manifest.where(~_blank("video_id"))
        .groupBy(ids.alias("_id"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.col("video_id").cast("string")).alias("video_id"))
    )
    return union_all(
        [
            findings(manifest, _blank("video_id"), "error", "id_missing", "missing or empty id"),
            findings(manifest, _blank("group_id"), "error", "group_missing", "missing or empty group"),
            findings(manifest, _blank("video"), "error", "video_missing", "missing or empty video path"),
            findings(manifest, F.col("annotation").isNull(), "warning", "not_annotated", "no annotation file"),
            findings(
                twice,
                F.col("_n") > 1,
                "error",
                "id_duplicate",
                F.concat(F.lit("id used "), F.col("_n").cast("string"), F.lit(" times")),
            ),
        ]
    )


def declared_video_findings(manifest: DataFrame, declared: DataFrame) -> DataFrame:
    """Annotation files that declare another video than the manifest. `declared`: annotation, declared_video."""
    both = manifest.join(declared, "annotation")
    return findings(
        both,
        F.col("declared_video") != F.col("video"),
        "warning",
        "video_differs",
        F.concat(F.lit("annotation file declares "), F.col("declared_video")),
    )


def annotation_findings(annotations: DataFrame, *, width: float = 3600.0) -> DataFrame:
    """Intervals that end before they start, grades out of range, and gaps or overlaps between neighbours."""
    near = halo_one_row(annotations.select("video_id", "start_s", "end_s", "score"), ["video_id"], "start_s", width)
    w = W.partitionBy("video_id", CHUNK).orderBy("start_s")
    near = near.withColumn("_prev", F.lag("end_s").over(w)).where(~F.col(HALO))
    at = lambda c: F.format_string("%.3f", F.col(c))
    return union_all(
        [
            findings(annotations, F.col("end_s") <= F.col("start_s"), "error", "end_before_start", F.concat(F.lit("interval at "), at("start_s"))),
            findings(annotations, ~F.col("score").isin(*GRADES), "error", "score_range", F.concat(F.lit("grade of the interval at "), at("start_s"))),
            findings(
                near,
                F.col("_prev").isNotNull() & (F.col("_prev") != F.col("start_s")),
                "error",
                "not_contiguous",
                F.concat(F.lit("interval at "), at("start_s"), F.lit(" follows one ending at "), at("_prev")),
            ),
        ]
    )


def annotation_bounds(annotations: DataFrame, videos: DataFrame) -> DataFrame:
    """Annotations outside [0, whole-second duration] of their video."""
    both = annotations.join(videos.select("video_id", "duration"), "video_id")
    limit = whole_second(F.col("duration"))
    outside = (F.col("start_s") < -BOUND) | (F.col("end_s") > limit + BOUND)
    counted = both.groupBy("video_id").agg(F.count(F.when(outside, 1)).alias("_out"))
    return findings(
        counted, F.col("_out") > 0, "error", "annotation_out_of_bounds",
        F.concat(F.col("_out").cast("string"), F.lit(" interval(s) outside the video")),
    )


def split_findings(manifest: DataFrame, train: Sequence[str], validation: Sequence[str]) -> DataFrame:
    """Groups in both splits, groups the manifest does not have, and groups in neither.

    The two lists are configuration; the manifest's groups may be many.
    """
    spark = manifest.sparkSession
    side = lambda names: spark.createDataFrame([(g.strip(),) for g in names], "group_id string").distinct()
    return split_check(manifest.select("group_id"), side(train), side(validation))


def split_check(groups: DataFrame, train: DataFrame, validation: DataFrame) -> DataFrame:
    """The same from tables of group ids: code and group_id of every mismatch."""
    known = groups.select(F.col("group_id").cast("string").alias("group_id")).distinct()
    train, validation = (d.select("group_id").distinct() for d in (train, validation))
    used = train.unionByName(validation).distinct()
    row = lambda df, severity, code: df.select("group_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    return union_all(
        [
            row(train.intersect(validation), "error", "split_overlap"),
            row(used.join(known, "group_id", "left_anti"), "error", "split_unknown_group"),
            row(known.join(used, "group_id", "left_anti"), "warning", "split_unassigned_group"),
        ]
    )


def id_mismatch(left: DataFrame, right: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ids found on one side only."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        *keys, F.when(F.col("_l").isNull(), "missing_left").otherwise("missing_right").alias("code")
    )


def manifest_summary(
    manifest: DataFrame,
    videos: DataFrame,
    annotations: DataFrame,
    *,
    window: float = 4.0,
    stride: float = 2.0,
) -> DataFrame:
    """One row: entries, ids, groups, durations, seconds per grade and window estimates."""
    purity = window_purity(videos, annotations, window=window, stride=stride)
    entries = manifest.agg(
        F.count(F.lit(1)).alias("manifest_entries"),
        F.count_distinct(F.lower(F.trim(F.col("video_id").cast("string")))).alias("unique_ids"),
        F.count_distinct("group_id").alias("group_count"),
    )
    length = F.col("end_s") - F.col("start_s")
    seconds = annotations.agg(
        F.count(F.lit(1)).alias("annotation_intervals"),
        *[
            F.round(F.coalesce(F.sum(F.when(F.col("score") == g, length)), F.lit(0.0)), 3).alias(f"seconds_grade_{g}")
            for g in GRADES
        ],
    )
    totals = videos.agg(F.round(F.sum("duration"), 3).alias("total_duration"))
    windows = purity.agg(
        F.sum("total_windows").alias("estimated_windows"),
        F.sum("pure_windows").alias("estimated_pure_windows"),
        F.sum("conflicting_windows").alias("estimated_conflicting_windows"),
    )
    parts = [entries, totals, seconds, windows]  # one row each, side by side
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for p in parts for c in p.columns])


def audit_manifest(
    manifest: DataFrame,
    videos: DataFrame,
    annotations: DataFrame,
    *,
    train: Sequence[str] = (),
    validation: Sequence[str] = (),
    window: float = 4.0,
    stride: float = 2.0,
) -> tuple[DataFrame, DataFrame]:
    """All findings about a manifest with its annotations, and the summary row."""
    parts = [
        manifest_findings(manifest),
        findings(manifest.join(videos, "video_id", "left_anti"), F.lit(True), "error", "video_unreadable", "video not found or not probed"),
        annotation_findings(annotations),
        annotation_bounds(annotations, videos),
    ]
    if train and validation:
        split = split_findings(manifest, train, validation)
        parts.append(split.select(F.lit(None).cast("string").alias("video_id"), "severity", "code", F.concat(F.lit("group "), F.col("group_id")).alias("message")))
    else:
        one = manifest.limit(1)
        parts.append(findings(one, F.lit(True), "warning", "split_not_configured", "no training and validation groups given").withColumn("video_id", F.lit(None).cast("string")))
    return union_all(parts), manifest_summary(manifest, videos, annotations, window=window, stride=stride)


def audit_requests(clips: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips beyond the whole-second duration of their video, and a summary per edit."""
    both = clips.join(videos.select("video_id", F.col("duration").alias("_length")), "video_id", "left")
    beyond = F.col("end_s") > whole_second(F.col("_length")) + BOUND
    issues = union_all(
        [
            findings(both, F.col("_length").isNull(), "error", "video_unreadable", "video not found or not probed"),
            findings(
                both, beyond, "error", "clip_out_of_bounds",
                F.format_string("clip %.3f-%.3f ends after the video", "start_s", "end_s"),
            ),
        ]
    )
    summary = clips.groupBy("edit_id").agg(
        F.count(F.lit(1)).alias("clips"),
        F.count_distinct("video_id").alias("videos"),
        F.count(F.when(F.col("mandatory"), 1)).alias("mandatory_clips"),
        F.sum(F.col("end_s") - F.col("start_s")).alias("requested_s"),
    )
    return issues, summary


# -- sequences --------------------------------------------------------------


def _row_rules() -> dict[str, Column]:
    c = lambda n: F.col(n).cast("double")
    rules = {
        "flow_mean_negative": c("flow_mean") < 0,
        "flow_p90_negative": c("flow_p90") < 0,
        "flow_p90_below_mean": c("flow_p90") < c("flow_mean"),
        "flow_net_negative": c("flow_net") < 0,
        "flow_net_above_mean": c("flow_net") > c("flow_mean"),
        "div_abs_p90_negative": c("div_abs_p90") < 0,
        "div_std_negative": c("div_std") < 0,
        "curl_abs_p90_negative": c("curl_abs_p90") < 0,
        "curl_std_negative": c("curl_std") < 0,
        "div_pos_fraction_range": (c("div_pos_fraction") < 0) | (c("div_pos_fraction") > 1),
    }
    for r in range(GRID):
        for k in range(GRID):
            g = f"grid_{r}_{k}"
            rules[f"{g}_magnitude_negative"] = c(f"{g}_magnitude") < 0
            rules[f"{g}_net_negative"] = c(f"{g}_net") < 0
            rules[f"{g}_net_above_magnitude"] = c(f"{g}_net") > c(f"{g}_magnitude")
    return rules


def audit_sequences(
    samples: DataFrame, *, rate: float = 2.0, keys: Sequence[str] = KEYS, chunk: int = 4096
) -> DataFrame:
    """One row per key and rule: how many samples (or columns) break it.

    Rules: times increase at the nominal, even step; values are finite; no column is
    constant; lengths and fractions are in range; differences match their columns.
    """
    keys = list(keys)
    x = {n: F.col(n).cast("double") for n in SAMPLE_COLUMNS}
    cut = halo_by_distance(samples, "sample_idx", chunk, before=1)
    w = W.partitionBy(*keys, CHUNK).orderBy("sample_idx")
    prev = cut.withColumns(
        {"_step": F.col("t") - F.lag("t").over(w)} | {f"_d_{s}": x[s] - F.lag(x[s]).over(w) for s in DELTA_SOURCES.values()}
    ).where(~F.col(HALO))

    rules = {"step_not_positive": F.col("_step") <= 0}
    rules["not_finite"] = reduce(lambda a, b: a | b, [~is_finite(c) for c in x.values()]) | ~is_finite(F.col("t"))
    rules |= _row_rules()
    for delta, source in DELTA_SOURCES.items():
        want = F.coalesce(F.col(f"_d_{source}"), F.lit(0.0))
        rules[f"{delta}_mismatch"] = F.abs(x[delta] - want) > 1e-6 + 1e-5 * F.abs(want)
    per_key = prev.groupBy(*keys).agg(
        *[F.count(F.when(c, 1)).alias(n) for n, c in rules.items()],
        F.min("_step").alias("_lo"),
        F.max("_step").alias("_hi"),
        F.count(F.lit(1)).alias("_n"),
        sum((F.when(F.stddev_pop(c) < 1e-8, 1).otherwise(0) for c in x.values()), F.lit(0)).cast("long").alias("constant_columns"),
    )
    median = exact_quantiles(prev.where(F.col("_step").isNotNull()), keys, {"_m": F.col("_step")}, [0.5])
    step = 1 / rate
    m = F.col("_m")[0]
    far = lambda a, b, tol: F.abs(a - b) > tol + 1e-3 * F.abs(b)
    per_key = join_on(per_key, median, keys, "left").withColumns(
        {
            "too_few_samples": (F.col("_n") < 2).cast("long"),
            "step_off_nominal": F.coalesce(far(m, F.lit(step), 1e-4), F.lit(False)).cast("long"),
            "step_uneven": F.coalesce(far(F.col("_lo"), m, 1e-3) | far(F.col("_hi"), m, 1e-3), F.lit(False)).cast("long"),
        }
    )
    names = [*rules, "constant_columns", "too_few_samples", "step_off_nominal", "step_uneven"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names]))
    return per_key.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def audit_windows(
    samples: DataFrame,
    annotations: DataFrame,
    *,
    window: float = 4.0,
    stride: float = 2.0,
    dt: float = 0.5,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Windows checked against an independent count, their bounds and the rows they hold.

    Also counts windows lying wholly inside one annotation of the highest grade.
    """
    keys = list(keys)
    n_w, n_s = whole_steps(window, dt, "window"), whole_steps(stride, dt, "stride")
    made = windowed(
        samples,
        {
            "_lo": F.min("sample_idx"),
            "_hi": F.max("sample_idx"),
            "_held": F.count("sample_idx"),
        },
        window=window,
        stride=stride,
        dt=dt,
        keys=keys,
    )
    k = F.col("window_index")
    first = samples.groupBy(*keys).agg(F.min("t").alias("_t0"), F.count(F.lit(1)).alias("_n"))
    want_start = F.col("_t0") - dt + k * n_s * dt
    off = (F.abs(F.col("start_s") - want_start) > BOUND) | (F.abs(F.col("end_s") - want_start - window) > BOUND)
    wrong = (F.col("_lo") != k * n_s) | (F.col("_hi") != k * n_s + n_w - 1) | (F.col("_held") != n_w)
    best = annotations.where(F.col("score") == max(GRADES)).select(
        *keys, F.col("start_s").alias("_as"), F.col("end_s").alias("_ae")
    )
    inside = (
        overlap_pairs(made.select(*keys, "window_index", "start_s", "end_s"), best, keys, ("start_s", "end_s"), ("_as", "_ae"))
        .where((F.col("_as") <= F.col("start_s")) & (F.col("end_s") <= F.col("_ae")))
        .select(*keys, "window_index")
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("pure_top_windows"))
    )
    checked = (
        made.join(first.select(*keys, "_t0"), keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("windows"),
            F.count(F.when(off, 1)).alias("bounds_off"),
            F.count(F.when(wrong, 1)).alias("content_off"),
        )
    )
    expected = F.when(F.col("_n") >= n_w, F.floor((F.col("_n") - n_w) / n_s) + 1).otherwise(0).cast("long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        first.join(checked, keys, "left")
        .join(inside, keys, "left")
        .select(*keys, expected.alias("expected_windows"), *[zero(c) for c in ("windows", "bounds_off", "content_off", "pure_top_windows")])
    )


def sequence_validity(samples: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether a stored sequence can be used: two rows or more, finite, times strictly increasing by index."""
    keys = list(keys)
    cut = halo_by_distance(samples, "sample_idx", 4096, before=1)
    w = W.partitionBy(*keys, CHUNK).orderBy("sample_idx")
    bad_value = reduce(lambda a, b: a | b, [~is_finite(F.col(c).cast("double")) for c in samples.columns if c in SAMPLE_COLUMNS] + [~is_finite(F.col("t"))])
    rows = cut.select(*keys, HALO, "t", bad_value.alias("_bad"), (F.col("t") <= F.lag("t").over(w)).alias("_back")).where(~F.col(HALO))
    per = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.count(F.when(F.col("_bad"), 1)).alias("_nbad"),
        F.count(F.when(F.col("_back"), 1)).alias("_nback"),
    )
    issue = (
        F.when(F.col("rows") < 2, "too_few_rows")
        .when(F.col("_nbad") > 0, "not_finite")
        .when(F.col("_nback") > 0, "times_not_increasing")
    )
    return per.withColumn("issue", issue).withColumn("valid", F.col("issue").isNull()).drop("_nbad", "_nback")
