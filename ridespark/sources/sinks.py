"""Writing reports, results and telemetry tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.edits import EditPlan
from ..operators.ranking import REPORT_COLUMNS
from ..operators.selection import EDIT, candidate_order
from ..operators.stats import correlation_matrix


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Sequence[Column] = (), *, mode: str = "error") -> None:
    """CSV with a header and a fixed column order; parts follow the sort order."""
    out = df.select(*columns) if columns else df
    if order:
        out = out.orderBy(*order)
    out.write.mode(mode).option("header", "true").option("encoding", "UTF-8").csv(path)


def write_score_report(rows: DataFrame, summary: DataFrame, path: str, *, mode: str = "error") -> None:
    """Three tables: all windows by global rank, the same by video, and the videos by best score."""
    write_csv(rows, f"{path}/windows", REPORT_COLUMNS, [F.col("rank_global")], mode=mode)
    write_csv(
        rows, f"{path}/by_video", REPORT_COLUMNS, [F.col("video_id"), F.col("rank_in_video"), F.col("window_index")], mode=mode
    )
    write_csv(summary, f"{path}/videos", None, [F.desc("score_max"), F.col("video_id")], mode=mode)


def write_correlations(table: DataFrame, names: Sequence[str], path: str, *, mode: str = "error") -> None:
    for value in ("pearson", "spearman"):
        write_csv(correlation_matrix(table, value, names), f"{path}/{value}", ["signal", *names], [F.col("signal")], mode=mode)


def edit_results(plan: EditPlan, settings: Mapping[str, str] | None = None) -> DataFrame:
    """One JSON document per edit: its settings, ranked candidates and timeline.

    Lists inside a document are those of one edit.
    """
    ranked = plan.candidates.select(
        EDIT,
        F.struct(
            *[(-F.col(c)).alias(f"r_{c}") for c in ("max_score",)],
            (-F.size("evidence")).alias("r_count"),
            (-F.col("mean_score")).alias("r_mean"),
            (-F.col("duration")).alias("r_duration"),
            F.col("video_order").alias("r_video"),
            F.col("start_s").alias("r_start"),
            F.struct(
                F.col("video_id").alias("video"),
                "annotation_order",
                F.round("start_s", 3).alias("start_seconds"),
                F.round("end_s", 3).alias("end_seconds"),
                F.round("duration", 3).alias("duration_seconds"),
                "max_score",
                F.size("evidence").alias("window_count"),
                "mean_score",
            ).alias("row"),
        ).alias("c"),
    )
    candidates = ranked.groupBy(EDIT).agg(
        F.transform(F.array_sort(F.collect_list("c")), lambda c: c["row"]).alias("candidates")
    )
    clip = F.struct(
        "position",
        F.col("video_id").alias("video"),
        "source_start",
        "source_end",
        "output_start",
        "output_end",
        "mandatory",
        "score",
        "annotation_order",
    )
    clips = plan.timeline.groupBy(EDIT).agg(
        F.array_sort(F.collect_list(clip)).alias("clips"),
        F.max("output_end").alias("duration"),
        F.count(F.when(F.col("mandatory"), 1)).alias("mandatory_count"),
        F.count(F.when(~F.col("mandatory"), 1)).alias("selected_optional_count"),
    )
    note = F.create_map(*[F.lit(str(x)) for kv in (settings or {}).items() for x in kv]) if settings else F.lit(None).cast("map<string,string>")
    return candidates.join(clips, EDIT, "full_outer").select(
        EDIT,
        F.lit(1).alias("schema_version"),
        note.alias("configuration"),
        F.coalesce(F.size("candidates"), F.lit(0)).alias("candidate_count"),
        "candidates",
        "selected_optional_count",
        "mandatory_count",
        F.struct("duration", "clips").alias("timeline"),
    )


def write_edit_results(plan: EditPlan, path: str, settings: Mapping[str, str] | None = None, *, mode: str = "error") -> None:
    edit_results(plan, settings).write.mode(mode).json(path)


# fixed values: header of the telemetry table -> column it is filled from
TELEMETRY_HEADER = {
    "Frame": "frame",
    "Elapsed time (s)": "t",
    "Timestamp": "timestamp",
    "Accelerometer X raw (g)": "acc_x_g",
    "Accelerometer Y raw (g)": "acc_y_g",
    "Accelerometer Z raw (g)": "acc_z_g",
    "Quaternion W": "qw",
    "Quaternion X": "qx",
    "Quaternion Y": "qy",
    "Quaternion Z": "qz",
    "Roll (deg)": "roll",
    "Pitch (deg)": "pitch",
    "Yaw (deg)": "yaw",
    "Lateral acceleration (g)": "lateral",
    "Longitudinal acceleration (g)": "longitudinal",
    "Vertical acceleration (g)": "vertical",
    "Combined acceleration (g)": "combined",
    "ISO": "iso",
    "Shutter numerator": "shutter_num",
    "Shutter denominator": "shutter_den",
    "Shutter (s)": "shutter_s",
    "Colour temperature (K)": "cct",
    "Latitude": "lat",
    "Longitude": "lon",
    "Altitude (m)": "alt",
    "GPS speed (m/s)": "speed_ms",
    "GPS heading (deg)": "heading_deg",
    "GPS distance (m)": "distance_m",
    "GPS time": "gps_time",
}


def telemetry_table(motion: DataFrame, track: DataFrame, starts: DataFrame) -> DataFrame:
    """Per sample the columns of the telemetry export; what is missing stays empty."""
    gps = track.select("video_id", "t", *[c for c in ("speed_ms", "heading_deg", "distance_m")])
    rows = motion.join(gps, ["video_id", "t"], "left").join(starts.select("video_id", "start_time"), "video_id", "left")
    micros = F.unix_micros("start_time") + F.round(F.col("t") * 1e6).cast("long")
    rows = rows.withColumn("timestamp", F.timestamp_micros(micros))
    if "shutter_num" in rows.columns:
        rows = rows.withColumn("shutter_s", F.when(F.col("shutter_num") != 0, F.try_divide("shutter_num", "shutter_den")))
    have = set(rows.columns)
    cell = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return rows.select("video_id", *[cell(c).alias(name) for name, c in TELEMETRY_HEADER.items()])


def ride_table(ride: DataFrame, zone: str) -> DataFrame:
    """Ride channels with the UTC date and the same in a local time zone."""
    return ride.withColumn("date_local", F.from_utc_timestamp("date", zone))
