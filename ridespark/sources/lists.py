"""Hand-written annotation and request lists.

A list is a short file written by a person; one file is one row when read. Parsing works
on lines: file, line_no (from 1), line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import has_star, is_audio, is_video, resolve_against, without_star
from ..functions.times import clock_of, seconds_of
from ..plans.ordered import CHUNK, HALO, halo_one_row

ANNOTATION_FIELDS = ("start", "end", "mtb")  # fixed value: words of the header line


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of every text file under `path`, with its file and number."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    text = F.regexp_replace(F.col("value"), "^﻿", "")
    return files.select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("_i", "line")
    ).select("file", (F.col("_i") + 1).cast("int").alias("line_no"), F.trim("line").alias("line"))


def content_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))


def _issue(df: DataFrame, when: Column, code: str) -> DataFrame:
    return df.where(when).select("file", "line_no", F.lit("error").alias("severity"), F.lit(code).alias("code"), "line")


def parse_training_annotations(lines: DataFrame, *, width: float = 3600.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotations, the declared video per file, and findings.

    The first content line is the video; a header line is skipped; then ``start end
    grade [remarks]``. Intervals must end after they start, be graded 0..3 and follow
    each other without gap or overlap.
    """
    rows = content_lines(lines)
    low = F.lower("line")
    rows = rows.where(~(low.contains("start") & low.contains("end") & low.contains("mtb")))
    heads = rows.groupBy("file").agg(F.min("line_no").alias("_head"), F.min_by("line", "line_no").alias("_video"))
    videos = heads.select("file", resolve_against(F.col("_video"), F.col("file")).alias("video"))
    body = rows.join(heads.select("file", "_head"), "file").where(F.col("line_no") > F.col("_head"))
    part = F.split(F.trim("line"), r"\s+", 4)
    parsed = body.select(
        "file",
        "line_no",
        "line",
        F.size(part).alias("_n"),
        seconds_of(F.get(part, F.lit(0))).alias("start_s"),
        seconds_of(F.get(part, F.lit(1))).alias("end_s"),
        F.when(F.get(part, F.lit(2)).rlike(r"^[+-]?\d+$"), F.get(part, F.lit(2)).try_cast("int")).alias("score"),
        F.coalesce(F.trim(F.get(part, F.lit(3))), F.lit("")).alias("remarks"),
    )
    short = F.col("_n") < 3
    unread = ~short & (F.col("start_s").isNull() | F.col("end_s").isNull() | F.col("score").isNull())
    backwards = F.col("end_s") <= F.col("start_s")
    range_ = (F.col("score") < 0) | (F.col("score") > 3)
    good = parsed.where(~short & ~unread & ~F.coalesce(backwards, F.lit(False)) & ~F.coalesce(range_, F.lit(False)))
    near = halo_one_row(good.select("file", "line_no", "line", "start_s", "end_s"), ["file"], "start_s", width)
    w = W.partitionBy("file", CHUNK).orderBy("start_s")
    gaps = near.withColumn("_prev", F.lag("end_s").over(w)).where(~F.col(HALO))
    issues = (
        _issue(parsed, short, "too_few_fields")
        .unionByName(_issue(parsed, unread, "unreadable_value"))
        .unionByName(_issue(parsed, ~short & backwards, "end_before_start"))
        .unionByName(_issue(parsed, ~short & range_, "score_range"))
        .unionByName(_issue(gaps, F.col("_prev") != F.col("start_s"), "not_contiguous"))
    )
    return good.select("file", "line_no", "start_s", "end_s", "score", "remarks"), videos, issues


def write_training_lines(annotations: DataFrame, *, file: str = "file", video: str = "video") -> DataFrame:
    """The same lists as lines again: the video, then one line per interval in order.

    Order inside a file is carried by `line_no` (the start in milliseconds, after the head).
    """
    head = annotations.groupBy(file).agg(F.min(video).alias("line")).select(
        F.col(file).alias("file"), F.lit(0).cast("long").alias("line_no"), "line"
    )
    body = annotations.select(
        F.col(file).alias("file"),
        (F.round(F.col("start_s") * 1000) + 1).cast("long").alias("line_no"),
        F.concat_ws(" ", clock_of(F.col("start_s")), clock_of(F.col("end_s")), F.col("score").cast("string")).alias("line"),
    )
    return head.unionByName(body)


def parse_requests(
    lines: DataFrame, videos: DataFrame | None = None, *, min_clip: float = 3.0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clips, the music per file, and findings.

    Lines are a video, ``start end``, ``video start end`` (both with an optional ``*`` for
    mandatory), or an audio path (with ``*``: keep the original sound too). A bare
    interval belongs to the video named last. Optional clips under `min_clip` seconds are
    dropped; a video without any interval stands for its whole length, taken from
    `videos` (video, duration). The last audio line counts.
    """
    if not 0 < min_clip < float("inf"):
        raise ValueError("min_clip must be positive and finite")
    rows = content_lines(lines).withColumn("line", F.trim("line"))
    part = F.split("line", r"\s+", 5)
    first = F.get(part, F.lit(0))
    numeric = first.contains(":") | first.try_cast("double").isNotNull()
    kind = (
        F.when(is_audio(F.col("line")), "audio")
        .when(is_video(F.col("line")), "video")
        .when(numeric, "interval")
        .otherwise("full")
    )
    rows = rows.withColumns({"_p": part, "_kind": kind, "_size": F.size(part)})
    named = F.when(F.col("_kind") == "video", F.col("line")).when(F.col("_kind") == "full", F.get("_p", F.lit(0)))
    rows = rows.withColumn("_named", resolve_against(named, F.col("file")))
    # a request list is one short file, so one file is one window partition
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("video", F.last("_named", ignorenulls=True).over(w))

    at = F.when(F.col("_kind") == "full", 1).otherwise(0)
    marker = F.get(F.col("_p"), at + 2)
    spans = rows.where(F.col("_kind").isin("interval", "full")).select(
        "file",
        "line_no",
        "line",
        "video",
        seconds_of(F.get(F.col("_p"), at)).alias("start_s"),
        seconds_of(F.get(F.col("_p"), at + 1)).alias("end_s"),
        (F.col("_size") == at + 3).alias("mandatory"),
        (~(F.col("_size") - at).isin(2, 3)).alias("_bad_size"),
        ((F.col("_size") == at + 3) & (marker != "*")).alias("_bad_mark"),
    )
    bad_row = F.col("_bad_size") | F.col("_bad_mark")
    unread = ~bad_row & (F.col("start_s").isNull() | F.col("end_s").isNull())
    backwards = ~bad_row & (F.col("end_s") <= F.col("start_s"))
    issues = (
        _issue(spans, F.col("video").isNull(), "interval_before_video")
        .unionByName(_issue(spans, F.col("_bad_size"), "bad_row"))
        .unionByName(_issue(spans, ~F.col("_bad_size") & F.col("_bad_mark"), "bad_directive"))
        .unionByName(_issue(spans, unread, "unreadable_time"))
        .unionByName(_issue(spans, F.coalesce(backwards, F.lit(False)), "end_before_start"))
    )
    sound = spans.where(
        F.col("video").isNotNull() & ~bad_row & F.col("start_s").isNotNull() & (F.col("end_s") > F.col("start_s"))
    )
    kept = sound.where(F.col("mandatory") | (F.col("end_s") - F.col("start_s") >= min_clip)).select(
        "file", "video", "start_s", "end_s", "mandatory", F.col("line_no").alias("annotation_order")
    )
    if videos is not None:
        declared = rows.where(F.col("_named").isNotNull()).groupBy("file", F.col("_named").alias("video")).agg(
            F.min("line_no").alias("annotation_order")
        )
        whole = (
            declared.join(spans.select("file", "video").distinct(), ["file", "video"], "left_anti")
            .join(videos.select("video", "duration"), "video")
            .select("file", "video", F.lit(0.0).alias("start_s"), F.col("duration").alias("end_s"), F.lit(False).alias("mandatory"), "annotation_order")
        )
        kept = kept.unionByName(whole)
    music = rows.where(F.col("_kind") == "audio").groupBy("file").agg(
        resolve_against(without_star(F.max_by("line", "line_no")), F.first("file")).alias("audio"),
        has_star(F.max_by("line", "line_no")).alias("mix"),
    )
    return kept, music, issues
