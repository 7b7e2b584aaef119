"""Dataset manifests: which videos there are, their groups and annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import parent_folder
from ..functions.times import seconds_of
from ..operators.audit import manifest_findings
from ..schemas import GRADES

SCHEMA = "id string, group_id string, video string, annotation string, _broken string"


def read_manifest(spark: SparkSession, path: str, *, format: str = "json", **options) -> DataFrame:
    """Manifest rows: video_id, group_id, video, annotation, and `_broken` for unreadable ones.

    JSON lines (or, with ``multiLine``, a JSON array), CSV with a header, or Parquet.
    """
    reader = spark.read.options(**options)
    if format == "parquet":
        raw = reader.parquet(path).withColumn("_broken", F.lit(None).cast("string"))
    else:
        reader = reader.schema(SCHEMA).option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE")
        raw = reader.option("header", "true").csv(path) if format == "csv" else reader.json(path)
    return clean_manifest(raw)


def clean_manifest(raw: DataFrame) -> DataFrame:
    """Trimmed ids and paths; an absent annotation stays null."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    return raw.select(
        text("id").alias("video_id"),
        text("group_id").alias("group_id"),
        text("video").alias("video"),
        F.nullif(text("annotation"), F.lit("")).alias("annotation"),
        "_broken",
    )


def checked_manifest(manifest: DataFrame) -> DataFrame:
    """The manifest, or an error naming the kinds of mistakes it has."""
    codes = [r[0] for r in manifest_findings(manifest).where("severity = 'error'").select("code").distinct().collect()]
    if codes:
        raise ValueError(f"manifest is not valid: {', '.join(sorted(codes))}")
    return manifest


def resolve_paths(manifest: DataFrame, folder: str) -> DataFrame:
    """Relative video and annotation paths taken from `folder`."""
    absolute = lambda c: F.col(c).rlike(r"^([/\\]|[A-Za-z]:|[a-z]+:/)")
    place = lambda c: F.when(F.col(c).isNull() | absolute(c), F.col(c)).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), F.col(c)))
    return manifest.withColumns({c: place(c) for c in ("video", "annotation")})


def records_of_group(manifest: DataFrame, group_id: str) -> DataFrame:
    return manifest.where(F.col("group_id") == group_id)


def groups_of(manifest: DataFrame) -> DataFrame:
    return manifest.select("group_id").distinct().orderBy("group_id")


# fixed value: an annotated interval in a list
_INTERVAL = r"^\s*(\d{1,2}:\d{2}(?::\d{2})?)\s+(\d{1,2}:\d{2}(?::\d{2})?)\s+([0-3])(?:\s|$)"


def scan_lists(lines: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """A manifest from annotation lists: ids, groups, durations and seconds per grade.

    The id is the file name, the group the folder of the video; both lower-case with
    underscores. `videos` (video, duration) gives probed durations; otherwise the last
    end counts. Lists without a video or an interval are left out.
    """
    line = F.trim("line")
    heads = lines.where((line != "") & ~line.startswith("#") & ~F.lower(line).startswith("start")).groupBy("file").agg(
        F.min_by(line, "line_no").alias("video")
    )
    numbers = lines.groupBy("file").agg(F.min("line_no").alias("_first"))
    spans = (
        lines.where(F.col("line").rlike(_INTERVAL))
        .join(numbers, "file")
        .where(F.col("line_no") > F.col("_first"))
        .select(
            "file",
            seconds_of(F.regexp_extract("line", _INTERVAL, 1)).alias("start_s"),
            seconds_of(F.regexp_extract("line", _INTERVAL, 2)).alias("end_s"),
            F.regexp_extract("line", _INTERVAL, 3).cast("int").alias("score"),
        )
        .where(F.col("end_s") > F.col("start_s"))
    )
    length = F.col("end_s") - F.col("start_s")
    totals = spans.groupBy("file").agg(
        F.max("end_s").alias("_end"),
        F.sum(length).alias("_covered"),
        *[F.coalesce(F.sum(F.when(F.col("score") == g, length)), F.lit(0.0)).alias(f"_g{g}") for g in GRADES],
    )
    rows = heads.join(totals, "file")
    if videos is not None:
        rows = rows.join(videos.select("video", F.col("duration").alias("_probed")), "video", "left")
    else:
        rows = rows.withColumn("_probed", F.lit(None).cast("double"))
    rows = rows.withColumn("_d", F.coalesce(F.when(F.col("_probed") > 0, F.col("_probed")), F.col("_end")))
    slug = lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("_"))
    share = lambda x: F.round(F.coalesce(F.try_divide(100 * x, F.col("_d")), F.lit(0.0)), 2)
    return rows.select(
        slug(F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)).alias("video_id"),
        slug(parent_folder(F.col("video"))).alias("group_id"),
        "video",
        F.col("file").alias("annotation"),
        F.round("_d", 2).alias("duration"),
        F.round("_covered", 2).alias("annotated_s"),
        share(F.least("_covered", "_d")).alias("coverage_pct"),
        *[F.round(f"_g{g}", 2).alias(f"seconds_grade_{g}") for g in GRADES],
        *[share(F.col(f"_g{g}")).alias(f"pct_grade_{g}") for g in GRADES],
    )
