"""The benchmark tables seen as recordings.

`embeddings` becomes sample tables: runs of 50 consecutive vectors are one video, vector
elements 1..54 its feature columns, the label gives annotations. `events` becomes
telemetry, edit requests and music: a user is a video (and a track), the month is 26 s.
So the number of videos grows with the tables and no window is needed to number rows.
Every adapter reads whole tables and needs at most one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schemas import SAMPLE_COLUMNS

RUN = 50  # samples per video
RATE = 2.0
SPAN = 26.0  # seconds of music and requests per user
EPOCH_US = 1704067200000000
US_PER_SECOND = 1.0e11  # event microseconds per recording second


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _place() -> list[Column]:
    video = F.floor(F.col("vec_id") / RUN).cast("long")
    idx = F.pmod(F.col("vec_id"), F.lit(RUN)).cast("int")
    return [video.alias("video_id"), idx.alias("sample_idx"), ((idx + 1) / RATE).alias("t")]


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "embeddings").select(
        *_place(), *[F.col("embedding")[i].alias(n) for i, n in enumerate(SAMPLE_COLUMNS)]
    )


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """One 5 s interval per ten samples, graded by the sum of their labels modulo 4."""
    step = F.floor(F.col("sample_idx") / 10)
    return (
        _table(spark, folder, "embeddings")
        .select(*_place(), "label")
        .groupBy("video_id", step.alias("k"))
        .agg(F.sum("label").alias("total"))
        .select(
            "video_id",
            (F.col("k") * 5.0).alias("start_s"),
            (F.col("k") * 5.0 + 5.0).alias("end_s"),
            F.pmod("total", F.lit(4)).cast("int").alias("score"),
        )
    )


def videos(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _table(spark, folder, "embeddings")
        .select(*_place())
        .groupBy("video_id")
        .agg((F.count(F.lit(1)) / RATE).alias("duration"))
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("video_id").cast("string")
    return videos(spark, folder).select(
        "video_id",
        F.concat(F.lit("g"), F.pmod("video_id", F.lit(3)).cast("string")).alias("group_id"),
        F.concat(F.lit("rides/"), v, F.lit(".mp4")).alias("video"),
        F.concat(F.lit("lists/"), v, F.lit(".txt")).alias("annotation"),
    )


def _event_time() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / US_PER_SECOND


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """Uneven samples of one value per user."""
    return _table(spark, folder, "events").select(
        F.col("user_id").alias("video_id"), "event_id", _event_time().alias("t"), F.col("value").alias("rate")
    )


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping requests; five users share an edit; purchases are mandatory."""
    return _table(spark, folder, "events").select(
        F.floor(F.col("user_id") / 5).cast("long").alias("edit_id"),
        F.col("user_id").alias("video_id"),
        _event_time().alias("start_s"),
        (_event_time() + 0.5 + F.col("value") / 100).alias("end_s"),
        (F.col("event_type") == "purchase").alias("mandatory"),
        F.col("event_id").alias("annotation_order"),
    )


def music(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks and views are beats, sign-ups and purchases onsets, errors bass."""
    kind = (
        F.when(F.col("event_type").isin("click", "view"), "beat")
        .when(F.col("event_type") == "error", "bass")
        .otherwise("onset")
    )
    return _table(spark, folder, "events").select(
        F.col("user_id").alias("track_id"), kind.alias("kind"), _event_time().alias("t")
    )


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _table(spark, folder, "events").select(F.col("user_id").alias("track_id")).distinct().withColumn("duration", F.lit(SPAN))
    )


def attitude(spark: SparkSession, folder: str) -> DataFrame:
    """Attitude, acceleration and position per sample, from vector elements 1..9."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return _table(spark, folder, "embeddings").select(
        *_place(),
        *[e(i).alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz", "ax", "ay", "az"))],
        (45 + 0.01 * e(7)).alias("lat"),
        (11 + 0.01 * e(8)).alias("lon"),
    )


FLOW_WIDTH, FLOW_HEIGHT = 8, 4


def flow(spark: SparkSession, folder: str) -> DataFrame:
    """An 8 x 4 flow field per sample: elements 1..32 across, 33..64 down."""
    n = FLOW_WIDTH * FLOW_HEIGHT
    cut = lambda a: F.slice("embedding", a, n)
    return (
        _table(spark, folder, "embeddings")
        .select(*_place(), F.posexplode(F.arrays_zip(cut(1).alias("u"), cut(n + 1).alias("v"))).alias("p", "uv"))
        .select(
            "video_id",
            "sample_idx",
            F.floor(F.col("p") / FLOW_WIDTH).cast("int").alias("y"),
            F.pmod("p", F.lit(FLOW_WIDTH)).cast("int").alias("x"),
            F.col("uv.u").cast("double").alias("u"),
            F.col("uv.v").cast("double").alias("v"),
        )
    )
