"""Subtitle-style camera logs: one text block per frame, with fields in brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_CLOCK = r"\d{2}:\d{2}:\d{2}[,.]\d{3}"
# a counter line, the timing line, then the text of the frame
_BLOCK = rf"^\s*\S[^\r\n]*[\r\n]+[ \t]*({_CLOCK})\s*-->\s*({_CLOCK})[ \t]*[\r\n]+\s*(\S[\s\S]*)$"
_BLANK = r"\r?\n[ \t]*\r?\n"


def read_blocks(spark: SparkSession, path: str, *, separator: str = "\n\n") -> DataFrame:
    """One row per block: file, block. Files are split at the separator, so a long log is
    read by many tasks; blocks that another blank-line style left together are cut here."""
    raw = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(path)
    text = F.regexp_replace("value", "^﻿", "")
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.explode(F.split(text, _BLANK)).alias("block")
    )


def _clock(text: Column) -> Column:
    """Seconds of ``HH:MM:SS,mmm`` text of exactly that width."""
    part = lambda start, n: F.substring(text, start, n).try_cast("int")
    return part(1, 2) * 3600 + part(4, 2) * 60 + part(7, 2) + part(10, 3) / 1000.0


def _entities(text: Column) -> Column:
    # fixed values: the five character entities of markup text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """Telemetry rows of all readable blocks; others (no timing, no length) are skipped."""
    group = lambda i: F.translate(F.regexp_extract("block", _BLOCK, i), ".", ",")
    text_of = F.regexp_extract("block", _BLOCK, 3)
    plain = F.regexp_replace(F.regexp_replace(text_of, r"\s*[\r\n]+\s*", " "), "</?font[^>]*>", "")
    # times of this form compare as text, so rows are dropped before anything is computed
    rows = (
        blocks.select("file", group(1).alias("_from"), group(2).alias("_to"), _entities(plain).alias("_body"))
        .where(F.col("_to") > F.col("_from"))
        .select("file", _clock(F.col("_from")).alias("t"), _clock(F.col("_to")).alias("end_s"), "_body")
    )
    body = F.col("_body")
    none = lambda x: F.nullif(x, F.lit(""))
    text = lambda name: F.trim(none(F.regexp_extract(body, rf"(?i)\[{name}:\s*([^\]]*)\]", 1)))
    finite = lambda x: F.when((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), x)
    number = lambda x: finite(x.try_cast("double"))
    altitude = lambda i: number(
        none(F.regexp_extract(body, r"(?i)\[rel_alt:\s*([-+\d.]+)\s+abs_alt:\s*([-+\d.]+)", i))
    )
    stamp = none(F.regexp_extract(body, r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)", 1))
    return rows.select(
        "file",
        "t",
        "end_s",
        none(F.regexp_extract(body, r"FrameCnt:\s*(\d+)", 1)).try_cast("long").alias("frame"),
        F.regexp_replace(stamp, r"\s+", " ").try_cast("timestamp").alias("recorded_at"),
        number(text("iso")).alias("iso"),
        text("shutter").alias("shutter"),
        number(text("fnum")).alias("aperture"),
        number(text("ev")).alias("ev"),
        number(text("ct")).alias("color_temperature"),
        number(text("latitude")).alias("lat"),
        number(text("longitude")).alias("lon"),
        altitude(1).alias("relative_altitude"),
        altitude(2).alias("absolute_altitude"),
        text("eis").alias("eis"),
    )


def order_findings(log: DataFrame) -> DataFrame:
    """Files with two blocks starting at the same time: starts must increase."""
    return (
        log.groupBy("file", "t")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("file", F.lit("error").alias("severity"), F.lit("times_not_increasing").alias("code"), "t")
    )


def block_text() -> Column:
    """A log block from columns frame, t, end_s, iso, lat, lon; for writing logs of this form."""
    clock = lambda s: F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(s / 3600).cast("int"),
        F.floor(F.pmod(F.floor(s / 60), F.lit(60))).cast("int"),
        F.floor(F.pmod(F.floor(s), F.lit(60))).cast("int"),
        F.round(F.pmod(s * 1000, F.lit(1000.0))).cast("int"),
    )
    fields = F.concat(
        *[
            x
            for name in ("iso", "latitude", "longitude")
            for x in (F.lit(f"[{name}: "), F.col({"latitude": "lat", "longitude": "lon"}.get(name, name)).cast("string"), F.lit("] "))
        ]
    )
    return F.concat_ws(
        "\n",
        F.col("frame").cast("string"),
        F.concat(clock(F.col("t")), F.lit(" --> "), clock(F.col("end_s"))),
        F.concat(F.lit('<font size="28">FrameCnt: '), F.col("frame").cast("string")),
        F.concat(fields, F.lit("</font>")),
    )
