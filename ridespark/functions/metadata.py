"""Columns from JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: what a stored sequence says about itself
SEQUENCE_FIELDS = (
    "cache_version int, array_format_version int, feature_schema_version int, feature_names array<string>, "
    "source_path string, source_fingerprint_mode string, source_size_bytes long, source_mtime_ns long, "
    "source_sha256 string, clip struct<start: double, end: double>, sample_fps double, processing_width int, "
    "roi struct<left: double, right: double, bottom: double, top: double>, flow_config map<string, string>"
)


def json_fields(df: DataFrame, text: str, schema: str = SEQUENCE_FIELDS) -> DataFrame:
    """Add the fields of a JSON column; all null where the text is not an object of that form."""
    return df.withColumn("_m", F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})).select(
        *df.columns, "_m.*"
    )


def json_value(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)
