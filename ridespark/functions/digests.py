"""Content digests and keys of settings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def settings_key(columns: Mapping[str, Column]) -> Column:
    """SHA-256 over the settings as JSON, in name order, nulls kept."""
    ordered = [columns[n].alias(n) for n in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)
