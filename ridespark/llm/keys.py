"""Keys and places of documents whose ids may be null, repeated or sparse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import ordinal
from .tables import written

KEYS = ["_no", "_id", "_h"]


def keyed(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`_no`, `_id` (the id, 0 for a null one), `_h` (a hash of the text) and `text` (empty for null).

    Rows with equal keys are equal documents. Ascending keys are ascending ids, nulls last.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).isNull().alias("_no"), F.coalesce(F.col(key), F.lit(0)).alias("_id"), F.xxhash64(value).alias("_h"), value.alias("text"))


def doc_id() -> Column:
    return F.when(~F.col("_no"), F.col("_id"))


def placed(rows: DataFrame, **extra: Column) -> DataFrame:
    """Distinct keys with `_c`, how many rows have them, and `_g`, their place from 1 on in key order."""
    groups = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_c"), *[v.alias(k) for k, v in extra.items()])
    return written(ordinal(written(groups, "keys"), [F.col(k) for k in KEYS], name="_g"), "places")
