"""As-of joins: attach to each row the row of another table nearest in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.ordered import CHUNK, chunk_of


def _neighbours(left, right, keys, left_t, right_t, width) -> DataFrame:
    """Left rows with the last right row at or before (`_back`) and the first at or after (`_ahead`).

    Both tables become one stream per (key, chunk of time). A chunk also receives the
    last right row before it and the first one after it, however far away.
    """
    keys = list(keys)
    rows = left.select(
        *keys,
        F.col(left_t).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*[c for c in left.columns if c not in keys]).alias("_left"),
    )
    facts = right.select(
        *keys,
        F.col(right_t).alias("_t"),
        F.lit(0).alias("_side"),
        F.struct(F.col(right_t).alias("_rt"), *[c for c in right.columns if c not in keys]).alias("_right"),
    )
    stream = rows.unionByName(facts, allowMissingColumns=True).withColumn(CHUNK, chunk_of(F.col("_t"), width))
    edges = stream.groupBy(*keys, CHUNK).agg(
        F.min_by("_right", F.when(F.col("_side") == 0, F.col("_t"))).alias("first"),
        F.max_by("_right", F.when(F.col("_side") == 0, F.col("_t"))).alias("last"),
    )
    forth = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        edges.select(
            *keys,
            CHUNK,
            F.array(
                F.last("last", ignorenulls=True).over(forth), F.last("first", ignorenulls=True).over(back)
            ).alias("_rights"),
        )
        .select(*keys, CHUNK, F.explode("_rights").alias("_right"))
        .where(F.col("_right").isNotNull())
        .withColumns({"_t": F.col("_right._rt"), "_side": F.lit(0)})
    )
    both = stream.unionByName(carried, allowMissingColumns=True)
    up = W.partitionBy(*keys, CHUNK).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys, CHUNK).orderBy(F.desc("_t"), "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.select(
        *keys,
        "_t",
        "_left",
        F.last("_right", ignorenulls=True).over(up).alias("_back"),
        F.last("_right", ignorenulls=True).over(down).alias("_ahead"),
    ).where(F.col("_left").isNotNull())


def _take(found: DataFrame, left: DataFrame, right: DataFrame, keys, pick, prefix) -> DataFrame:
    keys = list(keys)
    return found.withColumn("_pick", pick).select(
        *[F.col(c) if c in keys else F.col(f"_left.{c}").alias(c) for c in left.columns],
        *[F.col(f"_pick.{c}").alias(prefix + c) for c in right.columns if c not in keys],
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    left_t: str = "t",
    right_t: str = "t",
    keys: Sequence[str] = ("video_id",),
    prefix: str = "near_",
    width: float = 60.0,
) -> DataFrame:
    """The right row nearest in time, the earlier one on a tie; nulls where a key has none.

    Right times are unique within a key. One shuffle by (key, chunk), two sorts.
    """
    found = _neighbours(left, right, keys, left_t, right_t, width)
    before, after = F.col("_t") - F.col("_back._rt"), F.col("_ahead._rt") - F.col("_t")
    pick = F.when(F.col("_ahead").isNull() | (before <= after), F.col("_back")).otherwise(F.col("_ahead"))
    return _take(found, left, right, keys, pick, prefix)


def first_at_or_after(
    left: DataFrame,
    right: DataFrame,
    *,
    left_t: str = "t",
    right_t: str = "t",
    keys: Sequence[str] = ("video_id",),
    prefix: str = "next_",
    width: float = 60.0,
) -> DataFrame:
    """The first right row at or after each left time; nulls when there is none."""
    found = _neighbours(left, right, keys, left_t, right_t, width)
    return _take(found, left, right, keys, F.col("_ahead"), prefix)
