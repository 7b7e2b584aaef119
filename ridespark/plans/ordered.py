"""Ordered computations per key that do not put one key into one task.

A window partitioned by the video alone sends a whole video to one task; a video
holding a third of all rows would then decide the run time of the job. The helpers
here cut every key into chunks of the ordering column, work inside (key, chunk),
and carry what must cross a chunk border. What is carried is one row per chunk, so
the step that does look at a whole key sees rows / chunk-size rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import freeze

CHUNK = "_chunk"
HALO = "_halo"


def chunk_of(by: Column, width) -> Column:
    return F.floor(by / F.lit(width)).cast("long")


def halo_by_distance(
    df: DataFrame, by: str, width, *, before=0, after=0
) -> DataFrame:
    """Copy each row into every chunk that looks at it.

    A chunk covers ``[c*width, (c+1)*width)`` of column `by` and looks `before`
    back and `after` ahead of it. `width`, `before` and `after` are numbers or
    columns in the unit of `by`. Copies carry ``_halo = true``.
    """
    width, before, after = (x if isinstance(x, Column) else F.lit(x) for x in (width, before, after))
    x = F.col(by)
    first = F.floor((x - after) / width).cast("long")
    last = F.floor((x + before) / width).cast("long")
    out = df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
    return out.withColumn(HALO, F.col(CHUNK) != F.floor(x / width).cast("long"))


def halo_one_row(df: DataFrame, keys: Sequence[str], by: str, width: float) -> DataFrame:
    """Give every chunk the last row before it and the first row after it.

    For orderings without a bounded step (uneven times, gaps): the neighbour may be
    many chunks away. `by` is unique within the keys.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    cut = df.withColumn(CHUNK, chunk_of(F.col(by), width))
    row = F.struct(*payload)
    edges = cut.groupBy(*keys, CHUNK).agg(
        F.min_by(row, F.col(by)).alias("first"), F.max_by(row, F.col(by)).alias("last")
    )
    w = W.partitionBy(*keys).orderBy(CHUNK)
    carried = (
        edges.select(*keys, CHUNK, F.array(F.lag("last").over(w), F.lead("first").over(w)).alias("rows"))
        .select(*keys, CHUNK, F.explode("rows").alias("row"))
        .where(F.col("row").isNotNull())
        .select(*keys, *[F.col("row")[c].alias(c) for c in payload], CHUNK, F.lit(True).alias(HALO))
    )
    return cut.withColumn(HALO, F.lit(False)).unionByName(carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk_by: Column,
    width: float,
    order: Sequence[Column],
    values: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Running totals over all rows strictly before each row of its key.

    `values` maps an output name to ("sum" | "max" | "min", column). `order` is a total
    order within the keys whose leading term is `chunk_by`, ascending. The result of
    "sum" is 0 for the first row, that of the others is null; they pass over nulls.
    """
    keys = list(keys)
    ops = {"sum": F.sum, "max": F.max, "min": F.min}
    both = {"max": F.greatest, "min": F.least}
    cut = df.withColumn(CHUNK, chunk_of(chunk_by, width))
    for name, (_, value) in values.items():
        cut = cut.withColumn(f"_in_{name}", value)
    totals = cut.groupBy(*keys, CHUNK).agg(
        *[ops[kind](f"_in_{n}").alias(f"_c_{n}") for n, (kind, _) in values.items()]
    )
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys, CHUNK, *[ops[k](f"_c_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in values.items()]
    )
    inside = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = cut.join(carry, [*keys, CHUNK])
    for name, (kind, _) in values.items():
        local = ops[kind](f"_in_{name}").over(inside)
        base = F.col(f"_c_{name}")
        total = both[kind](local, base) if kind in both else (
            F.coalesce(local, F.lit(0)) + F.coalesce(base, F.lit(0))
        )
        out = out.withColumn(name, total)
    drop = [CHUNK] + [f"_in_{n}" for n in values] + [f"_c_{n}" for n in values]
    return out.drop(*drop)


def ordinal(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """1-based position in the total order, within `keys` or over the whole table.

    One range sort; every output partition numbers its own rows; the per-partition
    counts (one row per partition and key) turn these into positions. The sorted
    rows are written once, because the counts and the rows must see the same cuts.
    """
    keys = list(keys)
    laid = freeze(
        df.orderBy(*[F.col(k) for k in keys], *order).withColumn("_at", F.monotonically_increasing_id())
    )
    laid = laid.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_lo"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(
        *keys, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_lo") + 1).alias("_base")
    )
    if not keys:
        base = F.broadcast(base)  # one row per partition of the sorted table
    return (
        laid.join(base, [*keys, "_part"])
        .withColumn(name, (F.col("_at") + F.col("_base")).cast("long"))
        .drop("_at", "_part", "_base")
    )
