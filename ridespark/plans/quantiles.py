"""Exact quantiles per key, by one plan for every size of key.

A mergeable sketch brackets every wanted rank; what lies below a bracket is one counter, and only the
values inside the brackets (a share of about 8/accuracy of the key) are ordered. Nothing is counted
beforehand, so building the plan runs no job; it reads its input twice, so what is dear to compute is
written before. Keys whose groups are bounded by construction (a
window, a frame) may say so and get Spark's `percentile`, which gives the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ACCURACY = 10_000


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null."""
    if not keys:
        return a.crossJoin(b)
    named = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]), how).drop(*[f"_r_{k}" for k in keys])


def multiply_add(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with a single rounding; the three are doubles and not null."""
    return F.java_method(F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")


def quantile_of(ordered: Column, prob: float) -> Column:
    """Quantile of an ascending array of doubles without nulls; null if it is empty. NaN comes last.

    Linear between the two nearest ranks, by one multiplication and one multiply-add as DuckDB does it.
    A float-rounded quantile of floats often lies half-way between two floats, and the last digit of the
    double decides which one it becomes; `percentile` rounds once more there, which reorders near-equal
    scores against SQL.
    """
    at = (F.size(ordered) - 1) * F.lit(float(prob))
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    share = at - F.floor(at)
    between = multiply_add(low, 1 - share, high * share)
    return F.when(low.isNull() | (low == high), low).otherwise(between)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    probs: Sequence[float],
    *,
    upper: bool = False,
    bounded: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key; each name of `values` is an array with one entry per prob, or null without values.

    Linear interpolation between the two nearest ranks, or with `upper` the element
    at position floor(n/2) (`probs` is then ``[0.5]``). Nulls are left out, NaN comes last.
    """
    keys = list(keys)
    if upper and list(probs) != [0.5]:
        raise ValueError("the upper variant is defined for the median only")
    base = df.select(*keys, *[v.cast("double").alias(n) for n, v in values.items()])
    if bounded:
        if upper:
            pick = [
                F.when(F.count(n) > 0, F.array(F.expr(f"percentile_disc(0.5) within group (order by `{n}` desc)"))).alias(n)
                for n in values
            ]
        else:
            pick = [F.percentile(n, list(map(float, probs))).alias(n) for n in values]
        return base.groupBy(*keys).agg(*pick)
    return _bracketed(base, keys, list(values), list(probs), upper, accuracy)


def _bracketed(base, keys, names, probs, upper, accuracy) -> DataFrame:
    # NaN is ordered as an infinity and told from it by its rank
    long = base.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(n).alias("_v")) for n in names])).alias("_e"),
    ).select(*keys, "_e._name", "_e._v")
    long = long.withColumns({"_nan": F.isnan("_v"), "_v": F.when(F.isnan("_v"), F.lit(float("inf"))).otherwise(F.col("_v"))})
    group = [*keys, "_name"]

    slack = 4.0 / accuracy
    cuts = [c for p in probs for c in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = long.groupBy(*group).agg(
        F.count("_v").alias("_n"),
        F.count_if("_nan").alias("_nans"),
        F.percentile_approx("_v", cuts, accuracy).alias("_cut"),
    )
    at = lambda p: F.floor(F.col("_n") / 2) if upper else F.lit(float(p)) * (F.col("_n") - 1)
    # in a small group the two neighbouring ranks may lie outside the cuts: its bracket is the group
    wide = F.col("_n") * slack < 3
    wanted = sketch.where("_n > 0").select(
        *group,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_i"),
                        at(p).cast("double").alias("_at"),
                        (F.col("_n") - F.col("_nans")).alias("_known"),
                        F.when(wide, float("-inf")).otherwise(F.col("_cut")[2 * i]).alias("_lo"),
                        F.when(wide, float("inf")).otherwise(F.col("_cut")[2 * i + 1]).alias("_hi"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ).alias("_w"),
    ).select(*group, "_w.*")

    # one pass: everything below a bracket collapses into one counter, map-side
    hit = join_on(long, wanted, group).where(F.col("_v") <= F.col("_hi"))
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    counted = hit.groupBy(*group, "_i", "_at", "_known", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*group, "_i").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_n").over(upto))
    low, high = F.floor("_at"), F.ceil("_at")
    picked = ranked.groupBy(*group, "_i", "_at", "_known").agg(
        F.min(F.when(F.col("_upto") > low, F.struct("_upto", "_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > high, F.struct("_upto", "_v"))).alias("_b"),
    )
    nan = lambda v, rank: F.when(rank >= F.col("_known"), F.lit(float("nan"))).otherwise(v)
    a, b = nan(F.col("_a._v"), low), nan(F.col("_b._v"), high)
    value = F.when(
        F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("sketch bracket missed a rank; raise accuracy"))
    ).otherwise(F.when(low == high, a).otherwise((high - F.col("_at")) * a + (F.col("_at") - low) * b))
    rows = picked.select(*group, "_i", value.cast("double").alias("_q"))
    # keys without any value keep their row: the sketch has it
    every = rows.unionByName(sketch.select(*group), allowMissingColumns=True)
    one = lambda n, i: F.max(F.when((F.col("_name") == n) & (F.col("_i") == i), F.col("_q")))
    some = lambda n: F.count(F.when(F.col("_name") == n, F.col("_q"))) > 0
    return every.groupBy(*keys).agg(*[F.when(some(n), F.array(*[one(n, i) for i in range(len(probs))])).alias(n) for n in names])
