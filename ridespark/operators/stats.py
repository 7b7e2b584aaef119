"""Correlations and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import ordinal, running
from ..plans.quantiles import exact_quantiles, join_on
from .signals import is_finite

NEAR_ZERO = 1e-8
MOSTLY_ZERO = 0.95


def _pair_rows(df: DataFrame, pairs: dict[tuple[str, str], tuple[Column, Column]], keys, value: str) -> DataFrame:
    """One row per key and pair: correlation over rows where both sides are finite, and their number."""
    sides = {str(c): c for pair in pairs.values() for c in pair}
    short = {text: f"_v{i}" for i, text in enumerate(sides)}
    df = df.select(*keys, *[F.when(is_finite(c), c).alias(short[t]) for t, c in sides.items()])
    aggs = []
    for i, (x, y) in enumerate(pairs.values()):
        a, b = short[str(x)], short[str(y)]
        own, other = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        # corr() fails on a constant column under ANSI rules, so the quotient is taken here
        spread = F.stddev_pop(own) * F.stddev_pop(other)
        aggs += [F.try_divide(F.covar_pop(a, b), spread).alias(f"r{i}"), F.count(own).alias(f"n{i}")]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("signal_a"),
                    F.lit(b).alias("signal_b"),
                    F.when(F.col(f"n{i}") >= 3, F.col(f"r{i}")).alias(value),
                    F.col(f"n{i}").alias("n"),
                )
                for i, (a, b) in enumerate(pairs)
            ]
        )
    )
    return wide.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def pearson(df: DataFrame, names: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of columns, all pairs in one aggregate."""
    pairs = {(a, b): (F.col(a).cast("double"), F.col(b).cast("double")) for a, b in combinations(names, 2)}
    return _pair_rows(df, pairs, keys, "pearson")


def average_ranks(values: DataFrame, *, keys: Sequence[str], value: str = "value", name: str = "rank") -> DataFrame:
    """Rank of each value within the keys, equal values sharing the mean of their positions.

    Equal values are counted before the shuffle; positions come from one range sort of
    the distinct values.
    """
    keys = list(keys)
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    order = ordinal(counts, [F.asc(value)], keys, "_o")
    # rows before a distinct value = running sum of counts along its ordinal
    upto = running(order, keys, F.col("_o"), 100_000, [F.col("_o")], {"_before": ("sum", F.col("_c"))})
    ranks = upto.select(*keys, value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(name))
    return values.join(ranks, [*keys, value])


def spearman(df: DataFrame, names: Sequence[str], *, ids: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of every pair of columns; `ids` tells rows apart.

    Where a column holds non-finite values, a pair is ranked over the rows where both of
    its sides are finite; otherwise one ranking per column serves all pairs.
    """
    keys, ids = list(keys), list(ids)
    own = [*keys, *[i for i in ids if i not in keys]]
    x = {n: F.col(n).cast("double") for n in names}
    gaps = df.agg(*[F.count(F.when(~is_finite(c), 1)).alias(n) for n, c in x.items()]).first()
    pairs = list(combinations(names, 2))
    if not any(gaps[n] for n in names):
        entries = {n: (F.lit(True), x[n]) for n in names}
        sides = {p: p for p in pairs}
    else:
        entries, sides = {}, {}
        for a, b in pairs:
            both = is_finite(x[a]) & is_finite(x[b])
            sides[a, b] = (f"{a}|{b}|a", f"{a}|{b}|b")
            entries[sides[a, b][0]] = (both, x[a])
            entries[sides[a, b][1]] = (both, x[b])
    long = (
        df.select(
            *own,
            F.explode(
                F.array(*[F.struct(F.lit(n).alias("name"), F.when(ok, v).alias("value")) for n, (ok, v) in entries.items()])
            ).alias("_e"),
        )
        .select(*own, "_e.*")
        .where(F.col("value").isNotNull())
    )
    ranks = average_ranks(long, keys=[*keys, "name"])
    wide = ranks.groupBy(*own).agg(*[F.max(F.when(F.col("name") == n, F.col("rank"))).alias(n) for n in entries])
    return _pair_rows(wide, {p: (F.col(f"`{s[0]}`"), F.col(f"`{s[1]}`")) for p, s in sides.items()}, keys, "spearman")


def correlation_table(df: DataFrame, names: Sequence[str], *, ids: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman side by side: signal_a, signal_b, pearson, spearman, n."""
    on = [*keys, "signal_a", "signal_b"]
    rank = spearman(df, names, ids=ids, keys=keys).drop("n")
    return pearson(df, names, keys=keys).join(rank, on).select(*on, "pearson", "spearman", "n")


def correlation_matrix(table: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
    """The symmetric matrix of one measure, one row per signal, ones on the diagonal."""
    half = table.select("signal_a", "signal_b", F.col(value).alias("v"))
    other = table.select(F.col("signal_b").alias("signal_a"), F.col("signal_a").alias("signal_b"), F.col(value).alias("v"))
    rows = half.unionByName(other).groupBy("signal_a").agg(
        *[F.max(F.when(F.col("signal_b") == n, F.col("v"))).alias(n) for n in names]
    )
    return rows.select(
        F.col("signal_a").alias("signal"),
        *[F.when(F.col("signal_a") == n, F.lit(1.0)).otherwise(F.col(n)).alias(n) for n in names],
    )


def column_profile(
    df: DataFrame, names: Sequence[str], *, keys: Sequence[str] = (), near_zero: float = NEAR_ZERO
) -> DataFrame:
    """Per column: min, max, mean, std, exact p01, median and p99, share near zero, and a warning."""
    keys = list(keys)
    x = {n: F.col(n).cast("double") for n in names}
    aggs = []
    for n, c in x.items():
        aggs.append(
            F.struct(
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("std"),
                F.avg((F.abs(c) < near_zero).cast("double")).alias("near_zero_fraction"),
            ).alias(f"_s_{n}")
        )
    df = df.withColumn("_all", F.lit(1))
    on = keys or ["_all"]
    cuts = exact_quantiles(df, on, {f"_q_{n}": c for n, c in x.items()}, [0.01, 0.5, 0.99])
    wide = join_on(df.groupBy(*on).agg(*aggs), cuts, on)
    rows = F.explode(
        F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_s_{n}").alias("s"), F.col(f"_q_{n}").alias("q")) for n in names])
    )
    out = wide.select(*keys, rows.alias("_r")).select(
        *keys,
        "_r.feature",
        "_r.s.min",
        "_r.s.max",
        "_r.s.mean",
        "_r.s.std",
        F.col("_r.q")[0].alias("p01"),
        F.col("_r.q")[1].alias("median"),
        F.col("_r.q")[2].alias("p99"),
        "_r.s.near_zero_fraction",
    )
    warnings = F.concat_ws(
        ", ",
        F.when(F.col("std") < near_zero, "near-constant"),
        F.when(F.col("near_zero_fraction") >= MOSTLY_ZERO, "mostly zero"),
    )
    return out.withColumn("status", F.when(warnings == "", "OK").otherwise(warnings))


def pareto_trials(
    trials: DataFrame, *, study: str = "study", gain: str = "value_0", cost: str = "value_1"
) -> DataFrame:
    """Trials no other trial of the study beats in both values (gain up, cost down).

    A trial stays when it has the lowest cost at its gain and every higher gain costs
    more. The lowest cost of all higher gains is a running value along the gain.
    """
    best = trials.groupBy(study, gain).agg(F.min(cost).alias("_cost"))
    span = best.groupBy(study).agg(F.max(gain).alias("_top"))
    along = best.join(span, study).withColumn("_down", F.col("_top") - F.col(gain))
    prior = running(along, [study], F.col("_down"), 0.01, [F.col("_down")], {"_higher": ("max", -F.col("_cost"))})
    front = prior.where(F.col("_higher").isNull() | (-F.col("_higher") > F.col("_cost"))).select(study, gain, "_cost")
    return trials.join(front, [study, gain]).where(F.col(cost) == F.col("_cost")).drop("_cost")


def study_choices(trials: DataFrame, *, study: str = "study", number: str = "number", gain: str = "value_0", cost: str = "value_1") -> DataFrame:
    """Per study the Pareto trial closest to (1, 0), the one with the largest gap, and the one with most gain."""
    front = pareto_trials(trials, study=study, gain=gain, cost=cost)
    g, c, n = F.col(gain), F.col(cost), F.col(number)
    return front.groupBy(study).agg(
        F.count(F.lit(1)).alias("pareto_trials"),
        F.min_by(n, F.struct(F.hypot(g - 1, c), n)).alias("closest_to_ideal"),
        F.min_by(n, F.struct(-(g - c), n)).alias("largest_gap"),
        F.min_by(n, F.struct(-g, c, n)).alias("highest_gain"),
    )


def best_trial(trials: DataFrame, *, study: str = "study", number: str = "number", value: str = "value") -> DataFrame:
    """The trial with the highest value per study, the first one on a tie."""
    return trials.where(F.col(value).isNotNull()).groupBy(study).agg(
        F.max_by(number, F.struct(F.col(value), -F.col(number))).alias("best_trial"), F.max(value).alias("best_value")
    )
