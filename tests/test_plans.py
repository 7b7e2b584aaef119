"""Chunked and bracketed computations agree with plain ones, whatever the chunk size."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from ridespark.plans import quantiles
from ridespark.plans.intervals import drop_overlapping, in_cells, overlap_pairs
from ridespark.plans.ordered import halo_by_distance, halo_one_row, ordinal, running


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    data = []
    for video in range(3):
        t = 0.0
        for i in range(200 if video == 0 else 20):
            t += rng.choice([0.01, 0.5, 7.0])
            data.append((video, t, rng.gauss(0, 3), rng.randint(0, 4)))
    return spark.createDataFrame(data, "video_id long, t double, x double, g int").cache()


@pytest.mark.parametrize("width", [0.5, 3.0, 1e6])
def test_one_row_halo_gives_true_neighbours(points, rows, width):
    near = halo_one_row(points, ["video_id"], "t", width)
    w = W.partitionBy("video_id", "_chunk").orderBy("t")
    got = near.withColumns({"p": F.lag("x").over(w), "n": F.lead("x").over(w)}).where(~F.col("_halo"))
    plain = W.partitionBy("video_id").orderBy("t")
    want = points.withColumns({"p": F.lag("x").over(plain), "n": F.lead("x").over(plain)})
    assert rows(got, "video_id", "t", "p", "n") == rows(want, "video_id", "t", "p", "n")


@pytest.mark.parametrize("width", [0.7, 50.0])
def test_distance_halo_holds_all_rows_in_reach(points, rows, width):
    near = halo_by_distance(points, "t", width, before=2.0, after=2.0)
    near = near.withColumn("x", F.col("x"))
    frame = "over (partition by video_id, _chunk order by t range between 2.0D preceding and 2.0D following)"
    got = near.withColumn("n", F.expr(f"count(x) {frame}")).where(~F.col("_halo"))
    plain = "over (partition by video_id order by t range between 2.0D preceding and 2.0D following)"
    assert rows(got, "video_id", "t", "n") == rows(points.withColumn("n", F.expr(f"count(x) {plain}")), "video_id", "t", "n")


@pytest.mark.parametrize("width", [1.0, 20.0, 1e6])
def test_running_values_cross_chunks(points, rows, width):
    got = running(points, ["video_id"], F.col("t"), width, [F.col("t")], {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))})
    w = W.partitionBy("video_id").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    want = points.withColumns({"s": F.coalesce(F.sum("x").over(w), F.lit(0.0)), "m": F.max("x").over(w)})
    assert rows(got, "video_id", "t", "s", "m") == rows(want, "video_id", "t", "s", "m")


def test_ordinal_matches_row_number(points, rows):
    order = [F.desc("g"), F.asc("t"), F.asc("x")]
    within = points.withColumn("n", F.row_number().over(W.partitionBy("video_id").orderBy(*order)).cast("long"))
    assert rows(ordinal(points, order, ["video_id"], "n"), "video_id", "t", "n") == rows(within, "video_id", "t", "n")
    order = [F.desc("g"), F.asc("video_id"), F.asc("t")]
    total = ordinal(points, order, (), "n").orderBy("n").select("n", "g").collect()
    assert [r.n for r in total] == list(range(1, len(total) + 1))
    assert [r.g for r in total] == sorted((r.g for r in total), reverse=True)


@pytest.mark.parametrize("kind", ["smooth", "tied", "outlier"])
@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_quantiles_are_exact(spark, kind, accuracy):
    rng = np.random.default_rng(3)
    x = {
        "smooth": rng.normal(size=5000),
        "tied": rng.integers(0, 3, 5000).astype(float),
        "outlier": np.append(np.zeros(4999), 1e9),
    }[kind]
    df = spark.createDataFrame([(i % 2 if i < 4980 else 2, float(v)) for i, v in enumerate(x)], "k int, x double")
    groups = {0: x[:4980:2], 1: x[1:4980:2], 2: x[4980:]}
    probs = [0.01, 0.05, 0.5, 0.9, 1.0]
    for r in quantiles.exact_quantiles(df, ["k"], {"q": F.col("x")}, probs, accuracy=accuracy).collect():
        assert np.allclose(r.q, np.percentile(groups[r.k], [100 * p for p in probs]))
    for bounded in (False, True):
        for r in quantiles.exact_quantiles(df, ["k"], {"q": F.col("x")}, [0.5], upper=True, accuracy=accuracy, bounded=bounded).collect():
            own = np.sort(groups[r.k])
            assert r.q[0] == own[len(own) // 2]


def test_quantiles_of_odd_groups_equal_percentile(spark):
    nan, inf = float("nan"), float("inf")
    data = [("a", None), ("a", None), (None, 1.0), (None, 2.0), ("n", nan), ("n", 1.0), ("n", 3.0), ("n", nan), ("i", inf), ("i", nan), ("i", 0.0), ("i", -inf), ("o", 5.0)]
    df = spark.createDataFrame(data, "k string, x double")
    ask = lambda **o: {r.k: str(r.q) for r in quantiles.exact_quantiles(df, ["k"], {"q": F.col("x")}, [0.0, 0.5, 0.9, 1.0], **o).collect()}
    assert ask() == ask(bounded=True) and set(ask()) == {"a", None, "n", "i", "o"}
    whole = [str(quantiles.exact_quantiles(df, [], {"q": F.col("x")}, [0.25, 0.5], bounded=b).collect()) for b in (True, False)]
    assert whole[0] == whole[1]


def test_building_a_quantile_plan_runs_no_job(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    quantiles.exact_quantiles(spark.range(10), [], {"q": F.col("id")}, [0.5])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_overlap_pairs_once_each(spark, width):
    rng = random.Random(5)
    span = lambda: (lambda a: (rng.randint(0, 1), a, a + rng.choice([0.5, 3.0, 40.0, 4000.0])))(round(rng.uniform(0, 60), 1))
    left, right = [span() for _ in range(40)], [span() for _ in range(40)]
    left, right = sorted(set(left)), sorted(set(right))
    a = spark.createDataFrame(left, "k int, s double, e double")
    b = spark.createDataFrame(right, "k int, rs double, re double")
    got = sorted(tuple(r) for r in overlap_pairs(a, b, ["k"], ("s", "e"), ("rs", "re"), width=width).select("k", "s", "e", "rs", "re").collect())
    want = sorted((k, s, e, rs, re_) for k, s, e in left for k2, rs, re_ in right if k == k2 and s < re_ and rs < e)
    assert got == want
    free = sorted(tuple(r) for r in drop_overlapping(a, b, ["k"], ("s", "e"), ("rs", "re"), width=width).collect())
    assert free == sorted(set(left) - {w[:3] for w in want})


def test_a_long_interval_makes_few_copies(spark):
    df = spark.createDataFrame([(0.0, 36_000.0), (59.0, 61.0), (5.0, None)], "s double, e double")
    copies = {r.e: r.n for r in in_cells(df, "s", "e", 60.0).groupBy("e").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(copies) == {36_000.0, 61.0} and max(copies.values()) < 40
    assert copies[61.0] == 7  # two own cells and one of each greater width
    own = in_cells(df, "s", "e", 60.0, above=False)
    assert own.where("e = 36000").select("_level").distinct().collect()[0][0] == 4


def test_running_minimum(spark):
    rows = [(k, float(t), (t * 37 + k) % 11) for k in range(3) for t in range(40)]
    df = spark.createDataFrame(rows, "k int, t double, x long")
    got = {(r.k, r.t): r.m for r in running(df, ["k"], F.col("t"), 6.0, [F.col("t")], {"m": ("min", F.col("x"))}).collect()}
    assert got == {(k, t): min((x for j, u, x in rows if j == k and u < t), default=None) for k, t, _ in rows}
