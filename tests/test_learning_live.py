import collections
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from ridespark import adapters as A, workloads
from ridespark.operators import audit, learning, normalize, smoothing, telemetry
from ridespark.schemas import DELTA_SOURCES, FEATURE_COLUMNS, GAINS, SAMPLE_COLUMNS
from ridespark.streaming import finite, live
from ridespark.workload_sql import SQL

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    data = []
    for video in range(6):
        for k in range(14):
            label = int(rng.integers(0, 4))
            x = rng.normal(size=3)
            x[0] += 1.5 * label
            data.append((video, f"g{video % 3}", k, 2.0 * k, 2.0 * k + 4, label, *map(float, x)))
    schema = "video_id long, group_id string, window_index int, start_s double, end_s double, label int, a double, b double, c double"
    return normalize.zscore(spark.createDataFrame(data, schema), NAMES, dtype="double").cache()


def test_pairwise_equals_all_pairs(table):
    """The moment form gives the weights of the explicit sum over all pairs."""
    pdf = table.toPandas()
    gram, rhs = np.zeros((3, 3)), np.zeros(3)
    for _, g in pdf.groupby("video_id"):
        x, y = g[NAMES].to_numpy(), g.label.to_numpy()
        for i, j in itertools.permutations(range(len(g)), 2):
            if y[i] > y[j]:
                w, d = GAINS[y[i]] - GAINS[y[j]], x[i] - x[j]
                gram += w * np.outer(d, d)
                rhs += w * d
    want = np.linalg.solve(gram + 1e-3 * np.trace(gram) / 3 * np.eye(3), rhs)
    scored = learning.fit_pairwise(table, NAMES).transform(table).select(*NAMES, "score").toPandas()
    assert np.allclose(scored.score, scored[NAMES].to_numpy() @ want)


def test_groups_and_preferences(table):
    split = learning.split_by_groups(table, ["g0"], ["g1"])
    assert {r[0] for r in split.train.select("group_id").distinct().collect()} == {"g1"}
    for bad in (dict(validation=[]), dict(validation=["nope"]), dict(validation=["g0"], train=["g0"])):
        with pytest.raises(ValueError):
            learning.split_by_groups(table, **bad)
    with pytest.raises(ValueError):
        learning.split_by_groups(table.withColumn("label", F.lit(1)), ["g0"])
    with pytest.raises(ValueError):
        learning.require_preferences(table.withColumn("label", F.lit(1)))
    with pytest.raises(ValueError):
        learning.RankerSettings(max_iter=0)


def test_boosted_train_save_and_score(spark, table, tmp_path):
    settings = learning.RankerSettings(max_iter=3, max_depth=2, min_instances_per_node=2)
    ranker, info = learning.train_ranker(table, train=["g0", "g1"], validation=["g2"], settings=settings, names=NAMES)
    assert 1 <= info["best_iteration"] <= 3 and len(info["history"]) == 3
    path = str(tmp_path / "m")
    ranker.save(spark, path)
    again = learning.SavedRanker.load(spark, path)
    a = learning.score_windows(ranker, table).orderBy("video_id", "window_index").toPandas().score
    b = learning.score_windows(again, table).orderBy("video_id", "window_index").toPandas().score
    assert np.allclose(a, b) and a.std() > 0 and again.settings["feature_normalization"] == learning.NORMALIZED


def test_classes_and_folds(table):
    p = learning.class_probabilities(learning.fit_classes(table, NAMES, trees=3), table).toPandas()
    assert np.allclose(p[["p0", "p1", "p2", "p3"]].sum(axis=1), 1) and set(p.predicted) <= {0, 1, 2, 3}
    folds = learning.leave_one_group_out(table, learning.fit_pairwise, names=NAMES).collect()
    assert {r.held_out_group for r in folds} <= {"g0", "g1", "g2"} and all(0 <= r.recall <= 1 for r in folds)


def test_training_table_order(spark, folder):
    """Normalization sees all windows: labelled rows alone need not have mean 0, all windows do."""
    t = workloads.training(spark, folder)
    assert set(FEATURE_COLUMNS) <= set(t.columns) and t.where(F.col("label").isNull()).isEmpty()


def test_training_table_with_a_gap(spark, folder, tmp_path):
    """Windows without telemetry are left out before normalizing, in training as in SQL and in scoring."""
    con = duckdb.connect()
    con.sql(f"copy (from '{folder}/embeddings.parquet') to '{tmp_path}/embeddings.parquet'")
    con.sql(f"copy (from '{folder}/events.parquet' where user_id <> 1 or epoch_us(ts) >= 1704067200000000 + 400000000000) to '{tmp_path}/events.parquet'")
    for t in ("embeddings", "events"):
        con.sql(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    got = workloads.QUERIES["training_table"](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({SQL['training_table']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    raw = learning.feature_windows(A.samples(spark, tmp_path), A.rates(spark, tmp_path))
    assert learning.without_telemetry(raw).select("video_id", "window_index").collect() == [(1, 0)]

    one = learning.SavedRanker(Pipeline(stages=[SQLTransformer(statement="select *, roll_index_mean as score from __THIS__")]).fit(raw), {"feature_normalization": learning.NORMALIZED})
    scores = {(r.video_id, r.window_index): r.score for r in learning.score_windows(one, raw).collect()}
    assert scores.pop((1, 0)) is None
    of = got.columns.index
    assert all(round(scores[w[of("video_id")], w[of("window_index")]], 3) == pytest.approx(w[of("roll_index_mean")], abs=1e-3) for w in want)


# -- telemetry ---------------------------------------------------------------


def test_high_pass_with_gaps(spark):
    rng = np.random.default_rng(9)
    t = np.cumsum(rng.uniform(0.08, 0.12, 50))
    x = [None if i % 7 == 3 else float(rng.normal()) for i in range(50)]
    df = spark.createDataFrame([(0, float(a), b) for a, b in zip(t, x)], "video_id long, t double, x double")
    got = smoothing.high_pass(df, ["x"], seconds=1.0, width=1.0).orderBy("t").toPandas().x
    half = max(1, round(49 / (t[-1] - t[0]) / 2))
    filled = np.array([np.mean([v for v in x if v is not None]) if v is None else v for v in x])
    for i, v in enumerate(x):
        lo, hi = max(0, i - half), min(50, i + half + 1)
        assert (v is None and np.isnan(got[i])) or got[i] == pytest.approx(v - filled[lo:hi].mean())


def still_camera(spark, n, q=(1.0, 0.0, 0.0, 0.0)):
    data = [(0, 0.1 * i, *q, 0.0, 0.0, 9.80665 + (0.5 if i % 2 else -0.5)) for i in range(n)]
    return spark.createDataFrame(data, "video_id long, t double, qw double, qx double, qy double, qz double, ax double, ay double, az double")


@pytest.mark.parametrize("n,gravity,used", [(20, "quat", "quat"), (6, "quat", "highpass (fallback)"), (20, "highpass", "highpass"), (20, "none", "none")])
def test_vehicle_motion_modes(spark, n, gravity, used):
    out = telemetry.vehicle_motion(still_camera(spark, n), gravity=gravity).orderBy("t").toPandas()
    assert set(out.gravity_used) == {used} and set(out.unit) == {"m/s2"} and len(out) == n
    assert np.allclose(out.lateral, 0, atol=1e-9) and np.allclose(out.tilt, 0, atol=1e-5)
    if gravity == "none":
        assert np.allclose(out.vertical.abs().mean(), 1.0, atol=0.01)


def test_vehicle_axes_by_hand(spark):
    out = telemetry.vehicle_motion(still_camera(spark, 12), gravity="none", level=False, axes="ZXY", invert=["lateral"]).first()
    assert out.lateral == pytest.approx(-out.acc_z_g)
    for bad in (dict(axes="XXY"), dict(invert=["up"]), dict(gravity="magic")):
        with pytest.raises(ValueError):
            telemetry.vehicle_motion(still_camera(spark, 3), **bad)


def test_gps_device_velocity(spark):
    df = spark.createDataFrame([(0, 0.0, 45.0, 11.0, 3.0, 4.0), (0, 1.0, 45.0, 11.0001, None, None), (0, 2.0, None, None, None, None)], "video_id long, t double, lat double, lon double, vx double, vy double")
    a, b = telemetry.gps_track(df, width=0.5).orderBy("t").collect()
    assert a.speed_ms == 5.0 and a.heading_deg == pytest.approx(np.degrees(np.arctan2(3, 4))) and a.distance_m == 0
    assert b.speed_ms == pytest.approx(b.step_m) and b.heading_deg == pytest.approx(90, abs=0.1) and b.distance_m == b.step_m


# -- audits ------------------------------------------------------------------


def test_sequence_audit_finds_each_mistake(spark):
    n = 12
    base = {c: 0.5 for c in SAMPLE_COLUMNS}
    data = []
    for i in range(n):
        v = {c: x + 0.001 * i * (1 + j) for j, (c, x) in enumerate(base.items())}
        v["flow_p90"] = v["flow_mean"] + 1
        v["flow_net"] = v["flow_mean"] / 2
        for r, c in itertools.product(range(3), range(3)):
            v[f"grid_{r}_{c}_magnitude"] = v[f"grid_{r}_{c}_net"] + 0.1
        data.append(v)
    for d, s in DELTA_SOURCES.items():
        for i in range(n):
            data[i][d] = 0.0 if i == 0 else data[i][s] - data[i - 1][s]
    rows = [(0, i, 0.5 * (i + 1), *[v[c] for c in SAMPLE_COLUMNS]) for i, v in enumerate(data)]
    schema = "video_id long, sample_idx int, t double, " + ", ".join(f"{c} double" for c in SAMPLE_COLUMNS)
    good = spark.createDataFrame(rows, schema)
    found = lambda df: {r.rule: r.violations for r in audit.audit_sequences(df, chunk=5).where("violations > 0").collect()}
    calm = found(good)
    assert set(calm) <= {"constant_columns"}, calm
    last = F.col("sample_idx") == 7
    spoil = lambda c, x: good.withColumn(c, F.when(last, F.lit(x)).otherwise(F.col(c)))
    assert "flow_p90_below_mean" in found(spoil("flow_p90", 0.0))
    assert "grid_1_2_net_above_magnitude" in found(spoil("grid_1_2_net", 9.0))
    assert "delta_flow_u_mismatch" in found(spoil("delta_flow_u", 9.0))
    assert "not_finite" in found(spoil("curl_std", float("nan")))
    assert "step_uneven" in found(spoil("t", 4.2))
    assert audit.sequence_validity(spoil("t", 0.1)).first().issue == "times_not_increasing"


# -- live forms --------------------------------------------------------------


def stream_of(spark, tmp_path, rows, schema, parts=3):
    src = str(tmp_path / "in")
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)


def test_live_matches_batch(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = e.groupBy(F.window("ts", "4 hours", "2 hours"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        "event_type", F.unix_micros("window.start").alias("start_us"), "n"
    )
    got = {tuple(r) for r in workloads.QUERIES["live_windows"](spark, folder).select("event_type", "start_us", "n").collect()}
    assert got == {tuple(r) for r in batch.collect()}


def batches(spark, tmp_path, rows, size):
    """A stream of (video_id, seconds, x) rows, one file a micro-batch, in the order given."""
    src = str(tmp_path / "in")
    for i in range(0, len(rows), size):
        frame = spark.createDataFrame(rows[i : i + size], "video_id long, t double, x double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
        frame.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema("video_id long, t double, x double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)


@pytest.mark.parametrize("size", [4, 100])
def test_complete_windows_and_islands(spark, tmp_path, size):
    rng = random.Random(1)
    times = sorted(round(rng.random() * 200, 3) for _ in range(60))
    rows = [(rng.randrange(3), t, round(rng.random(), 3)) for t in times]
    stream = batches(spark, tmp_path, rows, size)
    aggs = {"most": ("max", F.col("x")), "n": ("count", F.lit(1)), "total": ("sum", F.col("x")), "span": ("max", F.col("t"))}
    got = {tuple(r) for r in finite.complete_windows(stream, aggs, window="8 seconds", stride="4 seconds").selectExpr("video_id", "unix_seconds(start_ts)", "n", "most", "round(total, 6)", "span").collect()}
    groups = collections.defaultdict(list)
    for v, t, x in rows:
        for k in (int(t // 4), int(t // 4) - 1):
            groups[v, 4 * k].append((x, t))
    assert got == {(v, s, len(g), max(x for x, _ in g), round(sum(x for x, _ in g), 6), max(t for _, t in g)) for (v, s), g in groups.items()}
    got = {tuple(r) for r in finite.complete_islands(stream, "5 seconds").selectExpr("video_id", "unix_micros(first_ts)", "unix_micros(last_ts)", "events").collect()}
    want = set()
    for v in range(3):
        island = []
        for t in [t for w, t, _ in rows if w == v] + [1e9]:
            if island and t - island[-1] > 5:
                want.add((v, int(island[0] * 1e6), int(island[-1] * 1e6), len(island)))
                island = []
            island.append(t)
    assert got == want


def test_a_stream_goes_on_from_its_state(spark, tmp_path):
    """What is open after one run is in the state, and is not when later rows have closed it."""
    rows = [(1, float(t), 1.0) for t in (1, 2, 3, 50, 51)]
    stream = batches(spark, tmp_path, rows[:3], 3)
    folder = str(tmp_path / "run")
    aggs = {"n": ("count", F.lit(1))}
    run = lambda s: sorted(tuple(r) for r in finite.complete_windows(s, aggs, window="10 seconds", stride="10 seconds", folder=folder).selectExpr("unix_seconds(start_ts)", "n").collect())
    assert run(stream) == [(0, 3)]
    assert run(batches(spark, tmp_path, rows[3:], 2)) == [(0, 3), (50, 2)]


def test_aggregates_of_more_than_one_value_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        finite.complete_windows(batches(spark, tmp_path, [(1, 1.0, 1.0)], 1), {"mean": ("avg", F.col("x"))})


@pytest.mark.parametrize("size", [3, 100])
def test_live_distinct_does_not_depend_on_batches(spark, tmp_path, size):
    rows = [(i % 3, float(i), 0.0) for i in range(40)]
    out, _ = finite.run_available(live.live_distinct(batches(spark, tmp_path, rows, size), ["video_id"], within="10 seconds", lateness="5 seconds"))
    got = sorted(tuple(r) for r in out.selectExpr("video_id", "unix_seconds(span_ts)").collect())
    assert got == sorted({(v, int(t // 10) * 10) for v, t, _ in rows})


def test_live_delta_keeps_state(spark, tmp_path):
    rows = [(v, float(i), float(i * i + v)) for i in range(9) for v in (1, 2)]
    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([r for r in rows if i * 3 <= r[1] < i * 3 + 3], "video_id long, t double, x double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("video_id long, t double, x double").option("maxFilesPerTrigger", 1).parquet(src)
    out = finite.run_available(live.live_delta(stream, "x"))[0]
    got = {(r.video_id, r.t): r.delta for r in out.collect()}
    assert got == {(v, t): (0.0 if t == 0 else 2 * t - 1) for v, t, _ in rows}


def test_live_delta_beyond_one_arrow_batch(spark, tmp_path):
    rows = [(1, float(i), float(i * i)) for i in range(60)]
    stream = stream_of(spark, tmp_path, rows, "video_id long, t double, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.t: r.delta for r in finite.run_available(live.live_delta(stream, "x"))[0].collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {t: (0.0 if t == 0 else 2 * t - 1) for _, t, _ in rows}


def test_every_sql_twin_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
