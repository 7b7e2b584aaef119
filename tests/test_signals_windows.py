import numpy as np
import pytest
from pyspark.sql import functions as F

from ridespark.operators import flow, labels, normalize, signals, smoothing, telemetry, windows
from ridespark.plans.inspect import plan_text
from ridespark.schemas import FEATURE_COLUMNS, SAMPLE_COLUMNS, SIGNAL_COLUMNS, feature_name, require_columns


def samples_of(spark, matrix, video=0):
    data = [(video, i, 0.5 + 0.5 * i, *map(float, row)) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, "video_id long, sample_idx int, t double, " + ", ".join(f"{n} float" for n in SAMPLE_COLUMNS))


def test_contract():
    assert len(SAMPLE_COLUMNS) == 54 and len(FEATURE_COLUMNS) == 49 and FEATURE_COLUMNS[-1] == "pitch_rate_rms"
    assert feature_name(3) == feature_name("3") == "flow_u" and feature_name(" flow_v ") == "flow_v"
    for bad in ("", "54", -1, "nope"):
        with pytest.raises(ValueError):
            feature_name(bad)


def test_require_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b float, a float")
    require_columns(df, ("b", "a"), "float")
    for names, dtype in ((("a", "b"), None), (("a", "c"), None), (("b", "a"), "double")):
        with pytest.raises(ValueError):
            require_columns(df, names, dtype)


def reference_signals(x):
    col = {n: x[:, i].astype(float) for i, n in enumerate(SAMPLE_COLUMNS)}
    u = np.stack([[col[f"grid_{r}_{c}_u"] for c in range(3)] for r in range(3)])
    v = np.stack([[col[f"grid_{r}_{c}_v"] for c in range(3)] for r in range(3)])
    m, res = np.hypot(u, v), np.hypot(u - col["flow_u"], v - col["flow_v"])
    base, ring = m[1, 1] + 1e-5, (m.sum((0, 1)) - m[1, 1]) / 8
    ang = np.arctan2(v, u)
    return {
        "vertical_flow_gradient": (m[0].mean(0) - m[2].mean(0)) / base,
        "lateral_flow_asymmetry": (m[:, 2].mean(0) - m[:, 0].mean(0)) / base,
        "expansion_index": (ring - m[1, 1]) / base,
        "roll_index": (m[0, 0] + m[2, 2] - m[0, 2] - m[2, 0]) / base,
        "directional_turbulence": 1 - np.hypot(np.cos(ang).mean((0, 1)), np.sin(ang).mean((0, 1))),
        "global_flow_magnitude": np.hypot(col["flow_u"], col["flow_v"]),
        "center_residual": res[1, 1],
        "tunnel_vision": (res[0, 0] + res[0, 2]) / 2 / (res[1, 1] + 1e-5),
    }


def test_signals_against_numpy_and_plan(spark):
    x = np.random.default_rng(0).normal(size=(20, 54)).astype("float32")
    df = samples_of(spark, x)
    out = signals.engineered_signals(df, strict=True).orderBy("sample_idx").toPandas()
    for name, want in reference_signals(x).items():
        assert np.allclose(out[name], want, rtol=1e-5, atol=1e-5), name
    text = plan_text(signals.engineered_signals(df))
    assert "Exchange" not in text and "EvalPython" not in text


def test_strict_signals_refuse_nan(spark):
    x = np.zeros((3, 54), "float32")
    x[1, 3] = np.nan
    with pytest.raises(Exception, match="non-finite"):
        signals.engineered_signals(samples_of(spark, x), strict=True).collect()


def test_deltas(spark):
    x = np.random.default_rng(1).normal(size=(25, 54)).astype("float32")
    got = signals.sample_deltas(samples_of(spark, x), chunk=4).orderBy("sample_idx").toPandas()
    want = np.diff(x[:, 3].astype(float), prepend=float(x[0, 3]))
    assert np.allclose(got["delta_flow_u"], want)


def test_window_grid_and_statistics(spark):
    x = np.arange(20 * 54).reshape(20, 54)
    sig = samples_of(spark, x).select("video_id", "sample_idx", "t", F.col("flow_mean").alias("a"))
    grid = windows.sampling_grid(sig, window=4.0, stride=2.0, chunk_seconds=3.0)
    g = grid.first()
    assert (g.dt, g.rows_per_window, g.rows_per_stride, g.n_windows, g.issue) == (0.5, 8, 4, 4, None)
    for kw in ({"dt": 0.5}, {"grid": grid}):
        out = windows.window_statistics(sig, names=["a"], dtype="double", **kw).orderBy("window_index").toPandas()
        assert list(out.start_s) == [0.0, 2.0, 4.0, 6.0] and list(out.end_s) == [4.0, 6.0, 8.0, 10.0]
        for k, row in out.iterrows():
            w = x[4 * k : 4 * k + 8, 0]
            want = [w.mean(), w.max(), w.std(), np.median(w), np.percentile(w, 90), w.min()]
            assert np.allclose(row[[f"a_{s}" for s in ("mean", "max", "std", "median", "q90", "min")]].astype(float), want)


def test_windows_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(windows, "WINDOWS_PER_CHUNK", 2)
    sig = samples_of(spark, np.arange(33 * 54).reshape(33, 54)).select("video_id", "sample_idx", "t", "flow_mean")
    out = windows.windowed(sig, {"s": F.sum("sample_idx")}, window=4.0, stride=2.0, dt=0.5).orderBy("window_index").collect()
    assert [r.s for r in out] == [sum(range(4 * k, 4 * k + 8)) for k in range(7)]


@pytest.mark.parametrize(
    "window,stride,issue",
    [(4.2, 2.0, "window_off_lattice"), (4.0, 1.7, "stride_off_lattice"), (0.5, 0.5, "window_too_short"), (60.0, 2.0, "sequence_too_short")],
)
def test_grid_issues(spark, window, stride, issue):
    sig = samples_of(spark, np.zeros((20, 54)))
    g = windows.sampling_grid(sig, window=window, stride=stride).first()
    assert g.issue == issue and g.n_windows == 0
    if "lattice" in issue or issue == "window_too_short":
        with pytest.raises(ValueError):
            windows.windowed(sig, {}, window=window, stride=stride, dt=0.5)


def test_window_plan_moves_rows_once(spark, folder):
    from ridespark import workloads

    text = plan_text(workloads.QUERIES["windows_stats"](spark, folder))
    tree = text.split("\n\n(1)")[0]
    assert tree.count("Exchange") == 1 and "Python" not in text


def test_majority_labels(spark, rows):
    win = spark.createDataFrame([(0, 0, 0.0, 4.0), (0, 1, 4.0, 8.0)], "video_id long, window_index int, start_s double, end_s double")
    ann = spark.createDataFrame(
        [(0, 0.0, 1.0, 1), (0, 1.0, 2.0, 2), (0, 2.0, 4.0, 1), (0, 4.0, 6.0, 1), (0, 6.0, 8.0, 2)],
        "video_id long, start_s double, end_s double, score int",
    )
    assert rows(labels.majority_grade(win, ann, bucket=1.5), "window_index", "label") == [(0, 1), (1, 2)]
    more = win.unionByName(spark.createDataFrame([(0, 2, 8.0, 12.0)], win.schema))
    part = spark.createDataFrame([(0, 1.0, 2.0, 0), (0, 6.0, 7.0, 3)], ann.schema)
    assert rows(labels.majority_grade(more, part), "window_index", "label") == [(0, 0), (1, 3)]
    assert labels.label_windows(win, ann.limit(0)).count() == 0


def test_purity(spark, rows):
    v = spark.createDataFrame([(1, 10.0)], "video_id long, duration double")
    ann = spark.createDataFrame([(1, 0.0, 5.0, 1), (1, 5.0, 10.0, 3)], "video_id long, start_s double, end_s double, score int")
    assert rows(labels.window_purity(v, ann)) == [(1, 4, 2, 2, 0)]


def test_zscore(spark):
    df = spark.createDataFrame([(0, 10.0, 4.0, 1.0), (0, 12.0, 4.0, 3.0), (0, 14.0, 4.0, 5.0)], "video_id long, a double, b double, c double")
    out = normalize.zscore(df, ["a", "b", "c"]).toPandas()
    assert np.allclose(out[["a", "b", "c"]].mean(), 0, atol=1e-6)
    assert np.allclose(out[["a", "b", "c"]].std(ddof=0), [1, 0, 1], atol=1e-6)


def test_robust_scale(spark):
    df = spark.createDataFrame([(0, float(x)) for x in (0, 1, 2, 3, 1000)] + [(1, 5.0)] * 3, "video_id long, x double")
    out = normalize.robust_scale(df, {"y": F.col("x")}).toPandas()
    assert out[out.video_id == 0].y.min() == 0 and out[out.video_id == 0].y.max() == 1
    assert (out[out.video_id == 1].y == 0).all()


def test_pitch_rms_windows(spark, rows):
    t = np.arange(0, 8.0001, 0.04)
    rate = spark.createDataFrame([(0, float(a), 3.0 if a < 4 - 1e-9 else 4.0) for a in t], "video_id long, t double, rate double")
    win = spark.createDataFrame([(0, 0, 0.0, 4.0), (0, 1, 2.0, 6.0), (0, 2, 4.0, 8.0)], "video_id long, window_index int, start_s double, end_s double")
    got = dict(rows(telemetry.window_rms(win, rate), "window_index", "pitch_rate_rms"))
    assert got[0] == 3.0 and got[2] == 4.0 and abs(got[1] - 12.5**0.5) < 1e-5


def test_pitch_rms_offset_and_missing(spark, rows):
    t = [i * 0.1 for i in range(121)]
    rate = spark.createDataFrame([(0, a, a) for a in t], "video_id long, t double, rate double")
    win = spark.createDataFrame([(0, 0, 0.0, 2.0), (0, 1, 50.0, 52.0)], "video_id long, window_index int, start_s double, end_s double")
    got = telemetry.window_rms(win, rate, offset=6.0)
    inside = [a for a in t if 6.0 <= a < 8.0]
    assert rows(got, "pitch_rate_rms")[0][0] == pytest.approx(np.sqrt(np.mean(np.square(inside))), abs=1e-6)
    assert rows(telemetry.missing_telemetry(windows.append_window_value(win, got, "pitch_rate_rms")), "video_id", "code") == [(0, "no_telemetry")]


def test_flow_against_numpy(spark):
    h, w = 7, 9
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(h, w)), rng.normal(size=(h, w))
    df = spark.createDataFrame([(0, 0, y, x, float(u[y, x]), float(v[y, x])) for y in range(h) for x in range(w)], "video_id long, sample_idx int, y int, x int, u double, v double")
    out = flow.frame_features(df, width=w, height=h).first()
    un, vn = u / w, v / h
    du_dy, du_dx = np.gradient(un, 1 / (h - 1), 1 / (w - 1))
    dv_dy, dv_dx = np.gradient(vn, 1 / (h - 1), 1 / (w - 1))
    div, curl, m = du_dx + dv_dy, dv_dx - du_dy, np.hypot(u, v)
    base = np.hypot(un, vn).mean() + 1e-6
    want = {
        "flow_mean": m.mean(), "flow_p90": np.percentile(m, 90), "flow_std": m.std(), "flow_net": np.hypot(u.mean(), v.mean()),
        "div_normalized_mean": abs(div).mean() / base, "div_abs_p90": np.percentile(abs(div), 90), "div_std": div.std(),
        "div_pos_fraction": (div > 0).mean(), "curl_normalized_mean": abs(curl).mean() / base, "curl_std": curl.std(),
    }
    ys, xs = np.linspace(0, h, 4, dtype=int), np.linspace(0, w, 4, dtype=int)
    for r in range(3):
        for c in range(3):
            cell = np.s_[ys[r] : ys[r + 1], xs[c] : xs[c + 1]]
            want[f"grid_{r}_{c}_u"] = u[cell].mean()
            want[f"grid_{r}_{c}_net"] = np.hypot(u[cell].mean(), v[cell].mean())
            want[f"grid_{r}_{c}_magnitude"] = m[cell].mean()
    for name, value in want.items():
        assert out[name] == pytest.approx(value), name


def test_rolling_median_and_derivative(spark):
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.uniform(0.05, 0.6, 60))
    x = rng.normal(size=60)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(t, x)], "video_id long, t double, x double")
    med = smoothing.rolling_median(df, ["x"], 1.0, width=2.0).orderBy("t").toPandas()
    assert np.allclose(med.x, [np.median(x[(t >= a - 0.5) & (t <= a + 0.5)]) for a in t])
    rate = smoothing.time_derivative(df, {"r": "x"}, width=1.0).orderBy("t").toPandas()
    assert np.allclose(rate.r, np.gradient(x, t))


def test_polynomial_smooth(spark):
    n, length, degree = 23, 7, 2
    x = np.random.default_rng(5).normal(size=n)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "video_id long, sample_idx int, x double")
    got = smoothing.polynomial_smooth(df, ["x"], length=length, degree=degree, chunk=5).orderBy("sample_idx").toPandas().x
    half, want = length // 2, np.empty(n)
    for i in range(n):
        lo = min(max(i - half, 0), n - length)
        want[i] = np.polyval(np.polyfit(np.arange(lo, lo + length), x[lo : lo + length], degree), i)
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        smoothing.polynomial_smooth(df, ["x"], length=4)


def test_interest_windows(spark):
    df = spark.createDataFrame([(0, float(t), t / 2) for t in range(3)], "video_id long, t double, a double")
    out = windows.interest_windows(df, ["a"], sizes=[2.0], stride=1.0).orderBy("window_index").collect()
    assert out[0].a == pytest.approx(0.6 * 0.5 + 0.4 * 0.25) and [r.start_s for r in out][:2] == [0.0, 1.0]


def test_model_signal_names():
    assert SIGNAL_COLUMNS[0] == "vertical_flow_gradient" and SIGNAL_COLUMNS[-1] == "tunnel_vision"
