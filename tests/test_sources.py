import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ridespark.functions import digests, text, times
from ridespark.operators import audit, learning, store, telemetry
from ridespark.sources import flightlog, lists, manifest, sinks


def evaluate(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_seconds(spark):
    good = {"90": 90, "1:30": 90, "01:02:03": 3723, "75:10": 4510, "0:01.5": 1.5, " 2:05 ": 125, "1e2": 100, "10:00:00": 36000}
    assert evaluate(spark, times.seconds_of, list(good)) == list(good.values())
    bad = ["", "a", "1:60", "1:60:00", "1:00:60", "1:2:3:4", "-1", "1:-2", "nan", "inf", "1:", "1d"]
    assert evaluate(spark, times.seconds_of, bad) == [None] * len(bad)


def test_clock_and_rate(spark):
    assert evaluate(spark, times.clock_of, [0.0, 59.9, 3599.0, 3600.0, 360000.0, -1.0], "double") == ["00:00", "00:59", "59:59", "01:00:00", "100:00:00", None]
    got = evaluate(spark, times.rate_of, ["30000/1001", "25", "1/0", "x", "", None])
    assert got == pytest.approx([30000 / 1001, 25, 0, 0, 0, 0])
    assert evaluate(spark, times.whole_second, [10.5, 10.49], "double") == [11.0, 10.0]


def test_paths(spark):
    assert evaluate(spark, text.path_kind, ["a.MP4", "b c.mp3 *", "x.txt", ".mp4", "d/e.flac"]) == ["video", "audio", "other", "other", "audio"]
    assert evaluate(spark, text.parent_folder, ["D:\\Big Ride\\a.mp4", "x/y/z.mp4", "z.mp4"]) == ["Big Ride", "y", ""]


def write(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content, encoding="utf-8")
    return p


def test_training_lists(spark, tmp_path, rows):
    write(tmp_path, "a.txt", "﻿# note\n\nclips/v.mp4\nStart End MTB Remarks\n00:10 00:20 3 fine jump\n00:00 00:10 1\n")
    write(tmp_path, "b.txt", "/abs/w.mp4\r\n00:00 00:10 7\r\n00:10 00:05 1\r\nbad\r\n00:20 00:30 1\r\n00:31 00:40 2\r\n")
    ann, videos, issues = lists.parse_training_annotations(lists.read_lines(spark, str(tmp_path)))
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    assert rows(ann.where(name == "a.txt"), "start_s", "end_s", "score", "remarks") == [(0, 10, 1, ""), (10, 20, 3, "fine jump")]
    assert sorted(r.code for r in issues.collect()) == ["end_before_start", "not_contiguous", "score_range", "too_few_fields"]
    paths = {r.video for r in videos.collect()}
    assert "/abs/w.mp4" in paths and any(p.endswith("/clips/v.mp4") and p.startswith("file:") for p in paths)


def test_request_lists(spark, tmp_path):
    body = "\n".join(
        ["# edit", "", "one.mp4", "0:05 0:20", "0:21 0:22", "0:30 0:31 *", "two.mp4 1:00 1:10", "1:20 1:30", "three.mp4", "four.mp4", "0:00 0:01", "my song's.mp3 *", "late one.wav"]
    )
    write(tmp_path, "e.txt", body)
    base = lists.read_lines(spark, str(tmp_path)).first().file.rsplit("/", 1)[0] + "/"
    videos = spark.createDataFrame([(base + "three.mp4", 33.0), (base + "four.mp4", 44.0)], "video string, duration double")
    clips, music, issues = lists.parse_requests(lists.read_lines(spark, str(tmp_path)), videos)
    got = [(r.video.rsplit("/", 1)[1], r.start_s, r.end_s, r.mandatory, r.annotation_order) for r in clips.orderBy("annotation_order").collect()]
    assert got == [
        ("one.mp4", 5, 20, False, 4), ("one.mp4", 30, 31, True, 6), ("two.mp4", 60, 70, False, 7),
        ("two.mp4", 80, 90, False, 8), ("three.mp4", 0, 33, False, 9),
    ]
    m = music.first()
    assert m.audio.endswith("late one.wav") and m.mix is False and issues.count() == 0


@pytest.mark.parametrize(
    "line,code",
    [("0:10 0:05", "end_before_start"), ("0:10 x", "unreadable_time"), ("0:10", "bad_row"), ("0:01 0:09 +", "bad_directive"), ("v.mov 0:01", "bad_row"), ("v.x 1 2 3 4", "bad_row")],
)
def test_request_mistakes(spark, line, code):
    lines = spark.createDataFrame([("f", 1, "v.mp4"), ("f", 2, line)], "file string, line_no int, line string")
    _, _, issues = lists.parse_requests(lines)
    assert [r.code for r in issues.collect()] == [code]


def test_interval_before_video(spark):
    lines = spark.createDataFrame([("f", 1, "0:01 0:09")], "file string, line_no int, line string")
    assert [r.code for r in lists.parse_requests(lines)[2].collect()] == ["interval_before_video"]
    with pytest.raises(ValueError):
        lists.parse_requests(lines, min_clip=0)


def test_scan_lists(spark, rows):
    data = [("x/My List.txt", 1, "D:\\Big Ride\\a.mp4"), ("x/My List.txt", 2, "00:00 00:10 1"), ("x/My List.txt", 3, "00:10 00:40 3 wow"), ("x/none.txt", 1, "b.mp4")]
    lines = spark.createDataFrame(data, "file string, line_no int, line string")
    r = manifest.scan_lists(lines).collect()
    assert len(r) == 1 and (r[0].video_id, r[0].group_id, r[0].duration, r[0].seconds_grade_3, r[0].pct_grade_1) == ("my_list", "big_ride", 40, 30, 25)


def test_flight_log(spark, tmp_path):
    block = (
        '1\n00:00:00,000 --> 00:00:00,033\n<font size="28">FrameCnt: 1, DiffTime: 33ms\n2025-09-23 10:05:25.123\n'
        "[iso: 100] [shutter: 1/500.0] [fnum: 2.8] [ev: 0] [ct: 5200] [latitude: 45.5] [longitude: 11.25] [rel_alt: 1.5 abs_alt: 300.25] &lt;x&gt;</font>\n"
    )
    bad = "2\nno timing\nx\n"
    late = block.replace("00:00:00,000 --> 00:00:00,033", "00:00:00,033 --> 00:00:00,066").replace("[iso: 100]", "[iso: n/a]")
    write(tmp_path, "unix.srt", f"{block}\n{bad}\n{late}")
    write(tmp_path, "dos.srt", f"{block}\n{late}".replace("\n", "\r\n"))
    log = flightlog.parse_blocks(flightlog.read_blocks(spark, str(tmp_path))).orderBy("file", "t").collect()
    assert len(log) == 4
    r = log[0]
    assert (r.t, r.end_s, r.frame, r.iso, r.shutter, r.aperture, r.lat, r.lon, r.relative_altitude, r.absolute_altitude) == (0, 0.033, 1, 100, "1/500.0", 2.8, 45.5, 11.25, 1.5, 300.25)
    assert log[1].iso is None and r.recorded_at.year == 2025
    twice = spark.createDataFrame([("f", 1.0), ("f", 1.0)], "file string, t double")
    assert flightlog.order_findings(twice).count() == 1


def test_manifest_files(spark, tmp_path):
    rows_ = [{"id": " a ", "group_id": "g", "video": "v.mp4"}, {"id": "A", "group_id": "", "video": "w.mp4", "annotation": "x.txt"}]
    p = write(tmp_path, "m.json", "\n".join(json.dumps(r) for r in rows_))
    m = manifest.read_manifest(spark, str(p))
    codes = {(r.code, r.severity) for r in audit.manifest_findings(m).collect()}
    assert codes == {("id_duplicate", "error"), ("group_missing", "error"), ("not_annotated", "warning")}
    with pytest.raises(ValueError, match="group_missing"):
        manifest.checked_manifest(m)
    ok = m.where("group_id = 'g'")
    assert manifest.checked_manifest(ok).first().video_id == "a"
    assert manifest.resolve_paths(ok, "/base").first().video == "/base/v.mp4"
    assert [r.group_id for r in manifest.groups_of(ok).collect()] == ["g"]


def test_manifest_audit(spark):
    m = spark.createDataFrame([("v", "g1", "v.mp4", "v.txt")], "video_id string, group_id string, video string, annotation string")
    v = spark.createDataFrame([("v", 10.0)], "video_id string, duration double")
    a = spark.createDataFrame([("v", 0.0, 5.0, 1), ("v", 5.0, 10.0, 3)], "video_id string, start_s double, end_s double, score int")
    issues, summary = audit.audit_manifest(m, v, a, train=["g1"], validation=["absent"])
    s = summary.first()
    assert (s.estimated_windows, s.estimated_pure_windows, s.estimated_conflicting_windows) == (4, 2, 2)
    assert audit.status(issues).first().status == "error"
    assert {r.code for r in issues.collect()} == {"split_unknown_group"}
    calm, _ = audit.audit_manifest(m, v, a)
    assert audit.status(calm).first().status == "warning"


def test_ride_channels(spark):
    names = [*telemetry.RIDE_ZERO_WHEN_MISSING, *telemetry.RIDE_NULL_WHEN_MISSING, "temperature", "pressure", "timestamp"]
    values = {"speed": 1850, "cadence": 7500, "altitude": 51234, "temperature": 2150, "timestamp": 1700000000}
    df = spark.createDataFrame([tuple(values.get(n) for n in names), tuple(-99900 if n == "temperature" else None for n in names)], ", ".join(f"{n} long" for n in names))
    a, b = telemetry.ride_channels(df).collect()
    assert (a.speed, a.cadence, a.altitude, a.temperature, a.distance_km) == (18.5, 75.0, 512.34, 21.5, 0.0)
    assert b.temperature is None and b.altitude is None and b.pressure is None and b.speed == 0 and b.date is None


def test_store_roundtrip(spark, folder, tmp_path):
    from ridespark import adapters as A

    s = A.samples(spark, folder).withColumn("contract_key", digests.settings_key({"rate": F.lit(2), "width": F.lit(480)}))
    path = str(tmp_path / "seq")
    store.write_sequences(s, path)
    key = s.select("contract_key").first()[0]
    back = store.read_interval(spark, path, key)
    assert back.count() == s.count()
    assert store.read_interval(spark, path, key, start=0.5, end=2.0).select("t").distinct().count() == 2
    recorded = store.sequence_digest(s)
    assert store.changed_sequences(back, recorded).count() == 0
    touched = back.withColumn("flow_u", F.when((F.col("video_id") == 1) & (F.col("sample_idx") == 3), F.lit(9.0).cast("float")).otherwise(F.col("flow_u")))
    assert [r.video_id for r in store.changed_sequences(touched, recorded).collect()] == [1]
    plan = store.read_interval(spark, path, key, start=0.5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(t), GreaterThan(t" in plan and "PartitionFilters: [isnotnull(contract_key" in plan


def test_covering(spark, rows):
    e = spark.createDataFrame([("e1", "k", "s", 0.0, 100.0), ("e2", "k", "s", 0.0, 40.0), ("e3", "k", "s", 10.0, 20.0), ("e4", "x", "s", 10.0, 20.0)], "entry_id string, contract_key string, source string, start_s double, end_s double")
    q = spark.createDataFrame([("r1", "k", "s", 10.0, 20.0), ("r2", "k", "s", 5.0, 30.0), ("r3", "k", "s", 50.0, 120.0), ("r4", "k", "s", 35.0, 41.0)], "request_id string, contract_key string, source string, start_s double, end_s double")
    assert rows(store.find_covering(q, e, bucket=8.0)) == [("r1", "e3", True), ("r2", "e2", False), ("r4", "e1", False)]
    tail = spark.createDataFrame([("r5", "k", "s", 35.0, 40.5)], q.schema)  # its last whole window ends at 39
    assert rows(store.find_covering(tail, e, bucket=8.0)) == [("r5", "e1", False)]
    assert rows(store.find_covering(tail, e, window=4.0, stride=2.0, bucket=8.0)) == [("r5", "e2", False)]


@pytest.mark.parametrize("n", [1, 7, 300])
def test_covering_brute_force(spark, n):
    rng = random.Random(n)
    span = lambda longest: (lambda a: (float(a), float(a + rng.randint(1, longest))))(rng.randint(0, 40))
    entries = [(f"e{i:03}", "k", rng.choice("st"), *span(30)) for i in range(n)] + [("e999", "k", "s", None, 9.0)]
    wants = [(i, "k", rng.choice("stu"), *span(8)) for i in range(n)] + [(-1, "k", "s", None, 3.0)]
    e = spark.createDataFrame(entries, "entry_id string, contract_key string, source string, start_s double, end_s double")
    q = spark.createDataFrame(wants, "request_id long, contract_key string, source string, start_s double, end_s double")
    want = {}
    for i, _, source, a, b in wants[:-1]:
        fits = [((x, y) != (a, b), y - x, name) for name, _, s, x, y in entries[:-1] if s == source and x <= a and y >= b]
        if fits:
            want[i] = (min(fits)[2], not min(fits)[0])
    got = {r.request_id: (r.entry_id, r.exact) for r in store.find_covering(q, e, bucket=8.0).collect()}
    assert got == want


def test_covering_search_makes_no_pairs(spark):
    """10,000 requests and 10,000 entries in one place: rows grow by a logarithm."""
    n = 10_000
    e = spark.range(n).selectExpr("id as entry_id", "'k' as contract_key", "'s' as source", "id / 1e4 as start_s", "30 + (id * 7919 % 10000) / 1e3 as end_s")
    q = spark.range(n).selectExpr("id as request_id", "'k' as contract_key", "'s' as source", "1 + id / 1e4 as start_s", "20 + (id % 977) / 50 as end_s")
    out = store.find_covering(q, e)
    starts, ends = [i / 1e4 for i in range(n)], [30 + (i * 7919 % 10000) / 1e3 for i in range(n)]
    got = {r.request_id: r.entry_id for r in out.collect()}
    for i in range(0, n, 501):
        a, b = 1 + i / 1e4, 20 + (i % 977) / 50
        fits = [(y - x, j) for j, (x, y) in enumerate(zip(starts, ends)) if x <= a + 1e-6 and y >= b - 1e-6]
        assert got.get(i) == (min(fits)[1] if fits else None)
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString()


def test_retention(spark):
    cat = spark.createDataFrame([("a.parquet", True), ("b.parquet", True), ("c.parquet", False)], "path string, valid boolean")
    plan, issues = store.retention_plan(cat, spark.createDataFrame([("a.parquet",)], "path string"))
    assert {r.path for r in plan.collect()} == {"b.parquet", "c.parquet"} and issues.count() == 0
    bad = spark.createDataFrame([("a.parquet",), ("a.parquet",), ("c.parquet",), ("../x.parquet",), ("b.txt",)], "path string")
    plan, issues = store.retention_plan(cat, bad)
    assert plan.count() == 0 and {r.code for r in issues.collect()} == {"duplicate", "invalid", "outside_root", "missing", "wrong_type"}


def test_settings_and_search():
    s = learning.effective_settings({"window": 6.0, "stride": None}, {"window_stride": 3.0, "window": 9.0})
    assert (s["window"], s["stride"]) == (6.0, 3.0)
    with pytest.raises(ValueError):
        learning.effective_settings({"window": -1})
    c, span, whole = learning.Choice, learning.Span, learning.Whole
    for bad in (
        lambda: learning.search_space(nope=1), lambda: learning.search_space(seed=1), lambda: learning.search_space(max_depth=span(1.0, 2.0)), lambda: c(()),
        lambda: span(1.0, math.inf), lambda: span(2.0, 1.0), lambda: span(0.0, 1.0, scale="log"), lambda: span(1.0, 2.0, step=0.5, scale="log"), lambda: span(1.0, 2.0, step=-1.0),
        lambda: span(1.0, 2.0, scale="square"), lambda: whole(1.5, 3), lambda: whole(3, 1),
    ):
        with pytest.raises(ValueError):
            bad()
    space = learning.search_space(max_depth=whole(2, 4), max_iter=7)
    a, b = learning.draw_trials(space, 50), learning.draw_trials(space, 50)
    assert a == b and {t["max_iter"] for t in a} == {7} and {t["max_depth"] for t in a} == {2, 3, 4}
    assert all(0.02 <= t["step_size"] <= 0.3 and t["subsampling_rate"] % 0.125 == 0 and 0.5 <= t["subsampling_rate"] <= 1 for t in a)
    assert {t["subsampling_rate"] for t in a} >= {0.5, 1.0}
    assert len(learning.grid_trials({"a": c((1, 2)), "b": c((3,))})) == 2


def test_score_report_files(spark, folder, tmp_path):
    from ridespark import adapters as A, workloads
    from ridespark.operators import ranking

    rows_, summary = ranking.score_report(workloads.scored_windows(spark, folder), A.manifest(spark, folder))
    sinks.write_score_report(rows_, summary, str(tmp_path / "r"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "r" / "windows"))
    assert back.columns == list(ranking.REPORT_COLUMNS) and back.count() == rows_.count()
    assert spark.read.option("header", "true").csv(str(tmp_path / "r" / "videos")).count() == summary.count()
