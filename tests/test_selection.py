import random

import pytest
from pyspark.sql import functions as F

from ridespark.operators import edits, metrics, music, ranking, segments, selection, stats, timeline

WIN = "video_id long, window_index int, start_s double, end_s double, score double"
EV = "array<struct<start_s:double,end_s:double,window_index:int,score:double>>"
CAND = (
    "edit_id long, video_id long, video_order int, start_s double, end_s double, duration double, "
    f"max_score double, mean_score double, evidence {EV}, annotation_order int"
)
CLIP = "edit_id long, video_id long, start_s double, end_s double, mandatory boolean, annotation_order int"


def windows_of(spark, spans, scores, video=0):
    return spark.createDataFrame([(video, i, float(s), float(e), float(x)) for i, ((s, e), x) in enumerate(zip(spans, scores))], WIN)


def cand(start, end, score, video=1, mean=None, evidence=1, edit=0, order=0):
    proof = evidence if isinstance(evidence, list) else [(float(start), float(end), i, float(score)) for i in range(evidence)]
    return (edit, video, video - 1, float(start), float(end), float(end - start), float(score), float(score if mean is None else mean), proof, order)


def choose(spark, cands, mandatory=(), budget=None, **kw):
    c = spark.createDataFrame(list(cands), CAND)
    m = spark.createDataFrame([(0, v, float(a), float(b), True, 9) for v, a, b in mandatory], CLIP)
    b = None if budget is None else spark.createDataFrame([(0, float(budget))], "edit_id long, budget double")
    out = selection.select_greedy(c, m, budgets=b, **kw).orderBy(*selection.candidate_order())
    return [(r.video_id, r.start_s, r.end_s) for r in out.collect()]


def test_segments(spark):
    w = windows_of(spark, [(0, 2), (2, 4), (10, 12), (12, 14), (20, 22)], [-0.1, -0.2, -0.3, -0.4, -0.15])
    out = segments.ranked_segments(w, k=4, gap=0.0).orderBy("segment_rank").collect()
    assert [r.max_score for r in out] == [-0.1, -0.15, -0.3]
    assert out[0].window_count == 2 and out[0].mean_score == pytest.approx(-0.15)
    w = windows_of(spark, [(0, 4), (6, 10), (12.01, 16)], [1, 2, 3])
    out = segments.ranked_segments(w, k=10, gap=2.0).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s) for r in out] == [(0, 10), (12.01, 16)]
    for bad in ({"k": 0}, {"gap": -1.0}):
        with pytest.raises(ValueError):
            segments.ranked_segments(w, **bad)


@pytest.mark.parametrize("width", [1.0, 4.0, 600.0])
def test_merge_ranges(spark, rows, width):
    df = spark.createDataFrame([(0, a, b) for a, b in [(8.0, 10.0), (1.0, 3.0), (3.0, 5.0), (4.5, 7.0), (12.0, 13.0)]], "video_id long, start_s double, end_s double")
    assert rows(segments.merge_ranges(df, width=width), "start_s", "end_s", "members") == [(1, 7, 3), (8, 10, 1), (12, 13, 1)]


def test_merge_ranges_brute_force(spark):
    rng = random.Random(7)
    data = sorted({(0, a, a + rng.choice([0.2, 1.0, 30.0])) for a in (round(rng.uniform(0, 300), 1) for _ in range(80))})
    df = spark.createDataFrame(data, "video_id long, start_s double, end_s double")
    want = []
    for _, a, b in data:
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    got = sorted([r.start_s, r.end_s] for r in segments.merge_ranges(df, width=9.0).collect())
    assert got == want


def scored(spark, groups):
    data = [(v, i, *map(float, span), label, float(s)) for v, g in enumerate(groups) for i, (span, label, s) in enumerate(g)]
    return spark.createDataFrame(data, "video_id long, window_index int, start_s double, end_s double, label int, score double")


def test_recall(spark):
    spans = [(0, 4), (2, 6), (6, 10), (8, 12), (20, 24), (22, 26)]
    one = scored(spark, [list(zip(spans, [3, 3, 3, 0, 3, 3], [0.9, 0.1, 0.2, 0, 0.8, 0.3]))])
    r = metrics.segment_recall(one, k=2).first()
    assert (r.segment_recall, r.events, r.hit_events, r.videos_with_events) == (1.0, 2, 2, 1)
    none = metrics.segment_recall(one.withColumn("label", F.lit(2)), k=2).first()
    assert none.segment_recall is None and none.videos_with_events == 0
    two = scored(
        spark,
        [
            list(zip([(0, 2), (4, 6), (8, 10), (12, 14)], [3, 0, 3, 0], [0.9, 0.1, 0.2, 0.3])),
            list(zip([(0, 2), (4, 6), (8, 10), (12, 14)], [0, 3, 0, 0], [0.9, 0.1, 0.2, 0.3])),
        ],
    )
    r = metrics.segment_recall(two, k=1).first()
    assert (r.events, r.hit_events, r.segment_recall) == (3, 1, 0.25)
    with pytest.raises(ValueError):
        metrics.segment_recall(one, k=0)


def test_ndcg_of_ideal_and_flat(spark):
    g = scored(spark, [list(zip([(0, 2), (2, 4), (4, 6)], [3, 1, 0], [3, 2, 1])), list(zip([(0, 2)], [0], [1]))])
    assert [r.ndcg for r in metrics.ndcg_by_video(g).orderBy("video_id").collect()] == [1.0, 1.0]


def test_priority(spark):
    got = choose(spark, [cand(10, 14, 0.75), cand(0, 4, 0.95), cand(2, 6, 0.6), cand(2, 6, 0.6, video=2)])
    assert got == [(1, 0, 4), (1, 10, 14), (2, 2, 6)]


def test_mandatory_excludes(spark):
    assert choose(spark, [cand(3, 7, 0.95), cand(11, 15, 0.6)], [(1, 5, 10)]) == [(1, 11, 15)]


def test_trim(spark):
    proof = [(0.0, 4.0, 0, 0.4), (4.0, 8.0, 1, 0.7), (8.0, 12.0, 2, 0.95)]
    c = spark.createDataFrame([cand(0, 12, 0.95, evidence=proof)], CAND)
    r = selection.trim_to_evidence(c, max_clip=6.0, min_clip=3.0).first()
    assert (r.start_s, r.end_s) == (6.0, 12.0) and [e.window_index for e in r.evidence] == [1, 2]
    assert r.mean_score == pytest.approx(0.825) and r.max_score == 0.95
    assert selection.trim_to_evidence(c, max_clip=2.0, min_clip=3.0).count() == 0
    bare = spark.createDataFrame([cand(0, 12, 0.95, evidence=[])], CAND)
    r = selection.trim_to_evidence(bare, max_clip=6.0, min_clip=3.0).first()
    assert (r.start_s, r.end_s, r.max_score) == (3.0, 9.0, 0.95)


def test_rank_keys(spark):
    c = spark.createDataFrame([cand(0, 4, 0.9, evidence=1), cand(10, 14, 0.9, evidence=2, mean=0.7), cand(20, 24, 0.9, evidence=2, mean=0.8), cand(30, 36, 0.9, evidence=2, mean=0.8)], CAND)
    assert [r.start_s for r in c.orderBy(*selection.candidate_order()).collect()] == [30, 20, 10, 0]


def test_budget(spark):
    three = [cand(0, 4, 0.7), cand(10, 14, 0.95), cand(20, 24, 0.8)]
    assert choose(spark, three, budget=8) == [(1, 10, 14), (1, 20, 24)]
    assert choose(spark, [cand(10, 14, 0.8), cand(20, 25, 0.99)], [(2, 0, 6)], budget=10) == [(1, 10, 14)]
    assert choose(spark, [cand(0, 4, 0.8)], [(2, 0, 8)], budget=5) == []


@pytest.mark.parametrize("head,width", [(20_000, 8.0), (3, 7.0), (1, 1.0)])
@pytest.mark.parametrize("budget", [None, 60.0])
def test_greedy_brute_force(spark, head, width, budget):
    rng = random.Random(11)
    cands = []
    for i in range(60):
        a = round(rng.uniform(0, 60), 1)
        cands.append(cand(a, a + rng.choice([3.0, 5.0, 9.0, 40.0]), rng.choice([0.1, 0.5, 0.9]), video=rng.randint(1, 2), mean=i / 100, order=i))
    kept, left = [], budget
    for c in sorted(cands, key=lambda c: (-c[6], -len(c[8]), -c[7], -c[5], c[2], c[3], c[1], c[9])):
        if any(k[1] == c[1] and c[3] < k[4] and k[3] < c[4] for k in kept):
            continue
        if left is not None and c[5] > left + 1e-9:
            continue
        kept.append(c)
        left = None if left is None else max(0.0, left - c[5])
    assert sorted(choose(spark, cands, budget=budget, head=head, width=width)) == sorted((c[1], c[3], c[4]) for c in kept)


@pytest.mark.parametrize("head", [2, 20_000])
def test_greedy_skips_one_after_the_other(spark, head):
    """Every second candidate is too long for what is left, and frees one that it overlapped."""
    cands, start = [], 0.0
    for i, length in enumerate([5.0, 16.0, 4.0, 12.0, 3.0, 9.0, 2.0]):
        cands.append(cand(start, start + length, 100 - 2 * i))
        cands.append(cand(start + 0.5, start + 1.5, 99 - 2 * i - 50))
        start += 30
    got = choose(spark, cands, budget=20.0, head=head)
    kept, left = [], 20.0
    for c in sorted(cands, key=lambda c: -c[6]):
        if c[5] <= left + 1e-9 and not any(c[3] < k[4] and k[3] < c[4] for k in kept):
            kept.append(c)
            left -= c[5]
    assert sorted(got) == sorted((1, c[3], c[4]) for c in kept)


def test_rounds_follow_the_longest_chain(spark, monkeypatch):
    """Many candidates in few places end after few rounds, whatever their number."""
    from ridespark.operators import selection as module

    rounds = []
    ahead = module._alone_ahead
    monkeypatch.setattr(module, "_alone_ahead", lambda *a: rounds.append(1) or ahead(*a))
    rng = random.Random(3)
    cands = [cand(60.0 * place, 60.0 * place + rng.uniform(20, 25), rng.random(), order=i) for i, place in enumerate(list(range(40)) * 30)]
    got = choose(spark, cands, head=1)
    assert len(got) == 40 and len(rounds) <= 6


def test_a_shifted_grid_is_used_or_reported(spark):
    """Samples of a request whose recording shifts: near a step they are used, between steps they are counted."""
    times = [0.5 * i for i in range(1, 11)] + [0.5 * i + 0.1 for i in range(11, 21)] + [0.5 * i + 0.25 for i in range(21, 31)] + [15.6, 15.55]
    samples = spark.createDataFrame([(1, t, 1.0) for t in times], "video_id long, t double, flow_u double")
    clips = spark.createDataFrame([(0, 1, 0.0, 100.0, False, 1), (0, 1, 0.0, 4.0, False, 2), (0, 1, 0.0, 4.0, True, 3)], CLIP)
    used = edits.samples_of_requests(clips, samples).where("annotation_order = 1").orderBy("sample_idx").collect()
    assert [r.sample_idx for r in used] == [*range(20), 30] and used[-1].t == 15.55
    report = edits.left_out_samples(clips, samples).collect()
    assert [(r.annotation_order, r.inside, r.used) for r in report] == [(1, 32, 21)]


def test_videos_without_a_manifest_row_stay(spark):
    w = windows_of(spark, [(0, 2), (2, 4)], [0.5, 2.0]).unionByName(windows_of(spark, [(0, 2)], [9.0], video=7))
    manifest = spark.createDataFrame([(0, "g")], "video_id long, group_id string")
    rows_, summary = ranking.score_report(w, manifest)
    assert sorted((r.rank_global, r.video_id, r.group_id) for r in rows_.collect()) == [(1, 7, None), (2, 0, "g"), (3, 0, "g")]
    assert summary.count() == 2
    assert [tuple(r) for r in ranking.unlisted(w, manifest).collect()] == [(7, 1, "error", "not_in_manifest")]


def test_timeline(spark):
    chosen = spark.createDataFrame([cand(5, 9, 0.9, video=1, order=1), cand(0, 4, 0.5, video=2, order=3)], CAND)
    fixed = spark.createDataFrame([(0, 1, 1.0, 3.0, True, 2)], CLIP)
    out = timeline.assemble_timeline(chosen, fixed).orderBy("position").collect()
    assert [(r.video_id, r.mandatory, r.output_start, r.output_end) for r in out] == [(1, False, 0, 4), (1, True, 4, 6), (2, False, 6, 10)]


EVENTS = [("beat", t) for t in (1.0, 2.0, 3.0)] + [("measure", t) for t in (1.0, 3.0)] + [("onset", 0.8), ("onset", 2.2), ("bass", 0.6), ("bass", 2.4)]


@pytest.mark.parametrize(
    "mode,t,want",
    [("off", 1.4, 1.4), ("beat", 1.4, 1.0), ("beat", 1.5, 1.0), ("measure", 2.2, 3.0), ("forward-beat", 1.01, 2.0),
     ("forward-beat", 3.1, 3.1), ("forward-beat", 2.0, 2.0), ("onset", 2.0, 2.2), ("bass", 2.0, 2.4), ("combined", 5.0, 5.0)],
)
def test_snap(spark, mode, t, want):
    ev = spark.createDataFrame([(1, k, x) for k, x in EVENTS], "track_id long, kind string, t double")
    p = spark.createDataFrame([(1, t)], "track_id long, t double")
    assert timeline.snap_times(p, ev, mode=mode, width=1.0).first().snapped == want
    with pytest.raises(ValueError):
        timeline.snap_times(p, ev, mode="waltz")


def sync(spark, clips, duration, events=EVENTS, **kw):
    rows = spark.createDataFrame([(0, 1, float(a), float(b), m, i) for i, (a, b, m) in enumerate(clips)], "edit_id long, video_id long, source_start double, source_end double, mandatory boolean, line long")
    ev = spark.createDataFrame([(1, k, x) for k, x in events], "track_id long, kind string, t double")
    tr = spark.createDataFrame([(1, float(duration))], "track_id long, duration double")
    ed = spark.createDataFrame([(0, 1)], "edit_id long, track_id long")
    out = timeline.synchronize(timeline.place_clips(rows), ev, tr, ed, mode="beat", **kw).orderBy("position")
    return [(r.source_start, r.source_end, r.output_start) for r in out.collect()]


def test_sync(spark):
    assert sync(spark, [(1.1, 2.9, False), (0.4, 0.7, True)], 10) == [(1, 3, 0), (0.4, 0.7, 2)]
    assert sync(spark, [(1.1, 1.2, False)], 10) == [(1.1, 1.2, 0)]  # would become empty
    assert sync(spark, [(1.1, 2.9, False)], 10, max_synced=1.5) == [(1.1, 2.9, 0)]
    assert sync(spark, [(1.1, 2.9, False)], 1.9) == [(1.1, 2.9, 0)]  # would outgrow the music
    assert sync(spark, [(1.1, 2.9, False)], 1.0) == [(1, 3, 0)]  # did not fit before either


def test_music_grids(spark, rows):
    ev = spark.createDataFrame([(1, "beat", 0.5 * i) for i in range(9)] + [(1, "onset", 0.5004), (1, "onset", 9.0)], "track_id long, kind string, t double")
    tr = spark.createDataFrame([(1, 4.0)], "track_id long, duration double")
    assert rows(music.measure_grid(ev, width=1.0), "t") == [(0.0,), (2.0,), (4.0,)]
    assert [t for (t,) in rows(music.combined_grid(ev, tr), "t")] == [0.5 * i for i in range(9)]


def test_ranks_and_report(spark):
    w = windows_of(spark, [(0, 4), (2, 6), (4, 8)], [0.5, -1.0, 2.0])
    m = spark.createDataFrame([(0, "g")], "video_id long, group_id string")
    rows_, summary = ranking.score_report(w, m)
    first = rows_.orderBy("rank_global").first()
    assert first.score == 2.0 and first.rank_in_video == 1 and first.score_range == 3.0
    s = summary.first()
    assert (s.best_window_index, s.score_median, s.window_count) == (2, 0.5, 3)


def test_pareto(spark):
    t = spark.createDataFrame([("s", 0, 0.9, 0.5), ("s", 1, 0.8, 0.1), ("s", 2, 0.7, 0.2), ("s", 3, 0.9, 0.6), ("s", 4, 0.8, 0.1)], "study string, number int, value_0 double, value_1 double")
    assert sorted(r.number for r in stats.pareto_trials(t).collect()) == [0, 1, 4]
    c = stats.study_choices(t).first()
    assert (c.closest_to_ideal, c.largest_gap, c.highest_gain) == (1, 1, 0)


def test_correlations_with_gaps_and_constants(spark):
    data = [(0, i, float(i), float(i * i), 3.0, float("nan") if i == 2 else float(-i)) for i in range(6)]
    df = spark.createDataFrame(data, "video_id long, sample_idx int, a double, b double, c double, d double")
    t = {(r.signal_a, r.signal_b): r for r in stats.correlation_table(df, ["a", "b", "c", "d"], ids=["sample_idx"]).collect()}
    assert t["a", "b"].spearman == pytest.approx(1.0) and t["a", "c"].pearson is None and t["a", "c"].spearman is None
    assert t["a", "d"].n == 5 and t["a", "d"].pearson == pytest.approx(-1.0) and t["a", "d"].spearman == pytest.approx(-1.0)
    m = stats.correlation_matrix(stats.pearson(df, ["a", "b"]), "pearson", ["a", "b"]).orderBy("signal").collect()
    assert m[0].a == 1.0 and m[0].b == m[1].a


def test_plan_edits_end_to_end(spark, folder):
    from ridespark import workloads

    plan = workloads._edit_plan(spark, folder)
    t = plan.timeline.orderBy("edit_id", "position").collect()
    optional = [r for r in t if not r.mandatory]
    assert optional and all(r.source_end > r.source_start for r in t)
    for a, b in zip(t, t[1:]):
        if a.edit_id == b.edit_id:
            assert b.output_start == pytest.approx(a.output_end)
    assert edits.processing_ranges(workloads._edit_requests(spark, folder)).count() > 0
    by_video = {}
    for r in plan.selected.collect():
        for s, e in by_video.get((r.edit_id, r.video_id), []):
            assert r.end_s <= s or e <= r.start_s
        by_video.setdefault((r.edit_id, r.video_id), []).append((r.start_s, r.end_s))


def test_segments_of_unprobed_videos_are_not_lost_silently(spark):
    segments = spark.createDataFrame([(1, 0.0, 5.0, 5.0), (2, 0.0, 5.0, 5.0)], "video_id int, start_s double, end_s double, duration double")
    videos = spark.createDataFrame([(1, 6.0), (3, None)], "video_id int, duration double")
    with pytest.raises(Exception, match="no known length"):
        selection.pad_and_clamp(segments, videos).collect()
    kept = selection.pad_and_clamp(segments, videos, strict=False).collect()
    assert [(r.video_id, r.end_s) for r in kept] == [(1, 6.0)]
    assert [r.video_id for r in selection.unprobed(segments, videos).collect()] == [2]
