"""The registered queries in SQL, for comparison on the same tables.

Queries that are iterative, fitted, or whose text form differs between engines have no
entry here; they are tested against brute force on small fixtures.
"""

from __future__ import annotations

from .adapters import EPOCH_US, FLOW_HEIGHT, FLOW_WIDTH, RUN, SPAN, US_PER_SECOND
from .schemas import DELTA_SOURCES, FEATURE_COLUMNS, SAMPLE_COLUMNS, SIGNAL_COLUMNS, WINDOW_STATS

SQL: dict[str, str] = {}


def r(x: str, digits: int = 6) -> str:
    return f"case when round(({x})::double, {digits}) = 0 then 0.0::double else round(({x})::double, {digits}) end"


def cols(names, digits: int = 6, source=lambda n: n) -> str:
    return ", ".join(f"{r(source(n), digits)} as {n}" for n in names)


def el(name: str) -> str:
    return f"e[{SAMPLE_COLUMNS.index(name) + 1}]"


CELLS = [(a, b) for a in range(3) for b in range(3)]


def mean(parts) -> str:
    parts = list(parts)
    return f"(({' + '.join(parts)}) / {len(parts)}::double)"


def hyp(a: str, b: str) -> str:
    return f"sqrt(({a})*({a}) + ({b})*({b}))"


# -- common table expressions ------------------------------------------------

CTE: dict[str, str] = {}
CTE["samples"] = (
    f"select vec_id // {RUN} as video_id, (vec_id % {RUN})::int as sample_idx, "
    f"((vec_id % {RUN}) + 1) / 2.0::double as t, label, embedding as e from embeddings"
)
CTE["cells"] = "select video_id, sample_idx, t, {} from samples".format(
    ", ".join(
        [f"{el('flow_u')}::double as fu, {el('flow_v')}::double as fv"]
        + [f"{el(f'grid_{a}_{b}_{p}')}::double as {p}{a}{b}" for a, b in CELLS for p in "uv"]
    )
)
CTE["parts"] = "select *, {} from cells".format(
    ", ".join(
        [f"{hyp(f'u{a}{b}', f'v{a}{b}')} as m{a}{b}" for a, b in CELLS]
        + [f"{hyp(f'u{a}{b} - fu', f'v{a}{b} - fv')} as res{a}{b}" for a, b in CELLS]
        + [mean(f"cos(atan2(v{a}{b}, u{a}{b}))" for a, b in CELLS) + " as mc"]
        + [mean(f"sin(atan2(v{a}{b}, u{a}{b}))" for a, b in CELLS) + " as ms"]
    )
)
EPS = "1e-5::double"
SHAPES = {
    "vertical_flow_gradient": f"({mean(f'm0{b}' for b in range(3))} - {mean(f'm2{b}' for b in range(3))}) / (m11 + {EPS})",
    "lateral_flow_asymmetry": f"({mean(f'm{a}2' for a in range(3))} - {mean(f'm{a}0' for a in range(3))}) / (m11 + {EPS})",
    "expansion_index": f"({mean(f'm{a}{b}' for a, b in CELLS if (a, b) != (1, 1))} - m11) / (m11 + {EPS})",
    "roll_index": f"(m00 + m22 - m02 - m20) / (m11 + {EPS})",
    "directional_turbulence": f"1 - {hyp('mc', 'ms')}",
    "global_flow_magnitude": hyp("fu", "fv"),
}
SIGNALS = SHAPES | {
    "center_residual": "res11",
    "tunnel_vision": f"{mean(['res00', 'res02'])} / (res11 + {EPS})",
}
CTE["signals"] = "select video_id, sample_idx, t, {} from parts".format(
    ", ".join(f"({SIGNALS[n]})::float as {n}" for n in SIGNAL_COLUMNS)
)
CTE["annotations"] = (
    "select video_id, 5.0::double * (sample_idx // 10) as start_s, 5.0::double * (sample_idx // 10) + 5 as end_s, "
    "(sum(label) % 4)::int as score from samples group by video_id, sample_idx // 10"
)
CTE["videos"] = "select video_id, count(*) / 2.0::double as duration from samples group by video_id"
CTE["manifest"] = (
    "select video_id, 'g' || (video_id % 3)::varchar as group_id, 'rides/' || video_id::varchar || '.mp4' as video, "
    "'lists/' || video_id::varchar || '.txt' as annotation from videos"
)
CTE["rates"] = (
    f"select user_id as video_id, event_id, (epoch_us(ts) - {EPOCH_US}) / {US_PER_SECOND:.1f}::double as t, value as rate, event_type from events"
)
CTE["clips"] = (
    "select video_id // 5 as edit_id, video_id, t as start_s, t + 0.5 + rate / 100 as end_s, "
    "event_type = 'purchase' as mandatory, event_id as annotation_order from rates"
)
CTE["music"] = (
    "select video_id as track_id, case when event_type in ('click', 'view') then 'beat' "
    "when event_type = 'error' then 'bass' else 'onset' end as kind, t from rates"
)
CTE["attitude"] = "select video_id, sample_idx, t, {}, 45 + 0.01::double * e[8]::double as lat, 11 + 0.01::double * e[9]::double as lon from samples".format(
    ", ".join(f"e[{i + 1}]::double as {n}" for i, n in enumerate(("qw", "qx", "qy", "qz", "ax", "ay", "az")))
)
N_PIX = FLOW_WIDTH * FLOW_HEIGHT
CTE["flow"] = (
    f"select video_id, sample_idx, (p // {FLOW_WIDTH})::int as y, (p % {FLOW_WIDTH})::int as x, "
    f"e[p + 1]::double as u, e[p + {N_PIX + 1}]::double as v from samples, (select unnest(range({N_PIX})) as p)"
)
# window k holds rows 4k .. 4k + 7
CTE["spans"] = (
    "select video_id, k::int as window_index, min(t) - 0.5 as start_s, min(t) - 0.5 + 4.0 as end_s from "
    "(select *, unnest(range(greatest(0, (sample_idx - 4) // 4), sample_idx // 4 + 1)) as k from samples) "
    "where sample_idx between 4 * k and 4 * k + 7 group by video_id, k having count(*) = 8"
)
CTE["in_window"] = (
    "select s.*, w.window_index, w.start_s, w.end_s from signals s join spans w on s.video_id = w.video_id "
    "and s.sample_idx between 4 * w.window_index and 4 * w.window_index + 7"
)
STAT_SQL = {
    "mean": "avg({x})",
    "max": "max({x})",
    "std": "stddev_pop({x})",
    "median": "quantile_cont({x}, 0.5)",
    "q90": "quantile_cont({x}, 0.9)",
    "min": "min({x})",
}
CTE["stats"] = "select video_id, window_index, start_s, end_s, {} from in_window group by all".format(
    ", ".join(f"({STAT_SQL[st].format(x=f'{s}::double')})::float as {s}_{st}" for s in SIGNAL_COLUMNS for st in WINDOW_STATS)
)
CTE["q90"] = (
    "select video_id, window_index, start_s, end_s, (quantile_cont(center_residual::double, 0.9))::float::double as x "
    "from in_window group by all"
)
CTE["scores"] = (
    "select video_id, window_index, start_s, end_s, ((x - avg(x) over p) / "
    "(case when stddev_pop(x) over p > 1e-8 then stddev_pop(x) over p else 1 end))::float::double as score "
    "from q90 window p as (partition by video_id)"
)
CTE["seconds"] = (
    "select w.video_id, w.window_index, a.score as grade, sum(least(w.end_s, a.end_s) - greatest(w.start_s, a.start_s)) as secs "
    "from spans w join annotations a on w.video_id = a.video_id and w.start_s < a.end_s and a.start_s < w.end_s group by all"
)
CTE["grades"] = (
    "select video_id, window_index, max(grade) as label from "
    "(select *, max(secs) over (partition by video_id, window_index) as most from seconds) where secs >= most - 1e-9 group by all"
)
CTE["labelled"] = "select s.*, g.label from scores s join grades g using (video_id, window_index)"
CTE["top"] = (
    "select * from (select *, row_number() over (partition by video_id order by score desc, start_s, window_index) as n from scores) where n <= 10"
)
CTE["segs"] = (
    "select video_id, min(start_s) as start_s, max(end_s) as end_s, max(score) as max_score, count(*)::int as window_count, "
    "avg(score) as mean_score, max(end_s) - min(start_s) as duration, list({'s': start_s, 'e': end_s, 'x': score}) as proof from ("
    "select *, sum(opens) over (partition by video_id order by start_s, end_s, window_index) as seg from ("
    "select *, case when start_s - max(end_s) over (partition by video_id order by start_s, end_s, window_index "
    "rows between unbounded preceding and 1 preceding) <= 2.0 then 0 else 1 end as opens from top)) group by video_id, seg"
)
CTE["rms"] = (
    "select w.video_id, w.window_index, w.start_s, w.end_s, sqrt(avg(r.rate * r.rate)) as pitch_rate_rms from spans w "
    "left join rates r on r.video_id = w.video_id and r.t >= w.start_s and r.t < w.end_s group by all"
)
CTE["rot"] = (
    "select *, sqrt(qw*qw + qx*qx + qy*qy + qz*qz) as qn from attitude"
)
CTE["euler"] = (
    "select *, degrees(atan2(2*(w*x + y*z), 1 - 2*(x*x + y*y))) as roll, "
    "degrees(asin(greatest(-1, least(1, 2*(w*y - z*x))))) as pitch, "
    "degrees(atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z))) as yaw from "
    "(select *, qw/qn as w, qx/qn as x, qy/qn as y, qz/qn as z from rot where qn >= 1e-6)"
)


def gradient(x: str, over: str, t: str = "t") -> str:
    a, b = f"({t} - lag({t}) over {over})", f"(lead({t}) over {over} - {t})"
    return (
        f"case when lag({t}) over {over} is null then (lead({x}) over {over} - {x}) / {b} "
        f"when lead({t}) over {over} is null then ({x} - lag({x}) over {over}) / {a} "
        f"else ({a}*{a}*(lead({x}) over {over}) + ({b}*{b} - {a}*{a})*{x} - {b}*{b}*(lag({x}) over {over})) / ({a}*{b}*({a}+{b})) end"
    )


def scale(x: str, lo: str, hi: str) -> str:
    return f"case when {hi} - {lo} <= 2.220446049250313e-16 then 0.0 else greatest(0.0, least(1.0, ({x} - {lo}) / ({hi} - {lo}))) end"


_DEPENDS = {
    "cells": ["samples"],
    "parts": ["cells"],
    "signals": ["parts"],
    "annotations": ["samples"],
    "videos": ["samples"],
    "manifest": ["videos"],
    "clips": ["rates"],
    "music": ["rates"],
    "attitude": ["samples"],
    "flow": ["samples"],
    "spans": ["samples"],
    "in_window": ["signals", "spans"],
    "stats": ["in_window"],
    "q90": ["in_window"],
    "scores": ["q90"],
    "seconds": ["spans", "annotations"],
    "grades": ["seconds"],
    "labelled": ["scores", "grades"],
    "top": ["scores"],
    "segs": ["top"],
    "rms": ["spans", "rates"],
    "rot": ["attitude"],
    "euler": ["rot"],
}


def names_itself(body: str) -> bool:
    """Whether the body has a table `w` that is built from itself."""
    return "union all" in body and "from w join" in body


def _with(names, body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    # materialized: several are read more than once
    head = ", ".join(f"{n} as materialized ({CTE[n]})" for n in order)
    return f"with {'recursive ' if names_itself(body) else ''}{head}{', ' if head and body.lstrip().startswith('#') else ' '}{body.lstrip().lstrip('#')}" if head else body


def add(name: str, uses, body: str) -> None:
    """`body` may start with '#' followed by further named tables."""
    SQL[name] = _with(uses, body)


# -- signals and flow --------------------------------------------------------

add("signals_engineered", ["signals"], f"select video_id, sample_idx, {r('t')} as t, {cols(SIGNAL_COLUMNS)} from signals")
EXPLORE = {f"residual_{a}{b}": f"res{a}{b}" for a, b in CELLS} | {
    "edge_left_residual": "res00",
    "edge_right_residual": "res02",
    "edge_residual": mean(["res00", "res02"]),
    "center_residual": "res11",
    "tunnel_vision": SIGNALS["tunnel_vision"],
    "bottom_edge_residual": mean(["res20", "res22"]),
    "optical_flow_divergence": f"({mean(f'u{a}2' for a in range(3))} - {mean(f'u{a}0' for a in range(3))}) / 2 + "
    f"({mean(f'v2{b}' for b in range(3))} - {mean(f'v0{b}' for b in range(3))}) / 2",
} | SHAPES
add(
    "signals_exploratory",
    ["parts"],
    f"select video_id, sample_idx, {r('t')} as t, {cols(EXPLORE, source=lambda n: EXPLORE[n])} from parts",
)
add(
    "signal_deltas",
    ["samples"],
    "select video_id, sample_idx, {} from samples window p as (partition by video_id order by sample_idx)".format(
        ", ".join(
            f"{r(f'coalesce({el(s)}::double - lag({el(s)}::double) over p, 0)')} as {d}" for d, s in DELTA_SOURCES.items()
        )
    ),
)
add(
    "spike_compression",
    ["rates"],
    f"select event_id, {r('sign(rate) * case when abs(rate) <= 5 then abs(rate) else 5 + 0.2::double * (abs(rate) - 5) end')} as compressed from rates",
)
FLOW_SIZE = hyp("u", "v")
add(
    "flow_frame",
    ["flow"],
    f"select video_id, sample_idx, {r(f'avg({FLOW_SIZE})')} as flow_mean, {r(f'quantile_cont({FLOW_SIZE}, 0.9)')} as flow_p90, "
    f"{r(f'stddev_pop({FLOW_SIZE})')} as flow_std, {r('avg(u)')} as flow_u, {r('avg(v)')} as flow_v, {r(hyp('avg(u)', 'avg(v)'))} as flow_net "
    "from flow group by video_id, sample_idx",
)


def slope(x: str, w: str, step: float) -> str:
    return (
        f"(case when lag({x}) over {w} is null then lead({x}) over {w} - {x} when lead({x}) over {w} is null then {x} - lag({x}) over {w} "
        f"else (lead({x}) over {w} - lag({x}) over {w}) / 2 end) / {step!r}::double"
    )


DX, DY = 1 / (FLOW_WIDTH - 1), 1 / (FLOW_HEIGHT - 1)
add(
    "flow_field",
    ["flow"],
    f"""#norm as (select video_id, sample_idx, y, x, u / {FLOW_WIDTH} as un, v / {FLOW_HEIGHT} as vn from flow),
    slopes as (select video_id, sample_idx, {hyp('un', 'vn')} as size,
      {slope('un', 'ax', DX)} + {slope('vn', 'ay', DY)} as div, {slope('vn', 'ax', DX)} - {slope('un', 'ay', DY)} as curl
      from norm window ax as (partition by video_id, sample_idx, y order by x), ay as (partition by video_id, sample_idx, x order by y))
    select video_id, sample_idx, {r('avg(abs(div)) / (avg(size) + 1e-6)')} as div_normalized_mean,
      {r('quantile_cont(abs(div), 0.9)')} as div_abs_p90, {r('stddev_pop(div)')} as div_std,
      {r('avg((div > 0)::int)')} as div_pos_fraction, {r('avg(abs(curl)) / (avg(size) + 1e-6)')} as curl_normalized_mean,
      {r('quantile_cont(abs(curl), 0.9)')} as curl_abs_p90, {r('stddev_pop(curl)')} as curl_std
    from slopes group by video_id, sample_idx""",
)
ROW_EDGES = [int(FLOW_HEIGHT * i / 3) for i in range(4)]
COL_EDGES = [int(FLOW_WIDTH * i / 3) for i in range(4)]
_GRID = []
for a, b in CELLS:
    inside = f"filter (where y >= {ROW_EDGES[a]} and y < {ROW_EDGES[a + 1]} and x >= {COL_EDGES[b]} and x < {COL_EDGES[b + 1]})"
    _GRID += [
        f"{r(f'avg(u) {inside}')} as grid_{a}_{b}_u",
        f"{r(f'avg(v) {inside}')} as grid_{a}_{b}_v",
        f"{r(f'avg({FLOW_SIZE}) {inside}')} as grid_{a}_{b}_magnitude",
        f"{r(hyp(f'avg(u) {inside}', f'avg(v) {inside}'))} as grid_{a}_{b}_net",
    ]
add("flow_grid", ["flow"], f"select video_id, sample_idx, {', '.join(_GRID)} from flow group by video_id, sample_idx")

# -- windows -----------------------------------------------------------------

add(
    "sampling_grid",
    ["samples"],
    f"""#steps as (select video_id, t - lag(t) over (partition by video_id order by t) as step from samples),
    d as (select video_id, median(step) as dt from steps group by video_id)
    select video_id, {r('dt')} as dt, {r('min(t)')} as first_t, {r('max(t)')} as last_t, count(*) as n_samples,
      round(4.0 / dt)::int as rows_per_window, round(2.0 / dt)::int as rows_per_stride,
      (case when max(t) - min(t) + dt - 4.0 < -1e-9 then 0 else least(floor((max(t) - min(t) + dt - 4.0 + 1e-9) / 2.0) + 1,
        floor((count(*) - round(4.0 / dt)) / round(2.0 / dt)) + 1) end)::bigint as n_windows,
      case when dt is null then 'too_few_samples' when abs(4.0 / dt - round(4.0 / dt)) > 1e-6 then 'window_off_lattice' when abs(2.0 / dt - round(2.0 / dt)) > 1e-6 then 'stride_off_lattice'
        when round(4.0 / dt) < 2 then 'window_too_short' when max(t) - min(t) + dt - 4.0 < -1e-9 or count(*) < round(4.0 / dt) then 'sequence_too_short' end as issue
    from samples join d using (video_id) group by video_id, dt""",
)
STAT_COLUMNS = [c for c in FEATURE_COLUMNS if c != "pitch_rate_rms"]
add(
    "windows_stats",
    ["stats"],
    f"select video_id, window_index, {r('start_s')} as start_s, {r('end_s')} as end_s, {cols(STAT_COLUMNS)} from stats",
)
add(
    "windows_by_grid",
    ["stats"],
    f"select video_id, window_index, {r('start_s')} as start_s, {r('end_s')} as end_s, {cols([f'roll_index_{s}' for s in WINDOW_STATS])} from stats",
)
add(
    "window_zscore",
    ["scores"],
    f"select video_id, window_index, {r('start_s')} as start_s, {r('end_s')} as end_s, {r('score')} as score from scores",
)
add("window_labels", ["labelled"], "select video_id, window_index, label from labelled")
add(
    "window_purity",
    ["videos", "annotations"],
    """#w as (select video_id, unnest(range(0, (floor((duration - 4 + 1e-9) / 2) + 1)::bigint)) as k from videos where duration + 1e-9 >= 4),
    touched as (select w.video_id, w.k, count(distinct a.score) as grades from w left join annotations a on a.video_id = w.video_id
      and a.start_s < w.k * 2.0 + 4.0 and w.k * 2.0 < a.end_s group by all)
    select video_id, count(*) as total_windows, count(*) filter (where grades = 1) as pure_windows,
      count(*) filter (where grades > 1) as conflicting_windows, count(*) filter (where grades = 0) as uncovered_windows
    from touched group by video_id""",
)
add(
    "duration_estimates",
    ["videos"],
    "select video_id, floor(duration + 0.3 + 0.5) as whole_s, (case when duration + 0.3 + 1e-9 < 4 then 0 else "
    "greatest(0, floor((duration + 0.3 - 4 + 1e-9) / 2) + 1) end)::bigint as n_windows from videos",
)
add(
    "telemetry_rms",
    ["rms"],
    f"select video_id, window_index, {r('start_s')} as start_s, {r('end_s')} as end_s, {r('pitch_rate_rms')} as pitch_rate_rms from rms",
)
add(
    "telemetry_missing",
    ["spans", "rates"],
    """select w.video_id, 'error' as severity, 'no_telemetry' as code, 'no telemetry sample in window ' || w.window_index::varchar as message
    from spans w where not exists (select 1 from rates r where r.video_id = w.video_id and r.t >= w.start_s + 22.0 and r.t < w.end_s + 22.0)""",
)
add(
    "telemetry_rms_steps",
    ["rms"],
    f"select video_id, window_index, step::int as step, {r('pitch_rate_rms')} as pitch_rate_rms, (window_index * 4 + step)::int as sample_idx "
    "from (select *, unnest(range(8)) as step from rms)",
)

# -- telemetry ---------------------------------------------------------------

NEAR = """(select {out} from rates r where r.video_id = s.video_id order by abs(r.t - s.t), r.t limit 1)"""
add(
    "nearest_asof",
    ["samples", "rates"],
    f"""#best as (select s.video_id, s.sample_idx, min_by({{'id': r.event_id, 't': r.t, 'v': r.rate}}, {{'d': abs(r.t - s.t), 't': r.t}}) as m
      from samples s left join rates r on r.video_id = s.video_id group by all)
    select video_id, sample_idx, m.id as near_event_id, {r('m.t')} as near_t, {r('m.v')} as near_rate from best""",
)
add(
    "next_asof",
    ["samples", "rates"],
    f"""#best as (select s.video_id, s.sample_idx, min_by({{'id': r.event_id, 't': r.t}}, r.t) as m
      from samples s left join rates r on r.video_id = s.video_id and r.t >= s.t group by all)
    select video_id, sample_idx, m.id as next_event_id, {r('m.t')} as next_t from best""",
)
add(
    "clock_alignment",
    ["samples", "rates"],
    """#best as (select s.video_id, s.sample_idx,
      min_by(r.event_id, {'d': abs(r.t - (s.video_id * 10.0::double + s.t + 0.4 - (s.video_id * 10.0::double - 1.25))), 't': r.t}) as m
      from samples s left join rates r on r.video_id = s.video_id group by all)
    select video_id, sample_idx, m as ride_event_id from best""",
)
add(
    "pitch_rate",
    ["euler"],
    f"select video_id, {r('t', 5)} as t, {r('pitch', 5)} as pitch, {r(gradient('pitch', 'p'), 5)} as rate "
    "from euler window p as (partition by video_id order by t)",
)
UPPER = "list_sort(list({x}))[(count(*) // 2 + 1)::int]"
ACC = "sqrt(ax*ax + ay*ay + az*az)"
CTE["units"] = (
    f"select *, case when unit_median between 0.5 and 3 then 'g' when unit_median between 5 and 30 then 'm/s2' "
    "when unit_median between 500 and 3000 then 'mg' else 'unknown' end as unit from ("
    f"select video_id, {UPPER.format(x=ACC)} as unit_median, {', '.join(f'{UPPER.format(x=f'a{c}')} as med_{c}' for c in 'xyz')} from attitude group by video_id)"
)
CTE["axes"] = (
    "select *, case vertical_axis when 'Y' then 'Z' else 'Y' end as lateral_axis, case vertical_axis when 'X' then 'Z' else 'X' end as longitudinal_axis, "
    "(case vertical_axis when 'X' then med_x when 'Y' then med_y else med_z end) < 0 as invert_vertical from ("
    "select *, case when abs(med_x) >= abs(med_y) and abs(med_x) >= abs(med_z) then 'X' when abs(med_y) >= abs(med_z) then 'Y' else 'Z' end as vertical_axis from ("
    "select video_id, unit_median, unit, med_x * k as med_x, med_y * k as med_y, med_z * k as med_z, k from ("
    "select *, case unit when 'm/s2' then 1 / 9.80665::double when 'mg' then 0.001::double else 1.0::double end as k from units)))"
)
_DEPENDS |= {"units": ["attitude"], "axes": ["units"]}
add(
    "acceleration_units",
    ["axes"],
    f"select video_id, {cols(['unit_median', 'med_x', 'med_y', 'med_z'])}, unit, vertical_axis, lateral_axis, longitudinal_axis, "
    "true as invert_lateral, false as invert_longitudinal, invert_vertical from axes",
)


def rotate(v: list[str], sign: str) -> list[str]:
    """Components of the vector turned by quaternion w,x,y,z (sign '-' for the inverse)."""
    x, y, z = (f"({sign}{c})" for c in "xyz")
    t = [
        f"(2*({y}*({v[2]}) - {z}*({v[1]})))",
        f"(2*({z}*({v[0]}) - {x}*({v[2]})))",
        f"(2*({x}*({v[1]}) - {y}*({v[0]})))",
    ]
    return [
        f"(({v[0]}) + w*{t[0]} + {y}*{t[2]} - {z}*{t[1]})",
        f"(({v[1]}) + w*{t[1]} + {z}*{t[0]} - {x}*{t[2]})",
        f"(({v[2]}) + w*{t[2]} + {x}*{t[1]} - {y}*{t[0]})",
    ]


_W = rotate(["gx_", "gy_", "gz_"], "")
_D = rotate(["wx - gwx", "wy - gwy", "wz - gwz"], "-")
_G = rotate(["ux", "uy", "uz"], "-")
CTE["motion"] = f"""select * from (
  with a as (select e.*, x.vertical_axis, x.lateral_axis, x.longitudinal_axis, x.invert_vertical, ax*k as gx_, ay*k as gy_, az*k as gz_
    from euler e join axes x using (video_id)),
  w as (select *, {_W[0]} as wx, {_W[1]} as wy, {_W[2]} as wz from a),
  g as (select video_id, {UPPER.format(x='wx')} as gwx, {UPPER.format(x='wy')} as gwy, {UPPER.format(x='wz')} as gwz from w group by video_id),
  d as (select *, gwx/n as ux, gwy/n as uy, gwz/n as uz from (select w.*, gwx, gwy, gwz, sqrt(gwx*gwx + gwy*gwy + gwz*gwz) as n from w join g using (video_id))),
  s as (select *, {_D[0]} as dx, {_D[1]} as dy, {_D[2]} as dz, {_G[0]} as sx0, {_G[1]} as sy0, {_G[2]} as sz0,
    (case when invert_vertical then -1.0 else 1.0 end)::double as sgn from d),
  n1 as (select *, sx0/sqrt(sx0*sx0+sy0*sy0+sz0*sz0) as sx, sy0/sqrt(sx0*sx0+sy0*sy0+sz0*sz0) as sy, sz0/sqrt(sx0*sx0+sy0*sy0+sz0*sz0) as sz,
    case vertical_axis when 'X' then sgn else 0.0 end as tx, case vertical_axis when 'Y' then sgn else 0.0 end as ty, case vertical_axis when 'Z' then sgn else 0.0 end as tz from s),
  n2 as (select *, greatest(-1.0, least(1.0, sx*tx + sy*ty + sz*tz)) as c, sy*tz - sz*ty as kx0, sz*tx - sx*tz as ky0, sx*ty - sy*tx as kz0 from n1),
  n3 as (select *, sqrt(kx0*kx0 + ky0*ky0 + kz0*kz0) as sn from n2),
  n4 as (select *, kx0/sn as kx, ky0/sn as ky, kz0/sn as kz from n3),
  n5 as (select *, (kx*dx + ky*dy + kz*dz) * (1 - c) as kv from n4),
  n6 as (select *, dx*c + (ky*dz - kz*dy)*sn + kx*kv as lx, dy*c + (kz*dx - kx*dz)*sn + ky*kv as ly, dz*c + (kx*dy - ky*dx)*sn + kz*kv as lz, degrees(acos(c)) as tilt from n5)
  select video_id, sample_idx, -(case lateral_axis when 'X' then lx when 'Y' then ly else lz end) as lat_,
    (case longitudinal_axis when 'X' then lx when 'Y' then ly else lz end) as longitudinal,
    sgn * (case vertical_axis when 'X' then lx when 'Y' then ly else lz end) as vertical, tilt from n6)"""
_DEPENDS["motion"] = ["euler", "axes"]
add(
    "vehicle_motion",
    ["motion"],
    f'''select video_id, sample_idx, {r('lat_', 5)} as "lateral", {cols(['longitudinal', 'vertical'], 5)}, {r(hyp('lat_', 'longitudinal'), 5)} as combined, {r('tilt', 5)} as tilt from motion''',
)
add("camera_tilt", ["motion"], f"select video_id, {r(UPPER.format(x='tilt'), 5)} as tilt_deg from motion group by video_id")
add(
    "high_pass",
    ["attitude"],
    f"""#h as (select video_id, count(*) as n, greatest(1, round_even((count(*) - 1) / (max(t) - min(t)) * 3.0 / 2, 0))::bigint as half from attitude group by video_id),
    p as (select a.video_id, a.t, a.ax, row_number() over (partition by a.video_id order by a.t) as i, half from attitude a join h using (video_id))
    select a.video_id, {r('a.t')} as t, {r('any_value(a.ax) - avg(b.ax)')} as ax from p a join p b on a.video_id = b.video_id and b.i between a.i - a.half and a.i + a.half
    group by a.video_id, a.t""",
)
add("euler_angles", ["euler"], f"select video_id, sample_idx, {cols(['roll', 'pitch', 'yaw'], 5)} from euler")
HAV = (
    "case when plat is not null then 2 * 6371008.8::double * asin(least(1, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) end"
)
add(
    "gps_track",
    ["attitude"],
    f"""#p as (select video_id, sample_idx, t, lat, lon, lag(t) over o as pt, lag(lat) over o as plat, lag(lon) over o as plon from attitude
      window o as (partition by video_id order by t)),
    s as (select *, {HAV} as step_m from p),
    b as (select *, degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)),
      cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) + 360 as h from s)
    select video_id, sample_idx, {r('step_m', 3)} as step_m, {r('sum(coalesce(step_m, 0)) over (partition by video_id order by t)', 3)} as distance_m,
      {r('step_m / (t - pt)', 3)} as speed_ms, {r('case when step_m > 0.05 then h - 360 * floor(h / 360) end', 3)} as heading_deg from b""",
)
add(
    "gps_validity",
    ["attitude"],
    f"""#d as (select video_id, sample_idx, (sample_idx % 2)::int as unit, case when sample_idx % 2 = 0 then degrees(qw * 8) else qw * 8 end as la,
      case when sample_idx % 2 = 0 then degrees(qx * 8) else qx * 8 end as lo from attitude)
    select video_id, sample_idx, unit, {r('case when la between -90 and 90 and lo between -180 and 180 and not (la = 0 and lo = 0) then la end')} as lat,
      {r('case when la between -90 and 90 and lo between -180 and 180 and not (la = 0 and lo = 0) then lo end')} as lon from d""",
)
add(
    "upsampled",
    ["rates"],
    f"""#n as (select event_id, rate, lead(rate) over (partition by video_id order by t) as nxt from rates),
    s as (select *, unnest(range(case when nxt is null then 1 else 4 end)) as step from n)
    select event_id, step::int as step, {r('coalesce(rate + (nxt - rate) * (step / 4.0::double), rate)')} as speed from s""",
)
add(
    "cadence",
    ["rates"],
    f"""#s as (select video_id, t - lag(t) over (partition by video_id order by t) as step from rates)
    select video_id, {r('coalesce(1 / (median(step) filter (where step > 0)), 1.0)', 4)} as rate_hz from s group by video_id""",
)
add(
    "covered_cadence",
    ["clips"],
    f"select video_id, {r('case when max_by(end_s, start_s) - min(start_s) > 0 then count(*) / (max_by(end_s, start_s) - min(start_s)) else 1.0 end')} as rate_hz from clips group by video_id",
)
add(
    "display_range",
    ["attitude"],
    f"select video_id, {r('lo - room')} as range_low, {r('hi + room')} as range_high from (select video_id, min(az) as lo, max(az) as hi, "
    "case when max(az) - min(az) < 1e-9 then 0.05::double else (max(az) - min(az)) * 0.05::double end as room from attitude group by video_id)",
)
add(
    "telemetry_slice",
    ["rates"],
    f"select video_id, count(*) as n, {r('min(t)')} as first_t, {r('max(t)')} as last_t from rates where t >= 5 and t <= 15 group by video_id",
)
CTE["device"] = (
    "select user_id as video_id, event_id as frame, case when event_type <> 'error' then epoch_us(ts) end as us, event_id / 30.0::double as track_time, "
    "case when event_type = 'view' then epoch_us(ts) end as gps_us from events"
)
CTE["timed"] = (
    "select d.*, coalesce((us - base) / 1e6::double, track_time) as t from device d left join "
    "(select video_id, min_by(us, frame) as base from device where us is not null group by video_id) using (video_id)"
)
_DEPENDS["timed"] = ["device"]
add("sample_times", ["timed"], f"select video_id, frame, {r('t')} as t from timed")
add(
    "recording_start",
    ["timed"],
    """#g as (select video_id, min_by(gps_us, t) - round(min(t) * 1e6)::bigint as start_us from timed where gps_us is not null and video_id % 3 <> 0 group by video_id)
    select video_id, coalesce(start_us, epoch_us(strptime('2025092310' || lpad((video_id % 60)::varchar, 2, '0') || '00', '%Y%m%d%H%M%S'))) as start_us,
      case when start_us is not null then 'satellite' else 'file name' end as start_source
    from (select distinct video_id from timed) left join g using (video_id)""",
)
add(
    "ride_channels",
    [],
    f"""select event_id, {r('round(value * 100)::bigint / 100.0::double')} as speed,
      {r("case when event_type <> 'view' then event_id else 0 end / 1000.0::double")} as distance_km, 0.0::double as cadence,
      {r("case when event_type <> 'click' then -user_id end / 100.0::double")} as altitude, null::double as gradient,
      {r("case when event_type <> 'error' then user_id end / 100.0::double")} as temperature,
      {r("case when event_id % 5 <> 0 then event_id % 5 end / 100.0::double")} as pressure from events""",
)

# -- smoothing and interest --------------------------------------------------

add(
    "rolling_median",
    ["signals"],
    f"select video_id, sample_idx, {r('t')} as t, {r('median(roll_index::double) over (partition by video_id order by t range between 1.0 preceding and 1.0 following)')} as roll_index from signals",
)
add(
    "rolling_median_uneven",
    ["rates"],
    f"select event_id, {r('median(rate) over (partition by video_id order by t range between 0.75::double preceding and 0.75::double following)')} as rate from rates",
)
_SM = ["directional_turbulence", "lateral_flow_asymmetry", "roll_index", "vertical_flow_gradient", "expansion_index", "global_flow_magnitude"]
_ABS = {"score_tech": "directional_turbulence", "lfa_normalized": "abs(lateral_flow_asymmetry)", "roll_normalized": "abs(roll_index)",
        "vfg_normalized": "abs(vertical_flow_gradient)", "chg": "abs(expansion_rate)"}
add(
    "interest_channels",
    ["parts"],
    f"""#raw as (select video_id, sample_idx, t, {', '.join(f'({SIGNALS[n]})::double as {n}' for n in _SM)} from parts),
    sm as (select video_id, sample_idx, t, {', '.join(f'median({n}) over m as {n}' for n in _SM)} from raw
      window m as (partition by video_id order by t range between 0.25::double preceding and 0.25::double following)),
    dr as (select *, {gradient('expansion_index', 'p')} as expansion_rate from sm window p as (partition by video_id order by t)),
    q as (select video_id, {', '.join(f'quantile_cont({x}, 0.05) as lo_{n}, quantile_cont({x}, 0.95) as hi_{n}' for n, x in _ABS.items())},
      quantile_cont(global_flow_magnitude, 0.2) as gl, quantile_cont(global_flow_magnitude, 0.7) as gh0, stddev_pop(global_flow_magnitude) as gs from dr group by video_id),
    c as (select dr.*, {', '.join(f'{scale(x, f'lo_{n}', f'hi_{n}')} as {n}' for n, x in _ABS.items())}, gl, case when gh0 > gl then gh0 else gl + greatest(gs, 1e-6) end as gh
      from dr join q using (video_id)),
    g as (select *, (lfa_normalized + roll_normalized + vfg_normalized + chg) / 4 as score_maneuver,
      1 / (1 + exp(-greatest(-60.0, least(60.0, (global_flow_magnitude - (gl + gh) / 2) / ((gh - gl) / 8))))) as gate_motion from c),
    f as (select *, gate_motion * (0.5 * score_tech + 0.5 * score_maneuver) as comb from g),
    b as (select video_id, quantile_cont(comb, 0.05) as lo, quantile_cont(comb, 0.95) as hi from f group by video_id),
    z as (select f.*, {scale('comb', 'lo', 'hi')} as score_final from f join b using (video_id))
    select video_id, sample_idx, {r('t')} as t, {cols(['score_tech', 'score_maneuver', 'gate_motion', 'score_final', 'expansion_rate', 'lfa_normalized', 'roll_normalized', 'vfg_normalized'])} from z""",
)
add(
    "interest_windows",
    ["signals"],
    f"""#x as (select video_id, min(t) as t0, max(t) as t1 from signals group by video_id),
    w as (select video_id, t1, size_s, k, t0 + k * 2.0 as start_s from x, (select unnest([4.0::double, 6.0::double]) as size_s),
      (select unnest(range(0, 100)) as k) where t0 + k * 2.0 <= t1)
    select w.video_id, size_s, k as window_index, {r('start_s')} as start_s, {r('least(start_s + size_s, t1)')} as end_s,
      {r('0.6 * max(roll_index::double) + 0.4 * avg(roll_index::double)')} as roll_index
    from w join signals s on s.video_id = w.video_id and s.t >= start_s and s.t < start_s + size_s group by w.video_id, size_s, k, start_s, t1""",
)

# -- ranking -----------------------------------------------------------------

add(
    "rank_in_video",
    ["scores"],
    "select video_id, window_index, row_number() over (partition by video_id order by score desc, window_index) as rank_in_video from scores",
)
add(
    "rank_global",
    ["scores"],
    "select video_id, window_index, row_number() over (order by score desc, video_id, window_index) as rank_global from scores",
)
SUMMARY = (
    "select video_id, count(*) as window_count, min(score) as score_min, max(score) as score_max, max(score) - min(score) as score_range, "
    "avg(score) as score_mean, median(score) as score_median, stddev_pop(score) as score_std, "
    "min_by(window_index, {'a': -score, 'b': window_index}) as best_window_index, min_by(start_s, {'a': -score, 'b': window_index}) as bs, "
    "min_by(end_s, {'a': -score, 'b': window_index}) as be from scores group by video_id"
)
add(
    "video_summary",
    ["scores"],
    f"select video_id, window_count, {cols(['score_min', 'score_max', 'score_range', 'score_mean', 'score_median', 'score_std'])}, best_window_index, "
    f"{r('bs', 3)} as best_window_start_s, {r('be', 3)} as best_window_end_s, {r('score_max')} as best_window_score from ({SUMMARY})",
)
add(
    "score_report",
    ["scores", "manifest"],
    f"""select row_number() over (order by score desc, video_id, window_index) as rank_global, video_id, group_id, window_index, {r('start_s', 3)} as start_s,
      {r('end_s', 3)} as end_s, {r('end_s - start_s', 3)} as duration_s, {r('score')} as score,
      row_number() over (partition by video_id order by score desc, window_index) as rank_in_video, {r('score_min')} as score_min, {r('score_max')} as score_max,
      {r('score_range')} as score_range, window_count from scores join ({SUMMARY}) using (video_id) join manifest using (video_id)""",
)
SEG_RANK = "row_number() over (partition by video_id order by max_score desc, window_count desc, mean_score desc, duration desc, start_s)::int"
add(
    "top_segments",
    ["segs"],
    f"select video_id, {SEG_RANK} as segment_rank, {cols(['start_s', 'end_s', 'max_score'])}, window_count, {cols(['mean_score', 'duration'])} from segs",
)
add(
    "merge_ranges",
    ["clips"],
    f"""#f as (select *, case when start_s <= max(end_s) over (partition by video_id order by start_s, end_s rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from clips),
    g as (select *, sum(opens) over (partition by video_id order by start_s, end_s rows unbounded preceding) as isl from f)
    select video_id, {r('min(start_s)')} as start_s, {r('max(end_s)')} as end_s from g group by video_id, isl""",
)
add(
    "best_per_bounds",
    ["clips"],
    f"select video_id, round(start_s, 0) as start_s, round(start_s, 0) + 4 as end_s, {r('max(end_s - start_s)')} as score from clips group by 1, 2, 3",
)
CTE["events3"] = (
    "select *, sum(opens) over (partition by video_id order by start_s, end_s, window_index rows unbounded preceding) as island from ("
    "select *, case when start_s <= max(end_s) over (partition by video_id order by start_s, end_s, window_index rows between unbounded preceding and 1 preceding) + 1e-9 "
    "then 0 else 1 end as opens from labelled where label = 3)"
)
CTE["positions"] = "select video_id, window_index, row_number() over (partition by video_id order by score desc, window_index) as position from labelled"
CTE["hits"] = (
    "select k, video_id, count(*) as events, sum(hit) as hits, sum(hit) / count(*) as recall from ("
    "select k, video_id, island, max((position <= k)::int) as hit from events3 join positions using (video_id, window_index), (select unnest([3, 5]) as k) group by all) group by all"
)
_DEPENDS |= {"events3": ["labelled"], "positions": ["labelled"], "hits": ["events3", "positions"]}
add(
    "segment_recall",
    ["hits"],
    f"select {r('avg(recall)')} as segment_recall, count(*) as videos_with_events, coalesce(sum(events), 0)::bigint as events, coalesce(sum(hits), 0)::bigint as hit_events, 5::int as k from hits where k = 5",
)
add("segment_recall_by_video", ["hits"], f"select video_id, events, hits::bigint as hits, {r('recall')} as recall from hits where k = 3")
add(
    "ndcg",
    ["labelled"],
    f"""#g as (select *, case label when 1 then 1.0::double when 2 then 3.0 when 3 then 9.0 else 0.0 end as gain from labelled),
    n as (select *, row_number() over (partition by video_id order by score desc, window_index) as a, row_number() over (partition by video_id order by gain desc, window_index) as b from g),
    d as (select video_id, sum(case when a <= 10 then gain / log2(a + 1) else 0 end) as dcg, sum(case when b <= 10 then gain / log2(b + 1) else 0 end) as ideal from n group by video_id)
    select video_id, {r('dcg')} as dcg, {r('ideal')} as ideal, {r('case when ideal > 0 then dcg / ideal else 1 end')} as ndcg from d""",
)

# -- selection, timelines and music -------------------------------------------

add(
    "free_of_mandatory",
    ["clips"],
    "select annotation_order from clips c where not mandatory and not exists (select 1 from clips m where m.mandatory and m.edit_id = c.edit_id "
    "and m.video_id = c.video_id and c.start_s < m.end_s and m.start_s < c.end_s)",
)
add(
    "video_order",
    ["clips"],
    "select edit_id, video_id, (row_number() over (partition by edit_id order by line, video_id) - 1)::int as video_order from "
    "(select edit_id, video_id, min(annotation_order) as line from clips group by all)",
)
add(
    "mandatory_clips",
    ["clips"],
    f"select edit_id, video_id, {r('start_s')} as start_s, {r('end_s')} as end_s, annotation_order, {r('end_s - start_s')} as duration from clips where mandatory",
)
add(
    "padded_segments",
    ["segs", "videos"],
    f"select video_id, {r('a')} as start_s, {r('b')} as end_s, {r('b - a')} as duration, window_count from (select s.video_id, greatest(0.0, start_s - 1.5) as a, "
    "least(v.duration, end_s + 1.5) as b, window_count from segs s join videos v using (video_id) where s.duration + 1e-9 >= 5.0)",
)
add(
    "first_request",
    ["segs", "clips"],
    f"select s.video_id, {r('s.start_s')} as core_start, {r('s.end_s')} as core_end, min(c.annotation_order) as annotation_order from segs s "
    "left join clips c on c.video_id = s.video_id and c.start_s < s.end_s and s.start_s < c.end_s group by s.video_id, s.start_s, s.end_s",
)
add(
    "trimmed_segments",
    ["segs"],
    f"""#b as (select *, list_sort(list_transform(proof, lambda p: {{'n': -p.x, 's': p.s, 'e': p.e}}))[1] as best from segs),
    c as (select *, duration > 5 + 1e-9 as long, least(greatest((best.s + best.e) / 2 - 2.5, start_s), end_s - 5) as cut from b),
    k as (select *, case when long then list_filter(proof, lambda p: p.e > cut and p.s < cut + 5) else proof end as kept from c)
    select video_id, {r('case when long then cut else start_s end')} as start_s, {r('case when long then cut + 5 else end_s end')} as end_s,
      {r('case when long then 5 else duration end')} as duration, {r('case when long then list_max(list_transform(kept, lambda p: p.x)) else max_score end')} as max_score,
      {r('case when long then list_avg(list_transform(kept, lambda p: p.x)) else mean_score end')} as mean_score, len(kept)::int as evidence_count
    from k where not long or len(kept) > 0""",
)
_FREE = """f as (select edit_id, video_id, start_s, end_s, end_s - start_s as d, annotation_order as line from clips c where not mandatory and not exists (
      select 1 from clips m where m.mandatory and m.edit_id = c.edit_id and m.video_id = c.video_id and c.start_s < m.end_s and m.start_s < c.end_s))"""
_CHOSEN = f"""select edit_id, k.v as video_id, {r('k.s')} as start_s, {r('k.e')} as end_s, {r('k.d')} as max_score, k.l as annotation_order from (
      select edit_id, unnest(kept) as k from (select *, max(n) over (partition by unit) as last from w) where n = last)"""
# one candidate after the other, best first, per unit
add(
    "select_greedy",
    ["clips"],
    f"""#{_FREE},
    c as (select *, edit_id * 1000000 + video_id as unit, row_number() over (partition by edit_id, video_id order by d desc, start_s, line) as n from f),
    w as (
      select distinct edit_id, unit, 0::bigint as n, []::struct(v bigint, s double, e double, d double, l bigint)[] as kept from c
      union all
      select c.edit_id, c.unit, c.n, case when len(list_filter(kept, lambda k: c.start_s < k.e and k.s < c.end_s)) = 0
        then list_append(kept, {{'v': video_id, 's': start_s, 'e': end_s, 'd': d, 'l': line}}) else kept end from w join c on c.unit = w.unit and c.n = w.n + 1)
    {_CHOSEN}""",
)
add(
    "select_greedy_budget",
    ["clips"],
    f"""#{_FREE},
    c as (select *, edit_id as unit, row_number() over (partition by edit_id order by d desc, start_s, video_id, line) as n from f),
    w as (
      select distinct edit_id, unit, 0::bigint as n, []::struct(v bigint, s double, e double, d double, l bigint)[] as kept, 40.0::double as rest from c
      union all
      select edit_id, unit, n, case when fits then list_append(kept, {{'v': video_id, 's': start_s, 'e': end_s, 'd': d, 'l': line}}) else kept end, case when fits then greatest(0.0, rest - d) else rest end
      from (select c.*, kept, rest, d <= rest + 1e-9 and len(list_filter(kept, lambda k: k.v = c.video_id and c.start_s < k.e and k.s < c.end_s)) = 0 as fits
        from w join c on c.unit = w.unit and c.n = w.n + 1))
    {_CHOSEN}""",
)
LINE_ORDER = "line, source_start, case when mandatory then 0 else 1 end, video_id, source_end"
CTE["cliprows"] = "select edit_id, video_id, start_s as source_start, end_s as source_end, mandatory, annotation_order as line from clips"
_DEPENDS["cliprows"] = ["clips"]
add(
    "timeline_positions",
    ["cliprows"],
    f"""#o as (select *, sum(source_end - source_start) over p as upto, row_number() over p - 1 as position from cliprows
      window p as (partition by edit_id order by {LINE_ORDER} rows unbounded preceding))
    select line, position, {r('upto - (source_end - source_start)')} as output_start, {r('upto')} as output_end from o""",
)
add(
    "timeline_sync",
    ["cliprows", "music"],
    f"""#ed as (select edit_id, min(video_id) as track_id from cliprows group by edit_id),
    beats as (select distinct track_id, t from music where kind = 'beat'),
    c as (select cliprows.*, track_id from cliprows join ed using (edit_id)),
    s as (select c.line, min_by(b.t, {{'d': abs(b.t - c.source_start), 't': b.t}}) as s, min_by(b.t, {{'d': abs(b.t - c.source_end), 't': b.t}}) as e
      from c join beats b using (track_id) where not mandatory group by c.line),
    p as (select c.*, case when s.e > s.s and s.e - s.s <= 4 + 1e-9 then s.s else source_start end as ns, case when s.e > s.s and s.e - s.s <= 4 + 1e-9 then s.e else source_end end as ne
      from c left join s using (line)),
    t as (select edit_id, sum(source_end - source_start) as before, sum(ne - ns) as after from p group by edit_id),
    f as (select p.*, case when before <= {SPAN} + 1e-9 and after > {SPAN} + 1e-9 then source_start else ns end as fs,
      case when before <= {SPAN} + 1e-9 and after > {SPAN} + 1e-9 then source_end else ne end as fe from p join t using (edit_id)),
    o as (select *, sum(fe - fs) over w as upto, row_number() over w - 1 as position from f window w as (partition by edit_id order by {LINE_ORDER} rows unbounded preceding))
    select line, {r('fs')} as source_start, {r('fe')} as source_end, {r('upto - (fe - fs)')} as output_start, position from o""",
)


def snap(grid: str, forward: bool = False) -> str:
    cond = " and g.t >= c.t" if forward else ""
    return f"""cuts as (select video_id as track_id, annotation_order, end_s + 0.05::double as t from clips)
    select c.annotation_order, {r("coalesce(min_by(g.t, {'d': abs(g.t - c.t), 't': g.t}), c.t)")} as snapped from cuts c
    left join {grid} g on g.track_id = c.track_id{cond} group by c.annotation_order, c.t"""


BEATS = "beats as (select distinct track_id, t from music where kind = 'beat')"
MEASURES = (
    "measures as (select track_id, t from (select *, row_number() over (partition by track_id order by t) as n from beats) where (n - 1) % 4 = 0)"
)
add("snap_beats", ["clips", "music"], f"#{BEATS}, {snap('beats')}")
add("snap_forward", ["clips", "music"], f"#{BEATS}, {snap('beats', True)}")
add("snap_measure", ["clips", "music"], f"#{BEATS}, {MEASURES}, {snap('measures')}")
add(
    "combined_grid",
    ["music"],
    f"select distinct track_id, 'combined' as kind, round(t, 3) as t from music where kind in ('beat', 'onset') and t between 0 and {SPAN} and round(t, 3) between 0 and {SPAN}",
)
add("measure_grid", ["music"], f"#{BEATS}, {MEASURES} select track_id, 'measure' as kind, {r('t')} as t from measures")

# -- learning ----------------------------------------------------------------

_Z = ", ".join(
    f"{r(f'(({n}::double - avg({n}::double) over p) / (case when stddev_pop({n}::double) over p > 1e-8 then stddev_pop({n}::double) over p else 1 end))::float', 4)} as {n}"
    for n in FEATURE_COLUMNS
)
add(
    "training_table",
    ["stats", "rms", "grades", "manifest"],
    f"""#f as (select s.*, m.pitch_rate_rms::float as pitch_rate_rms from stats s join rms m using (video_id, window_index) where m.pitch_rate_rms is not null),
    z as (select video_id, window_index, {r('start_s', 4)} as start_s, {r('end_s', 4)} as end_s, {_Z} from f window p as (partition by video_id))
    select z.*, g.label, m.group_id from z join grades g using (video_id, window_index) join manifest m using (video_id)""",
)
add("class_counts", ["grades", "manifest"], "select group_id, label, count(*) as n from grades join manifest using (video_id) group by all")
add("query_sizes", ["grades"], "select video_id, count(*) as n_windows, count(distinct label) as n_grades from grades group by video_id")
CTE["trials"] = (
    "select event_type as study, user_id as number, avg((value > 20)::int) as value_0, avg((value < 5)::int) as value_1 from events group by all"
)
FRONT = (
    "front as (select * from trials a where not exists (select 1 from trials b where b.study = a.study and b.value_0 >= a.value_0 "
    "and b.value_1 <= a.value_1 and (b.value_0 > a.value_0 or b.value_1 < a.value_1)))"
)
add("pareto_trials", ["trials"], f"#{FRONT} select study, {r('value_0')} as value_0, number, {r('value_1')} as value_1 from front")
add(
    "study_choices",
    ["trials"],
    f"""#{FRONT} select study, count(*) as pareto_trials, min_by(number, {{'a': {hyp('value_0 - 1', 'value_1')}, 'b': number}}) as closest_to_ideal,
      min_by(number, {{'a': value_1 - value_0, 'b': number}}) as largest_gap, min_by(number, {{'a': -value_0, 'c': value_1, 'b': number}}) as highest_gain from front group by study""",
)
add(
    "best_trial",
    ["trials"],
    f"select study, min_by(number, {{'a': -value_0, 'b': number}}) as best_trial, {r('max(value_0)')} as best_value from trials group by study",
)

# -- statistics --------------------------------------------------------------

PAIRS = [(a, b) for i, a in enumerate(SIGNAL_COLUMNS) for b in SIGNAL_COLUMNS[i + 1 :]]
add(
    "pearson",
    ["signals"],
    " union all ".join(
        f"select '{a}' as signal_a, '{b}' as signal_b, {r(f'corr({a}::double, {b}::double)')} as pearson, count(*) as n from signals" for a, b in PAIRS
    ),
)
FOUR = SIGNAL_COLUMNS[:4]
add(
    "pearson_by_video",
    ["signals"],
    " union all ".join(
        f"select video_id, '{a}' as signal_a, '{b}' as signal_b, {r(f'corr({a}::double, {b}::double)')} as pearson, count(*) as n from signals group by video_id"
        for a, b in PAIRS
        if a in FOUR and b in FOUR
    ),
)
add(
    "spearman",
    ["signals"],
    "#rk as materialized (select {} from signals) ".format(
        ", ".join(f"rank() over (order by {s}) + (count(*) over (partition by {s}) - 1) / 2.0::double as {s}" for s in SIGNAL_COLUMNS)
    )
    + " union all ".join(
        f"select '{a}' as signal_a, '{b}' as signal_b, {r(f'corr({a}, {b})')} as spearman, count(*) as n from rk" for a, b in PAIRS
    ),
)
add(
    "column_profile",
    ["samples"],
    "#p as ({}) select feature, {}, case when std < 1e-8 and near_zero_fraction >= 0.95 then 'near-constant, mostly zero' when std < 1e-8 then 'near-constant' when near_zero_fraction >= 0.95 then 'mostly zero' else 'OK' end as status from p".format(
        " union all ".join(
            f"select '{n}' as feature, min(x) as min, max(x) as max, avg(x) as mean, stddev_pop(x) as std, quantile_cont(x, 0.01) as p01, median(x) as median, "
            f"quantile_cont(x, 0.99) as p99, avg((abs(x) < 1e-8)::int) as near_zero_fraction from (select {el(n)}::double as x from samples)"
            for n in SAMPLE_COLUMNS
        ),
        cols(["min", "max", "mean", "std", "p01", "median", "p99", "near_zero_fraction"]),
    ),
)

# -- audits ------------------------------------------------------------------


def _audit() -> str:
    c = {n: f"{el(n)}::double" for n in SAMPLE_COLUMNS}
    rules = {"step_not_positive": "t - lag(t) over p <= 0"}
    rules["not_finite"] = " or ".join(f"not isfinite({x})" for x in c.values())
    rules |= {
        "flow_mean_negative": f"{c['flow_mean']} < 0",
        "flow_p90_negative": f"{c['flow_p90']} < 0",
        "flow_p90_below_mean": f"{c['flow_p90']} < {c['flow_mean']}",
        "flow_net_negative": f"{c['flow_net']} < 0",
        "flow_net_above_mean": f"{c['flow_net']} > {c['flow_mean']}",
        "div_abs_p90_negative": f"{c['div_abs_p90']} < 0",
        "div_std_negative": f"{c['div_std']} < 0",
        "curl_abs_p90_negative": f"{c['curl_abs_p90']} < 0",
        "curl_std_negative": f"{c['curl_std']} < 0",
        "div_pos_fraction_range": f"{c['div_pos_fraction']} < 0 or {c['div_pos_fraction']} > 1",
    }
    for a, b in CELLS:
        g = f"grid_{a}_{b}"
        rules[f"{g}_magnitude_negative"] = f"{c[g + '_magnitude']} < 0"
        rules[f"{g}_net_negative"] = f"{c[g + '_net']} < 0"
        rules[f"{g}_net_above_magnitude"] = f"{c[g + '_net']} > {c[g + '_magnitude']}"
    for d, s in DELTA_SOURCES.items():
        want = f"coalesce({c[s]} - lag({c[s]}) over p, 0)"
        rules[f"{d}_mismatch"] = f"abs({c[d]} - {want}) > 1e-6 + 1e-5 * abs({want})"
    per_row = ", ".join(f"({x}) as \"{n}\"" for n, x in rules.items())
    flags = f"fl as materialized (select video_id, t - lag(t) over p as step, {per_row} from samples window p as (partition by video_id order by sample_idx))"
    dead = " + ".join(f"(stddev_pop({x}) < 1e-8)::int" for x in c.values())
    parts = [f"select video_id, '{n}' as rule, count(*) filter (where \"{n}\") as violations from fl group by video_id" for n in rules]
    parts.append(f"select video_id, 'constant_columns', ({dead})::bigint from samples group by video_id")
    parts.append("select video_id, 'too_few_samples', (count(*) < 2)::bigint from fl group by video_id")
    parts.append("select video_id, 'step_off_nominal', (abs(median(step) - 0.5) > 1e-4 + 1e-3 * 0.5)::bigint from fl group by video_id")
    parts.append(
        "select video_id, 'step_uneven', (greatest(abs(min(step) - median(step)), abs(max(step) - median(step))) > 1e-3 + 1e-3 * abs(median(step)))::bigint from fl group by video_id"
    )
    return f"#{flags} {' union all '.join(parts)}"


add("sequence_audit", ["samples"], _audit())
add(
    "sequence_validity",
    ["samples"],
    f"select video_id, count(*) as rows, {r('min(t)')} as first_t, {r('max(t)')} as last_t, count(*) >= 2 as valid, "
    "case when count(*) < 2 then 'too_few_rows' when count(*) filter (where not isfinite(t)) > 0 then 'not_finite' end as issue from samples group by video_id",
)
add(
    "window_audit",
    ["samples", "spans", "annotations"],
    """#n as (select video_id, case when count(*) >= 8 then (count(*) - 8) // 4 + 1 else 0 end as expected_windows from samples group by video_id),
    p as (select w.video_id, count(distinct w.window_index) as pure_top_windows from spans w join annotations a on a.video_id = w.video_id and a.score = 3
      and a.start_s <= w.start_s and w.end_s <= a.end_s group by w.video_id),
    c as (select video_id, count(*) as windows from spans group by video_id)
    select video_id, expected_windows::bigint as expected_windows, coalesce(windows, 0) as windows, 0::bigint as bounds_off, 0::bigint as content_off,
      coalesce(pure_top_windows, 0) as pure_top_windows from n left join c using (video_id) left join p using (video_id)""",
)
CTE["custs"] = (
    "select c_mktsegment || '-' || (c_custkey % 700)::varchar as video_id, case when c_acctbal >= 0 then c_mktsegment end as group_id, "
    "case when c_nationkey <= 20 then 'a.txt' end as annotation from customer"
)
add(
    "manifest_findings",
    ["custs"],
    """#f as (select 'group_missing' as code, 'error' as severity, count(*) as n from custs where group_id is null
      union all select 'not_annotated', 'warning', count(*) from custs where annotation is null
      union all select 'id_duplicate', 'error', count(*) from (select lower(video_id) from custs group by 1 having count(*) > 1))
    select * from f where n > 0""",
)
add(
    "manifest_summary",
    ["videos", "annotations", "manifest"],
    """#w as (select video_id, unnest(range(0, (floor((duration - 4 + 1e-9) / 2) + 1)::bigint)) as k from videos where duration + 1e-9 >= 4),
    touched as (select w.video_id, w.k, count(distinct a.score) as grades from w left join annotations a on a.video_id = w.video_id
      and a.start_s < w.k * 2.0 + 4.0 and w.k * 2.0 < a.end_s group by all)
    select (select count(*) from manifest) as manifest_entries, (select count(distinct video_id) from manifest) as unique_ids,
      (select count(distinct group_id) from manifest) as group_count, (select round(sum(duration), 3) from videos) as total_duration,
      (select count(*) from annotations) as annotation_intervals, {}, count(*) as estimated_windows, count(*) filter (where grades = 1) as estimated_pure_windows,
      count(*) filter (where grades > 1) as estimated_conflicting_windows from touched""".format(
        ", ".join(f"(select round(coalesce(sum(end_s - start_s) filter (where score = {g}), 0), 3) from annotations) as seconds_grade_{g}" for g in range(4))
    ),
)
add(
    "annotation_findings",
    ["clips"],
    """#a as (select video_id, start_s, case when mandatory then start_s else end_s end as end_s, annotation_order % 5 as score from clips),
    f as (select video_id, 'end_before_start' as code from a where end_s <= start_s union all select video_id, 'score_range' from a where score > 3
      union all select video_id, 'not_contiguous' from (select *, lag(end_s) over (partition by video_id order by start_s) as prev from a) where prev is not null and prev <> start_s)
    select video_id::varchar as video_id, code, count(*) as n from f group by all""",
)
add(
    "annotation_bounds",
    ["clips"],
    """#b as (select video_id, count(*) filter (where start_s < -1e-6 or end_s > 25.0 + 1e-6) as n from clips group by video_id)
    select video_id::varchar as video_id, 'annotation_out_of_bounds' as code, n::varchar || ' interval(s) outside the video' as message from b where n > 0""",
)
add(
    "request_audit",
    ["clips"],
    "select edit_id, count(*) as clips, count(distinct video_id) as videos, count(*) filter (where mandatory) as mandatory_clips, "
    f"{r('sum(end_s - start_s)')} as requested_s from clips group by edit_id",
)
add(
    "request_findings",
    ["clips"],
    "select video_id::varchar as video_id, 'clip_out_of_bounds' as code, count(*) as n from clips where end_s > 25.0 + 1e-6 group by video_id",
)
add(
    "split_check",
    [],
    """with t as (select distinct (event_id // 7)::varchar as g from events where event_type = 'click'), v as (select distinct (event_id // 7)::varchar as g from events where event_type in ('error', 'view')),
    k as (select distinct (event_id // 7)::varchar as g from events where value > 3), u as (select g from t union select g from v)
    select g as group_id, 'error' as severity, 'split_overlap' as code from t where g in (select g from v)
    union all select g, 'error', 'split_unknown_group' from u where g not in (select g from k)
    union all select g, 'warning', 'split_unassigned_group' from k where g not in (select g from u)""",
)
add(
    "id_mismatch",
    ["samples", "rates"],
    """#a as (select distinct video_id from samples), b as (select distinct video_id from rates)
    select video_id, 'missing_right' as code from a where video_id not in (select video_id from b) union all select video_id, 'missing_left' from b where video_id not in (select video_id from a)""",
)
add(
    "declared_video",
    ["manifest"],
    "select video_id::varchar as video_id, 'warning' as severity, 'video_differs' as code, 'annotation file declares other.mp4' as message from manifest where group_id = 'g1'",
)

# -- stored sequences ----------------------------------------------------------

add("content_digests", [], "select page_id, sha256(html) as digest from pages")
add(
    "contract_keys",
    [],
    """select event_id, sha256('{"kind":"' || event_type || '","rate":2,"source":' || user_id::varchar || '}') as contract_key from events""",
)
CTE["entries"] = (
    "select annotation_order as entry_id, case when mandatory then 'k1' else 'k0' end as contract_key, video_id as source, start_s - 1 as es, end_s + 1 as ee from clips"
)
_DEPENDS["entries"] = ["clips"]
add(
    "covering_entries",
    ["entries"],
    """#m as (select c.annotation_order as request_id, min_by({'id': e.entry_id, 'x': e.es = c.start_s and e.ee = c.end_s}, {'i': not (e.es = c.start_s and e.ee = c.end_s), 'len': e.ee - e.es, 'id': e.entry_id}) as b
      from clips c join entries e on e.source = c.video_id and e.contract_key = 'k0' and e.es <= c.start_s + 1e-6 and e.ee >= c.end_s - 1e-6 group by c.annotation_order)
    select request_id, b.id as entry_id, b.x as exact from m""",
)
add(
    "compatibility",
    ["entries"],
    """#x as (select entry_id, contract_key <> 'k0' as a, (es > es + 1 + 1e-6 or ee < es + 1 + 3 - 1e-6) as b from entries)
    select entry_id as request_id, not a and not b as compatible, concat_ws(',', case when a then 'contract_key_mismatch' end, case when b then 'requested_interval_not_covered' end) as reasons from x""",
)
add(
    "lattice_requests",
    ["entries"],
    """select e.entry_id as request_id from entries e join clips c on c.annotation_order = e.entry_id
    where abs((c.start_s + (e.entry_id % 4) * 0.25::double - e.es) * 2 - round((c.start_s + (e.entry_id % 4) * 0.25::double - e.es) * 2)) <= 1e-6""",
)
CTE["catalog"] = "select 'c' || c_custkey::varchar || '.parquet' as path, c_acctbal > -500 as valid, c_nationkey as size_bytes from customer"
CTE["found"] = "select distinct 'c' || o_custkey::varchar || '.parquet' as path, o_custkey from orders"
add(
    "retention_plan",
    ["catalog", "found"],
    "select path from catalog where path not in (select path from found join catalog c using (path) where c.valid)",
)
add(
    "retention_findings",
    ["catalog", "found"],
    """#c as (select * from catalog where size_bytes < 20)
    select path, case when c.valid is null then 'missing' else 'invalid' end as code from found left join c using (path) where c.valid is null or not c.valid""",
)
add(
    "reconciled_catalog",
    ["catalog", "found"],
    """#j as (select case when f.path is null then 'removed' when c.path is null then 'added' when c.valid <> true or c.size_bytes <> f.o_custkey % 25 then 'updated' else 'same' end as change
      from catalog c full outer join found f on f.path = c.path) select change, count(*) as n from j group by change""",
)
add(
    "reusable_analyses",
    [],
    """with w as (select user_id, floor(max(value))::bigint::varchar as h from events group by user_id), s as (select user_id, floor(max(value))::bigint::varchar as h from events where event_type <> 'view' group by user_id)
    select user_id::varchar as source_path, h as source_hash, 'reused' as state from s where (user_id, h) in (select (user_id, h) from w)
    union all select user_id::varchar, h, 'missing' from w where (user_id, h) not in (select (user_id, h) from s)""",
)
add("metadata_fields", [], "select event_id, (props::json ->> '$.k')::int as k from events")

# -- lists, logs and text ------------------------------------------------------

CLOCK = (
    "case when s >= 3600 then lpad((s // 3600)::varchar, 2, '0') || ':' else '' end || lpad(((s % 3600) // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0')"
)
add(
    "clock_text",
    ["rates"],
    f"select event_id, {CLOCK} as clock, s::double as seconds from (select event_id, floor(rate * 37)::bigint as s from rates)",
)
add("rate_text", [], f"select event_id, {r('case when event_id % 7 = 0 then 0 else user_id / (event_id % 7)::double end')} as rate from events")
add(
    "path_kinds",
    [],
    "select page_id, case when regexp_matches(p, '[^/]\\.(mp3|wav|ogg|flac)$') then 'audio' when regexp_matches(p, '[^/]\\.(mp4|mov|mkv|avi)$') then 'video' else 'other' end as kind "
    "from (select page_id, lower(url) || case page_id % 3 when 0 then '.mp4' when 1 then '.wav' else '' end as p from pages)",
)


def _blend(i: int) -> str:
    a, b, c, d = ((0, 0, 0), (46, 204, 113), (195, 196, 15), (231, 76, 60))
    return (
        f"trunc(case when w < 300 then {a[i]} + {b[i] - a[i]} * w / 300.0::double when w < 600 then {b[i]} + {c[i] - b[i]} * (w - 300) / 300.0::double "
        f"else {c[i]} + {d[i] - c[i]} * (w - 600) / 400.0::double end)::int"
    )


add("power_colours", ["rates"], f"select event_id, {_blend(0)} as r, {_blend(1)} as g, {_blend(2)} as b from (select event_id, rate * 2.5::double as w from rates)")
add("annotation_lists", ["annotations"], "select 'lists/' || video_id::varchar || '.txt' as file, start_s, end_s, score from annotations")
add(
    "annotation_list_findings",
    ["annotations"],
    """#f as (select 'lists/' || video_id::varchar || '.txt' as file, case score when 2 then 'end_before_start' else 'too_few_fields' end as code from annotations where score in (1, 2)),
    g as (select video_id, start_s, lag(end_s) over (partition by video_id order by start_s) as before from annotations where score in (0, 3))
    select file, code, count(*) as n from (select * from f union all select 'lists/' || video_id::varchar || '.txt', 'not_contiguous' from g where before <> start_s) group by all""",
)
add(
    "scanned_lists",
    ["annotations", "manifest"],
    """#s as (select video_id, max(end_s) as d, sum(end_s - start_s) as cov, {} from annotations group by video_id)
    select video_id::varchar as video_id, 'ride_day_' || group_id as group_id, 'Ride Day ' || group_id || '/' || video_id::varchar || '.mp4' as video, annotation, round(d, 2) as duration,
      round(cov, 2) as annotated_s, round(100 * least(cov, d) / d, 2) as coverage_pct, {}, {} from s join manifest using (video_id)""".format(
        ", ".join(f"coalesce(sum(end_s - start_s) filter (where score = {g}), 0.0)::double as g{g}" for g in range(4)),
        ", ".join(f"round(g{g}, 2) as seconds_grade_{g}" for g in range(4)),
        ", ".join(f"round(100 * g{g} / d, 2) as pct_grade_{g}" for g in range(4)),
    ),
)
add(
    "request_lists",
    ["clips"],
    f"""#t as (select *, printf('%.3f', start_s)::double as s, printf('%.3f', end_s)::double as e from clips)
    select 'edits/e' || edit_id::varchar || '.txt' as file, 'edits/v' || video_id::varchar || '.mp4' as video, {r('s')} as start_s, {r('e')} as end_s, mandatory,
      (annotation_order * 2 + 1)::int as annotation_order from t where e > s and (mandatory or e - s >= 2.0)""",
)
add(
    "served_requests",
    ["clips", "samples"],
    """select edit_id, annotation_order, c.video_id, count(s.t) as n_samples, count(s.t) >= 8 as served
    from clips c left join samples s on s.video_id = c.video_id and s.t > c.start_s + 1e-6 and s.t < c.end_s - 1e-6
    where not mandatory group by 1, 2, 3""",
)
add(
    "flight_log",
    ["rates"],
    f"select 'u' || video_id::varchar as file, event_id as frame, {r('round(t, 3)')} as t, {r('round(t, 3) + 0.5')} as end_s, (event_id % 800)::double as iso, "
    f"{r('rate')} as lat, {r('case when event_id % 3 <> 0 then rate / 2 end')} as lon from rates",
)

# -- live forms ----------------------------------------------------------------

add(
    "live_windows",
    [],
    f"""with h as (select event_type, value, ts, unnest([0, 1]) as k from events),
    w as (select event_type, value, epoch_us(ts) // 7200000000 * 7200000000 - k * 7200000000 as start_us from h)
    select event_type, start_us, count(*) as n, {r('avg(value)')} as mean_value from w group by event_type, start_us""",
)
add(
    "live_islands",
    [],
    """with g as (select user_id, epoch_us(ts) as us, case when epoch_us(ts) - lag(epoch_us(ts)) over p <= 43200000000 then 0 else 1 end as opens from events window p as (partition by user_id order by ts)),
    i as (select *, sum(opens) over (partition by user_id order by us rows unbounded preceding) as isl from g)
    select user_id as video_id, min(us) as first_us, max(us) as last_us, count(*) as events from i group by user_id, isl""",
)
add("live_distinct", [], "select distinct user_id as video_id, event_type, epoch_us(ts) // 86400000000 * 86400000000 as span_us from events")
add(
    "live_deltas",
    ["rates"],
    f"select video_id, {r('t')} as t, {r('coalesce(rate - lag(rate) over (partition by video_id order by t), 0)')} as delta from rates",
)

# -- files and findings ----------------------------------------------------------

SQL["score_report_files"] = SQL["score_report"]


def _matrix(measure: str) -> str:
    cell = lambda n: f"case when a = '{n}' then 1.0 else max(case when b = '{n}' then v end) end::double as {n}"
    return (
        f"select a as signal, {', '.join(map(cell, SIGNAL_COLUMNS))}, '{measure}' as measure from "
        f"(select signal_a as a, signal_b as b, {measure} as v from h{measure} union all select signal_b, signal_a, {measure} from h{measure}) group by a"
    )


SQL["correlation_files"] = f"with hpearson as ({SQL['pearson']}), hspearman as ({SQL['spearman']}) {_matrix('pearson')} union all {_matrix('spearman')}"
SQL["telemetry_export"] = (
    f"select m.video_id, (m.sample_idx + 1) / 2.0::double as t, {cols(['lateral', 'combined'], 5, lambda n: f'm.{n}').replace('as lateral', 'as \"lateral\"')}, g.distance_m, "
    f"(1704067200 + m.video_id) * 1000000 + (m.sample_idx + 1) * 500000 as us from ({SQL['vehicle_motion']}) m join ({SQL['gps_track']}) g using (video_id, sample_idx)"
).replace("m.lateral", 'm."lateral"')
add("group_manifest", ["manifest"], "select * from manifest where group_id = 'g1'")
SQL["split_counts"] = (
    f"select case group_id when 'g2' then 'validation' else 'training' end as side, label, count(*) as n from ({SQL['training_table']}) group by all"
)
SQL["log_order"] = f"select 'all' as file, 'error' as severity, 'times_not_increasing' as code, t from ({SQL['flight_log']}) group by t having count(*) > 1"
add("paired_fixes", ["samples"], "select video_id, sample_idx from samples where sample_idx % 3 > 0")
add(
    "off_lattice",
    ["clips", "samples"],
    """select edit_id, annotation_order from clips join (select video_id, min(t) as t0 from samples group by 1) using (video_id)
    where not mandatory and abs((start_s - t0) * 2 - round((start_s - t0) * 2)) > 1e-6""",
)
SQL["unserved_requests"] = f"select edit_id, annotation_order from ({SQL['served_requests']}) where not served"
add("unprobed_segments", ["clips", "videos"], "select annotation_order from clips where video_id not in (select video_id from videos)")
add("windows_without_telemetry", ["rms"], "select video_id, window_index from rms where pitch_rate_rms is null")
add(
    "manifest_audit",
    ["manifest", "videos", "annotations"],
    """#a as (select video_id, start_s, case when start_s = 5 then end_s + 1 else end_s end as end_s from annotations),
    i as (
      select 'error' as severity, 'video_unreadable' as code, count(*) as n from manifest where video_id = 3
      union all select 'error', 'not_contiguous', count(*) from (select *, lag(end_s) over (partition by video_id order by start_s) as before from a) where before <> start_s
      union all select 'error', 'annotation_out_of_bounds', count(distinct video_id) from a join videos using (video_id) where video_id <> 3 and (start_s < -1e-6 or end_s > floor(duration + 0.5) + 1e-6)
      union all select 'error', 'split_unknown_group', 1
      union all select 'warning', 'split_unassigned_group', 1 where exists (select 1 from manifest where group_id = 'g2'))
    select severity, code, n, 'error' as status, (select sum(n)::bigint from i where severity = 'error') as errors, coalesce((select sum(n)::bigint from i where severity = 'warning'), 0) as warnings
    from i where n > 0""",
)
add(
    "shifted_requests",
    ["videos", "samples"],
    """#q as (select video_id // 3 as edit_id, video_id * 10 + 1 as annotation_order, video_id, 4.0::double as s, duration - 6 as e from videos
      union all select video_id // 3, video_id * 10 + 2, video_id, duration - 12, duration from videos),
    m as (select video_id, case when t > 12 then t + 0.25 else t end as t from samples),
    i as (select edit_id, annotation_order, video_id, t from q join m using (video_id) where t > s + 1e-6 and t < e - 1e-6),
    f as (select *, (t - min(t) over (partition by edit_id, annotation_order, video_id)) * 2 as n from i)
    select edit_id, annotation_order, video_id, count(*) as inside, count(distinct case when abs(n - round(n)) <= 0.45 then round(n) end) as used from f group by 1, 2, 3 having used < inside""",
)
# the quadratic fitted to nine samples: sums over the places -4..4 are 9, 0, 60, 0 and 708 for the powers 0 to 4
add(
    "polynomial_smooth",
    ["signals"],
    f"""#n as (select video_id, count(*) as n from signals group by video_id),
    c as (select video_id, sample_idx, greatest(4, least(n - 5, sample_idx)) as mid, sample_idx - greatest(4, least(n - 5, sample_idx)) as p from signals join n using (video_id)),
    w as (select c.video_id, c.sample_idx, s.roll_index::double as v, p, s.sample_idx - mid as x from c join signals s on s.video_id = c.video_id and s.sample_idx between mid - 4 and mid + 4)
    select video_id, sample_idx, {r('sum(v * ((708 - 60 * (p * p + x * x) + 9 * p * p * x * x) / 2772.0::double + p * x / 60.0::double))')} as roll_index from w group by 1, 2""",
)
