"""Choosing clips for an edit: trimming, overlap suppression and the duration budget.

Candidates: edit_id, video_id, video_order, start_s, end_s, duration, max_score,
mean_score, evidence (array of start_s, end_s, window_index, score),
annotation_order. Requested clips: edit_id, video_id, start_s, end_s, mandatory,
annotation_order.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.intervals import CELL, LEVEL, OWN, drop_overlapping, in_cells, overlap_pairs
from ..plans.ordered import ordinal, running
from ..session import freeze

EDIT = "edit_id"
SLACK = 1e-9


def candidate_order() -> list[Column]:
    """Best first: peak, evidence, mean, length; then a fixed order."""
    return [
        F.desc("max_score"),
        F.desc(F.size("evidence")),
        F.desc("mean_score"),
        F.desc("duration"),
        F.asc("video_order"),
        F.asc("start_s"),
        F.asc("video_id"),
        F.asc(F.coalesce("annotation_order", F.lit(-1))),
    ]


def video_order(clips: DataFrame, *, edit: str = EDIT) -> DataFrame:
    """Videos of an edit numbered from 0 by their first line."""
    first = clips.groupBy(edit, "video_id").agg(F.min("annotation_order").alias("_line"))
    line = F.col("_line")
    numbered = running(
        first, [edit], line, 4096, [line, F.col("video_id")], {"video_order": ("sum", F.lit(1))}
    )
    return numbered.select(edit, "video_id", F.col("video_order").cast("int").alias("video_order"))


def mandatory_clips(clips: DataFrame) -> DataFrame:
    """The clips that must stay, with the line they were asked for on."""
    return clips.where("mandatory").select(
        *[c for c in clips.columns if c != "mandatory"],
        (F.col("end_s") - F.col("start_s")).alias("duration"),
    )


def pad_and_clamp(
    segments: DataFrame,
    videos: DataFrame,
    *,
    min_clip: float = 3.0,
    padding: float = 2.0,
    keys: Sequence[str] = ("video_id",),
    strict: bool = True,
) -> DataFrame:
    """Drop segments shorter than `min_clip`, widen the rest, and keep them inside the video.

    `core_start` and `core_end` keep the segment before padding. A segment of a video without
    a known length fails the job, or with `strict=False` is left out (see `unprobed`).
    """
    kept = segments.where(F.col("duration") + SLACK >= min_clip)
    lengths = videos.select(*keys, F.col("duration").alias("_length"))
    known = kept.join(lengths, list(keys), "left" if strict else "inner")
    if strict:
        unknown = F.raise_error(F.lit("a segment's video has no known length")).cast("double")
        known = known.withColumn("_length", F.coalesce("_length", unknown))
    else:
        known = known.where(F.col("_length").isNotNull())
    return (
        known
        .withColumns({"core_start": F.col("start_s"), "core_end": F.col("end_s")})
        .withColumns(
            {
                "start_s": F.greatest(F.lit(0.0), F.col("core_start") - padding),
                "end_s": F.least(F.col("_length"), F.col("core_end") + padding),
            }
        )
        .withColumn("duration", F.col("end_s") - F.col("start_s"))
        .drop("_length")
    )


def unprobed(segments: DataFrame, videos: DataFrame, *, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Segments of videos without a known length."""
    return segments.join(videos.where(F.col("duration").isNotNull()).select(*keys), list(keys), "left_anti")


def first_request(segments: DataFrame, clips: DataFrame, *, keys: Sequence[str] = (EDIT, "video_id"), width: float = 60.0) -> DataFrame:
    """Add the smallest line number among the requested ranges a segment overlaps; else null."""
    keys = list(keys)
    ranges = clips.select(
        *keys, F.col("start_s").alias("_rs"), F.col("end_s").alias("_re"), F.col("annotation_order").alias("_line")
    )
    spans = segments.select(*keys, "core_start", "core_end")
    lines = (
        overlap_pairs(spans, ranges, keys, ("core_start", "core_end"), ("_rs", "_re"), width=width)
        .groupBy(*keys, "core_start", "core_end")
        .agg(F.min("_line").alias("annotation_order"))
    )
    return segments.join(lines, [*keys, "core_start", "core_end"], "left")


def trim_to_evidence(candidates: DataFrame, *, max_clip: float, min_clip: float) -> DataFrame:
    """Cut candidates longer than `max_clip` around their strongest window.

    Evidence outside the cut is dropped and the scores are those of what remains.
    Candidates that cannot be cut (max below min, no evidence left) disappear.
    """
    if max_clip <= 0:
        return candidates
    e = F.col("evidence")
    best = F.array_sort(
        F.transform(
            e,
            lambda w: F.struct(
                (-w["score"]).alias("rank"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s")
            ),
        )
    )[0]
    some = F.size(e) > 0
    middle = F.when(some, (best["start_s"] + best["end_s"]) / 2).otherwise((F.col("start_s") + F.col("end_s")) / 2)
    long = F.col("duration") > max_clip + SLACK
    start = F.least(F.greatest(middle - max_clip / 2, F.col("start_s")), F.col("end_s") - max_clip)
    cut = candidates.withColumns({"_long": long, "_start": start})
    kept = F.filter(e, lambda w: (w["end_s"] > F.col("_start")) & (w["start_s"] < F.col("_start") + max_clip))
    cut = cut.withColumn("_kept", F.when(F.col("_long"), kept).otherwise(e))
    cut = cut.where(~F.col("_long") | (F.lit(max_clip >= min_clip) & (~some | (F.size("_kept") > 0))))
    total = F.aggregate("_kept", F.lit(0.0), lambda acc, w: acc + w["score"])
    rescored = F.col("_long") & (F.size("_kept") > 0)
    new = {
        "max_score": F.when(rescored, F.array_max(F.transform("_kept", lambda w: w["score"]))).otherwise(F.col("max_score")),
        "mean_score": F.when(rescored, total / F.size("_kept")).otherwise(F.col("mean_score")),
        "start_s": F.when(F.col("_long"), F.col("_start")).otherwise(F.col("start_s")),
        "end_s": F.when(F.col("_long"), F.col("_start") + max_clip).otherwise(F.col("end_s")),
        "evidence": F.col("_kept"),
    }
    return cut.withColumns(new).withColumn(
        "duration", F.when(F.col("_long"), F.col("end_s") - F.col("start_s")).otherwise(F.col("duration"))
    ).drop("_long", "_start", "_kept")


def _alone_ahead(open_: DataFrame, unit: Sequence[str], rank: str, width: float) -> DataFrame:
    """Unit and rank of the rows that are ahead of all others in each cell they share with them.

    Intervals that overlap share a cell in which one of the two stands as its own, so a cell needs
    two numbers: the least rank of those that own it, and of those below. No pairs are made.
    """
    unit = list(unit)
    at = [*unit, LEVEL, CELL]
    slim = in_cells(open_.select(*unit, rank, "start_s", "end_s"), "start_s", "end_s", width).select(*at, rank, OWN)
    least = slim.groupBy(*at).agg(F.min(F.when(F.col(OWN), F.col(rank))).alias("_owner"), F.min(F.when(~F.col(OWN), F.col(rank))).alias("_below"))
    ahead = F.least(F.col("_owner"), F.when(F.col(OWN), F.col("_below")))
    return slim.join(least, at).groupBy(*unit, rank).agg(F.min(ahead).alias("_ahead")).where(F.coalesce(F.col("_ahead") >= F.col(rank), F.lit(True))).select(*unit, rank)


def _walked(head: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Go through each unit's rows by rank: keep what overlaps nothing kept and fits what is left.

    Returns the unit and rank of what is kept, and one row per unit with the last rank looked at and
    the `rest` of its budget. A task streams through rows sorted by unit and rank; it holds the kept
    clips of one unit.
    """
    unit = list(unit)
    kinds = {f.name: f.dataType.simpleString() for f in head.schema}
    spec = ", ".join([*(f"{u} {kinds[u]}" for u in unit), f"rank {kinds['rank']}", "rest double"])
    rows = head.select(*unit, F.col("video_id").alias("_video"), "rank", "start_s", "end_s", "duration", "_left").sortWithinPartitions(*unit, "rank")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, left, last, out = None, {}, 0.0, None, []

        def free(video, start: float, end: float) -> int | None:
            """Where the interval goes among the video's kept ones; None if it overlaps one."""
            starts, ends = kept.setdefault(video, ([], []))
            at = bisect.bisect_left(starts, end)
            return None if at and ends[at - 1] > start else at

        for batch in batches:
            for *key, video, rank, start, end, duration, budget in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if key != now:
                    if now is not None:
                        out.append([*now, last, left])
                    now, kept, left = key, {}, budget
                last = rank
                if duration <= left + SLACK and (at := free(video, start, end)) is not None:
                    starts, ends = kept[video]
                    starts.insert(at, start)
                    ends.insert(at, end)
                    left = max(0.0, left - duration)
                    out.append([*key, rank, None])
            if out:
                yield _rows(out)
                out = []
        if now is not None:
            yield _rows([[*now, last, left]])

    def _rows(out: list[list]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:-1]), pa.array(columns[-1], pa.float64())], names=[*unit, "rank", "rest"])

    return rows.mapInArrow(run, spec)


def without_rivals(candidates: DataFrame, *, unit: Sequence[str] = (EDIT, "video_id"), rank: str = "rank", width: float = 8.0) -> DataFrame:
    """Greedy choice of intervals in the order of `rank` (unique in a unit): each that overlaps no better one chosen.

    In every round all candidates that are ahead of everything near them enter at once, and what
    overlaps them leaves. The best open candidate of a unit always enters, and far-apart ones do not
    wait for each other, so the rounds follow the longest chain of neighbours of falling rank. The
    result does not depend on `width`, the least width of a cell in seconds.
    """
    names, span = list(unit), ("start_s", "end_s")
    rounds: list[DataFrame] = []
    open_ = candidates
    while True:
        entering = freeze(open_.join(_alone_ahead(open_, names, rank, width), [*names, rank], "left_semi"))
        if entering.isEmpty():
            break
        rounds.append(entering)
        rest = open_.join(entering.select(*names, rank), [*names, rank], "left_anti")
        open_ = freeze(drop_overlapping(rest, entering, names, span, span, width=width))
    return reduce(DataFrame.unionByName, rounds) if rounds else candidates.limit(0)


def _within_budget(open_: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """What enters before the first clip of each edit that does not fit; and, of edits with such a clip, what may still enter.

    Without a budget the choice is that of `without_rivals`. Running sums of the chosen lengths find the
    first one that does not fit; up to there the choice stands. Behind it, what is longer than the rest
    can never enter, while rivals of the skipped one may.
    """
    chosen = without_rivals(open_, width=width)
    summed = freeze(running(chosen, [EDIT], F.col("rank"), 4096, [F.col("rank")], {"_before": ("sum", F.col("duration"))}))
    rest = F.greatest(F.lit(0.0), F.col("_left") - F.col("_before"))
    stop = summed.where(F.col("duration") > rest + SLACK).groupBy(EDIT).agg(F.min(F.struct("rank", rest.alias("rest"))).alias("_stop"))
    stop = freeze(stop.select(EDIT, F.col("_stop.rank").alias("_at"), F.col("_stop.rest").alias("_rest")))
    kept = summed.join(stop, EDIT, "left").where(F.col("_at").isNull() | (F.col("rank") < F.col("_at"))).select(*open_.columns)
    behind = open_.join(stop, EDIT).where((F.col("rank") > F.col("_at")) & (F.col("duration") <= F.col("_rest") + SLACK))
    return kept, behind.withColumn("_left", F.col("_rest")).drop("_at", "_rest")


def select_greedy(
    candidates: DataFrame,
    mandatory: DataFrame,
    *,
    budgets: DataFrame | None = None,
    min_clip: float = 3.0,
    max_clip: float = 0.0,
    head: int = 20_000,
    width: float = 8.0,
) -> DataFrame:
    """Keep candidates best first: none that overlaps a mandatory or a kept clip, none
    longer than what is left of the edit's budget. One that does not fit is skipped and
    shorter ones behind it still enter.

    `budgets` holds edit_id and budget (seconds); edits without a row have none. Mandatory
    time is taken off first, and an edit whose mandatory clips exceed its budget gets nothing.

    The choice is sequential inside an edit with a budget, and inside (edit, video) otherwise. The
    best `head` candidates of every such unit are walked through in order; most units end there. Of
    longer ones, joins drop what overlaps a kept clip or cannot fit, and what is left is chosen in
    parallel (`without_rivals`, `_within_budget`) before the next walk. No unit sits in one task, and
    the result depends on neither `head` nor `width`.
    """
    cols = candidates.columns
    span, per_video = ("start_s", "end_s"), [EDIT, "video_id"]
    open_ = drop_overlapping(candidates, mandatory, per_video, span, span, width=width)
    # ranks are those of the untrimmed candidates
    open_ = trim_to_evidence(ordinal(open_, candidate_order(), [EDIT], name="rank"), max_clip=max_clip, min_clip=min_clip)
    unlimited = F.lit(float("inf"))
    if budgets is None:
        unit, open_ = per_video, open_.withColumn("_left", unlimited)
    else:
        unit = [EDIT]
        used = mandatory.groupBy(EDIT).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_used"))
        over = F.col("budget").isNotNull() & (F.coalesce("_used", F.lit(0.0)) > F.col("budget") + SLACK)
        left = F.greatest(F.lit(0.0), F.col("budget") - F.coalesce("_used", F.lit(0.0)))
        open_ = open_.join(budgets.select(EDIT, "budget"), EDIT, "left").join(used, EDIT, "left").where(~over)
        open_ = open_.withColumn("_left", F.coalesce(left, unlimited)).drop("budget", "_used")
    open_ = freeze(open_)
    rounds: list[DataFrame] = []
    while True:
        best = open_.withColumn("_n", F.row_number().over(W.partitionBy(*unit).orderBy("rank"))).where(F.col("_n") <= head)
        walked = freeze(_walked(best, unit))
        kept = open_.join(walked.where("rest is null").select(*unit, "rank"), [*unit, "rank"], "left_semi")
        rounds.append(kept.select(*cols))
        ends = walked.where("rest is not null").select(*unit, F.col("rank").alias("_last"), "rest")
        behind = open_.join(ends, unit).where((F.col("rank") > F.col("_last")) & (F.col("duration") <= F.col("rest") + SLACK))
        behind = freeze(behind.withColumn("_left", F.col("rest")).drop("_last", "rest"))
        if behind.isEmpty():
            break
        open_ = freeze(drop_overlapping(behind, kept, per_video, span, span, width=width))
        if budgets is None:
            rounds.append(without_rivals(open_, width=width).select(*cols))
            break
        kept, behind = _within_budget(open_, width)
        rounds.append(kept.select(*cols))
        open_ = freeze(drop_overlapping(behind, kept, per_video, span, span, width=width))
    return reduce(DataFrame.unionByName, rounds)
