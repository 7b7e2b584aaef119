"""Output timelines and their alignment to music."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import running
from ..session import freeze
from .asof import first_at_or_after, nearest
from .selection import EDIT, SLACK

ORDER_WIDTH = 4096  # line numbers per chunk


def _line_order() -> list[Column]:
    mandatory_first = F.when(F.col("mandatory"), 0).otherwise(1)
    return [F.col("line"), F.col("source_start"), mandatory_first, F.col("video_id"), F.col("source_end")]


def place_clips(clips: DataFrame) -> DataFrame:
    """Positions on the output: one clip after the other, without gaps.

    Clips carry edit_id, video_id, line, source_start, source_end, mandatory. Running
    sums are carried over chunks of line numbers.
    """
    length = F.col("source_end") - F.col("source_start")
    out = running(
        clips,
        [EDIT],
        F.col("line"),
        ORDER_WIDTH,
        _line_order(),
        {"output_start": ("sum", length), "position": ("sum", F.lit(1))},
    )
    return out.withColumns(
        {
            "output_end": F.col("output_start") + length,
            "output_start": F.col("output_start").cast("double"),
            "position": F.col("position").cast("long"),
        }
    )


def assemble_timeline(selected: DataFrame, mandatory: DataFrame) -> DataFrame:
    """Selected and mandatory clips in the order of the request, then of source time."""
    chosen = selected.select(
        EDIT,
        "video_id",
        F.col("start_s").alias("source_start"),
        F.col("end_s").alias("source_end"),
        F.lit(False).alias("mandatory"),
        F.col("max_score").alias("score"),
        F.col("annotation_order").cast("long").alias("annotation_order"),
        F.coalesce("annotation_order", "video_order").cast("long").alias("line"),
    )
    fixed = mandatory.select(
        EDIT,
        "video_id",
        F.col("start_s").alias("source_start"),
        F.col("end_s").alias("source_end"),
        F.lit(True).alias("mandatory"),
        F.lit(None).cast("double").alias("score"),
        F.col("annotation_order").cast("long").alias("annotation_order"),
        F.col("annotation_order").cast("long").alias("line"),
    )
    return place_clips(chosen.unionByName(fixed))


# fixed values: snapping mode -> kind of music event it uses
MODES = {
    "off": None,
    "beat": "beat",
    "measure": "measure",
    "forward-beat": "beat",
    "onset": "onset",
    "combined": "combined",
    "bass": "bass",
}


def snap_times(
    points: DataFrame, events: DataFrame, *, mode: str, time: str = "t", keys=("track_id",), width: float = 60.0
) -> DataFrame:
    """Add `snapped`: the nearest event of the mode's kind (earlier on a tie), the next beat
    for "forward-beat", and the time itself where the grid has nothing to offer."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "off":
        return points.withColumn("snapped", F.col(time))
    grid = events.where(F.col("kind") == MODES[mode]).select(*keys, F.col("t").alias("event")).distinct()
    join = first_at_or_after if mode == "forward-beat" else nearest
    found = join(points, grid, left_t=time, right_t="event", keys=keys, prefix="_to_", width=width)
    return found.withColumn("snapped", F.coalesce("_to_event", time)).drop("_to_event")


def synchronize(
    timeline: DataFrame,
    events: DataFrame,
    tracks: DataFrame,
    edits: DataFrame,
    *,
    mode: str,
    max_synced: float = 0.0,
    width: float = 60.0,
) -> DataFrame:
    """Snap both ends of optional clips to the music of their edit.

    `edits` maps edit_id to track_id, `tracks` gives track durations; edits without a
    track stay as they are. A snapped clip that would be empty, reversed or longer than
    `max_synced` keeps its bounds. An edit that fitted its music and no longer would
    keeps all its bounds.
    """
    if mode == "off":
        return timeline
    timeline = freeze(timeline)  # read for the points, the totals and the new positions
    music = edits.join(tracks.select("track_id", F.col("duration").alias("_music")), "track_id")
    base = timeline.drop("position", "output_start", "output_end").join(music, EDIT, "left")
    own = ["track_id", *_point_columns()]
    moving = base.where(~F.col("mandatory") & F.col("track_id").isNotNull()).select(*own)
    # Starts and ends are snapped in one pass over the grid.
    points = moving.select(
        "track_id",
        *_point_columns(),
        F.explode(
            F.array(
                F.struct(F.lit("s").alias("side"), F.col("source_start").alias("t")),
                F.struct(F.lit("e").alias("side"), F.col("source_end").alias("t")),
            )
        ).alias("_p"),
    ).select("track_id", *_point_columns(), "_p.*")
    snapped = (
        snap_times(points, events, mode=mode, width=width)
        .groupBy(*_point_columns())
        .agg(
            F.max(F.when(F.col("side") == "s", F.col("snapped"))).alias("_s"),
            F.max(F.when(F.col("side") == "e", F.col("snapped"))).alias("_e"),
        )
    )
    fine = F.col("_e") > F.col("_s")
    if max_synced > 0:
        fine = fine & (F.col("_e") - F.col("_s") <= max_synced + SLACK)
    proposal = base.join(snapped, _point_columns(), "left").withColumns(
        {
            "_s": F.when(~F.col("mandatory") & fine, F.col("_s")).otherwise(F.col("source_start")),
            "_e": F.when(~F.col("mandatory") & fine, F.col("_e")).otherwise(F.col("source_end")),
        }
    )
    proposal = freeze(proposal)
    totals = proposal.groupBy(EDIT).agg(
        F.sum(F.col("source_end") - F.col("source_start")).alias("_before"),
        F.sum(F.col("_e") - F.col("_s")).alias("_after"),
    )
    rejected = F.coalesce(
        (F.col("_before") <= F.col("_music") + SLACK) & (F.col("_after") > F.col("_music") + SLACK), F.lit(False)
    )
    # Clips keep the order they had before snapping.
    final = proposal.join(totals, EDIT).select(
        *[c for c in base.columns if c not in ("source_start", "source_end", "track_id", "_music")],
        F.col("source_start").alias("_was_start"),
        F.col("source_end").alias("_was_end"),
        F.when(rejected, F.col("source_start")).otherwise(F.col("_s")).alias("_to_start"),
        F.when(rejected, F.col("source_end")).otherwise(F.col("_e")).alias("_to_end"),
    )
    length = F.col("_to_end") - F.col("_to_start")
    ordered = final.withColumns({"source_start": F.col("_was_start"), "source_end": F.col("_was_end")})
    placed = running(
        ordered,
        [EDIT],
        F.col("line"),
        ORDER_WIDTH,
        _line_order(),
        {"output_start": ("sum", length), "position": ("sum", F.lit(1))},
    )
    return placed.withColumns(
        {
            "output_end": F.col("output_start") + length,
            "output_start": F.col("output_start").cast("double"),
            "position": F.col("position").cast("long"),
            "source_start": F.col("_to_start"),
            "source_end": F.col("_to_end"),
        }
    ).select(*timeline.columns)


def _point_columns() -> list[str]:
    """What tells the clips of an edit apart."""
    return [EDIT, "video_id", "line", "source_start", "source_end", "mandatory"]
