"""Overlap joins of intervals by cells of several widths.

An interval lies in the one or two cells of the least width that holds its length, its own cells, and
in the one or two cells of each greater width above them. Of two intervals that intersect, the
shorter one has the longer one's own cell among its cells, so pairs meet where one side stands with
its own cells. A long interval thus makes as few copies as a short one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LEVEL, CELL, OWN = "_level", "_cell", "_own"
FACTOR, LEVELS = 8, 6


def in_cells(df: DataFrame, start: str, end: str, width: float, *, own: bool = True, above: bool = True, levels: int = LEVELS) -> DataFrame:
    """Copies of each row with `_level`, `_cell` and `_own`: its own cells, those above them, or both.

    Cells of level k are `width` * 8**k wide. An interval longer than the widest cell has as many of
    them as it touches. Rows without a start or an end have no cells.
    """
    long = F.col(end) - F.col(start)
    mine = sum((F.when(long > width * FACTOR**k, 1).otherwise(0) for k in range(levels - 1)), F.lit(0))

    def cells(k: int) -> Column:
        first, last = (F.floor(F.col(x) / (width * FACTOR**k)).cast("long") for x in (start, end))
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda c: F.struct(F.lit(k).alias("level"), c.alias("cell"), (F.lit(k) == mine).alias("own")))

    none = F.expr("filter(array(named_struct('level', 0, 'cell', 0L, 'own', true)), x -> false)")
    wanted = [(F.lit(k) == mine if own else F.lit(False)) | (F.lit(k) > mine if above else F.lit(False)) for k in range(levels)]
    at = F.flatten(F.array(*[F.when(w, cells(k)).otherwise(none) for k, w in enumerate(wanted)]))
    known = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return known.withColumn("_at", F.explode(at)).withColumns({LEVEL: F.col("_at.level"), CELL: F.col("_at.cell"), OWN: F.col("_at.own")}).drop("_at")


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    width: float = 60.0,
) -> DataFrame:
    """All (left, right) rows of equal keys whose open intervals intersect, each once.

    Two joins on keys and cell: right intervals in their own cells with left ones as long or
    shorter, and left intervals in their own cells with shorter right ones. A pair is kept in the
    cell that holds the later of the two starts.
    """
    (ls, le), (rs, re_) = left_span, right_span
    on = [*keys, LEVEL, CELL]

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.drop(OWN).join(b.drop(OWN), on)
        later = F.floor(F.greatest(ls, rs) / (F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), F.col(LEVEL)))).cast("long")
        return pairs.where((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.col(CELL) == later)).drop(LEVEL, CELL)

    shorter = met(in_cells(left, ls, le, width), in_cells(right, rs, re_, width, above=False))
    longer = met(in_cells(left, ls, le, width, above=False).where(F.col(LEVEL) > 0), in_cells(right, rs, re_, width, own=False))
    return shorter.unionByName(longer)


def drop_overlapping(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    width: float = 60.0,
) -> DataFrame:
    """Rows of `left` that overlap no row of `right` with the same keys."""
    (ls, le), names = left_span, [*keys, *left_span]
    spans = right.select(*keys, F.col(right_span[0]).alias("_rs"), F.col(right_span[1]).alias("_re"))
    slim = left.select(*names)

    def hit(a: DataFrame, b: DataFrame) -> DataFrame:
        on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, LEVEL, CELL]] + [F.col(f"l.{ls}") < F.col("r._re"), F.col("r._rs") < F.col(f"l.{le}")]
        return a.alias("l").join(b.alias("r"), on, "left_semi").select(*names)

    shorter = hit(in_cells(slim, ls, le, width), in_cells(spans, "_rs", "_re", width, above=False))
    longer = hit(in_cells(slim, ls, le, width, above=False).where(F.col(LEVEL) > 0), in_cells(spans, "_rs", "_re", width, own=False))
    return left.join(shorter.unionByName(longer).distinct(), names, "left_anti")
