"""Motion signals per sample: pure column expressions, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ordered import CHUNK, HALO, halo_by_distance
from ..schemas import DELTA_SOURCES, GRID, SAMPLE_COLUMNS, SIGNAL_COLUMNS

EPSILON = 1e-5
CELLS = [(r, c) for r in range(GRID) for c in range(GRID)]
CENTER = (1, 1)


def _mean(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / len(columns)


def _cell(r: int, c: int, part: str) -> Column:
    return F.col(f"grid_{r}_{c}_{part}").cast("double")


def _magnitude(cell: tuple[int, int]) -> Column:
    return F.hypot(_cell(*cell, "u"), _cell(*cell, "v"))


def _residual(cell: tuple[int, int]) -> Column:
    """Length of the cell's mean flow after the frame's mean flow is taken away."""
    return F.hypot(
        _cell(*cell, "u") - F.col("flow_u").cast("double"),
        _cell(*cell, "v") - F.col("flow_v").cast("double"),
    )


def _with_cell_columns(df: DataFrame) -> DataFrame:
    """Per-cell magnitudes and direction cosines, computed once per row."""
    out = df.withColumns({f"_m{r}{c}": _magnitude((r, c)) for r, c in CELLS})
    angle = {(r, c): F.atan2(_cell(r, c, "v"), _cell(r, c, "u")) for r, c in CELLS}
    return out.withColumns(
        {
            "_cos": _mean([F.cos(a) for a in angle.values()]),
            "_sin": _mean([F.sin(a) for a in angle.values()]),
        }
    )


def _shape_signals(epsilon: float) -> dict[str, Column]:
    m = {(r, c): F.col(f"_m{r}{c}") for r, c in CELLS}
    row = lambda r: _mean([m[r, c] for c in range(GRID)])
    col = lambda c: _mean([m[r, c] for r in range(GRID)])
    ring = _mean([m[x] for x in CELLS if x != CENTER])
    base = m[CENTER] + epsilon
    return {
        "vertical_flow_gradient": (row(0) - row(2)) / base,
        "lateral_flow_asymmetry": (col(2) - col(0)) / base,
        "expansion_index": (ring - m[CENTER]) / base,
        "roll_index": (m[0, 0] + m[2, 2] - m[0, 2] - m[2, 0]) / base,
        "directional_turbulence": 1 - F.hypot(F.col("_cos"), F.col("_sin")),
        "global_flow_magnitude": F.hypot(
            F.col("flow_u").cast("double"), F.col("flow_v").cast("double")
        ),
    }


def engineered_signals(
    samples: DataFrame,
    *,
    ids: Sequence[str] = ("video_id", "sample_idx", "t"),
    epsilon: float = EPSILON,
    dtype: str = "float",
    strict: bool = False,
) -> DataFrame:
    """The eight model signals. Reads 20 of the 54 sample columns.

    With `strict`, a non-finite signal fails the job.
    """
    df = _with_cell_columns(samples)
    edge = _mean([_residual((0, 0)), _residual((0, 2))])
    signals = _shape_signals(epsilon) | {
        "center_residual": _residual(CENTER),
        "tunnel_vision": edge / (_residual(CENTER) + epsilon),
    }
    out = df.select(*ids, *[signals[n].alias(n) for n in SIGNAL_COLUMNS])
    if strict:
        out = out.withColumns({n: _finite_or_fail(n) for n in SIGNAL_COLUMNS})
    return out.withColumns({n: F.col(n).cast(dtype) for n in SIGNAL_COLUMNS})


def _finite_or_fail(name: str) -> Column:
    x = F.col(name)
    return F.when(is_finite(x), x).otherwise(
        F.raise_error(F.lit(f"{name} holds a non-finite value"))
    )


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def exploratory_signals(
    samples: DataFrame,
    *,
    ids: Sequence[str] = ("video_id", "sample_idx", "t"),
    epsilon: float = EPSILON,
    edge_cells: Sequence[tuple[int, int]] = ((0, 0), (0, 2)),
    center_cell: tuple[int, int] = CENTER,
) -> DataFrame:
    """A wider set for exploration: residual of every cell, edges, divergence and the model signals."""
    if not edge_cells or not epsilon > 0:
        raise ValueError("edge_cells must not be empty and epsilon must be positive")
    for cell in [*edge_cells, center_cell]:
        if tuple(cell) not in CELLS:
            raise ValueError(f"no such cell: {cell}")
    df = _with_cell_columns(samples).withColumns({f"residual_{r}{c}": _residual((r, c)) for r, c in CELLS})
    res = {(r, c): F.col(f"residual_{r}{c}") for r, c in CELLS}
    side = lambda cells, part: _mean([_cell(r, c, part) for r, c in cells])
    column = lambda c: [(r, c) for r in range(GRID)]
    line = lambda r: [(r, c) for c in range(GRID)]
    edge = _mean([res[tuple(c)] for c in edge_cells])
    signals = {f"residual_{r}{c}": res[r, c] for r, c in CELLS}
    signals |= {
        "edge_left_residual": res[0, 0],
        "edge_right_residual": res[0, 2],
        "edge_residual": edge,
        "center_residual": res[tuple(center_cell)],
        "tunnel_vision": edge / (res[tuple(center_cell)] + epsilon),
        "bottom_edge_residual": _mean([res[2, 0], res[2, 2]]),
        "optical_flow_divergence": (side(column(2), "u") - side(column(0), "u")) / 2
        + (side(line(2), "v") - side(line(0), "v")) / 2,
    }
    signals |= _shape_signals(epsilon)
    return df.select(*ids, *[c.alias(n) for n, c in signals.items()])


def sample_deltas(
    samples: DataFrame, *, keys: Sequence[str] = ("video_id",), chunk: int = 4096
) -> DataFrame:
    """First differences of five columns along `sample_idx`; 0 for the first sample of a key.

    `sample_idx` counts 0, 1, 2, ... within the keys, so a chunk needs one row before it.
    """
    cut = halo_by_distance(samples, "sample_idx", chunk, before=1)
    w = W.partitionBy(*keys, CHUNK).orderBy("sample_idx")
    step = lambda c: F.coalesce(
        F.col(c).cast("double") - F.lag(F.col(c).cast("double")).over(w), F.lit(0.0)
    )
    # Select what the differences need before the shuffle; other columns ride along untouched.
    return cut.withColumns({d: step(s) for d, s in DELTA_SOURCES.items()}).where(~F.col(HALO)).drop(CHUNK, HALO)


def stored_columns(samples: DataFrame, *, packed: str, ids: Sequence[str]) -> DataFrame:
    """Spread a packed feature array into the named sample columns."""
    return samples.select(
        *ids, *[F.col(packed)[i].cast("float").alias(n) for i, n in enumerate(SAMPLE_COLUMNS)]
    )
