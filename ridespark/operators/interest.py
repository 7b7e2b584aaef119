"""Interest channels computed from motion alone, without a trained model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scaling import sigmoid_gate, unit_scale
from ..plans.quantiles import exact_quantiles, join_on
from ..session import freeze
from .signals import engineered_signals
from .smoothing import rolling_median, time_derivative

SMOOTHED = (
    "directional_turbulence",
    "lateral_flow_asymmetry",
    "roll_index",
    "vertical_flow_gradient",
    "expansion_index",
    "global_flow_magnitude",
    "center_residual",
)
CHANNELS = (
    "score_tech",
    "score_maneuver",
    "gate_motion",
    "score_final",
    "expansion_rate",
    "lfa_normalized",
    "roll_normalized",
    "vfg_normalized",
)


def interest_channels(
    samples: DataFrame,
    *,
    smoothing: float = 0.5,
    gate_low: float | None = None,
    gate_high: float | None = None,
    keys: Sequence[str] = ("video_id",),
) -> DataFrame:
    """Technical, maneuver, motion-gate and final scores per sample, relative to the sequence.

    Signals are smoothed, scaled to the 5..95 percent range of their sequence, and gated
    by how much the frame moves (20..70 percent of the sequence unless given). The
    smoothed signals are written once: their quantiles and the scores both read them.
    """
    keys = list(keys)
    raw = engineered_signals(samples, ids=[*keys, "sample_idx", "t"], dtype="double").select(
        *keys, "sample_idx", "t", *SMOOTHED
    )
    smooth = time_derivative(
        rolling_median(raw, list(SMOOTHED), smoothing, keys=keys), {"expansion_rate": "expansion_index"}, keys=keys
    )
    smooth = freeze(smooth)
    source = {
        "score_tech": F.col("directional_turbulence"),
        "lfa_normalized": F.abs("lateral_flow_asymmetry"),
        "roll_normalized": F.abs("roll_index"),
        "vfg_normalized": F.abs("vertical_flow_gradient"),
        "_change": F.abs("expansion_rate"),
    }
    motion = F.col("global_flow_magnitude")
    cuts = exact_quantiles(
        smooth, keys, {f"_q_{n}": c for n, c in source.items()} | {"_q_motion": motion}, [0.05, 0.2, 0.7, 0.95]
    )
    spread = smooth.groupBy(*keys).agg(F.stddev_pop(motion).alias("_std_motion"))
    rows = join_on(smooth, join_on(cuts, spread, keys), keys)
    for n, c in source.items():
        rows = rows.withColumn(n, unit_scale(c, F.col(f"_q_{n}")[0], F.col(f"_q_{n}")[3]))
    low = F.lit(float(gate_low)) if gate_low is not None else F.col("_q_motion")[1]
    if gate_high is not None:
        high = F.lit(float(gate_high))
    else:
        high = F.when(F.col("_q_motion")[2] > low, F.col("_q_motion")[2]).otherwise(
            low + F.greatest(F.col("_std_motion"), F.lit(1e-6))
        )
    four = F.col("lfa_normalized") + F.col("roll_normalized") + F.col("vfg_normalized") + F.col("_change")
    rows = rows.withColumns({"score_maneuver": four / 4, "gate_motion": sigmoid_gate(motion, low, high)})
    rows = rows.withColumn(
        "_combined", F.col("gate_motion") * (0.5 * F.col("score_tech") + 0.5 * F.col("score_maneuver"))
    )
    rows = freeze(rows.select(*keys, "sample_idx", "t", "_combined", *[c for c in CHANNELS if c != "score_final"]))
    bounds = exact_quantiles(rows, keys, {"_q_final": F.col("_combined")}, [0.05, 0.95])
    final = unit_scale(F.col("_combined"), F.col("_q_final")[0], F.col("_q_final")[1])
    return join_on(rows, bounds, keys).withColumn("score_final", final).select(*keys, "sample_idx", "t", *CHANNELS)
