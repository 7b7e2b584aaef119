"""Column contracts shared by the operators.

The name lists below are fixed values: stored sample tables and trained models
depend on exactly these names in exactly this order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

GRID = 3

FRAME_COLUMNS = ("flow_mean", "flow_p90", "flow_std", "flow_u", "flow_v", "flow_net")
FIELD_COLUMNS = (
    "div_normalized_mean",
    "div_abs_p90",
    "div_std",
    "div_pos_fraction",
    "curl_normalized_mean",
    "curl_abs_p90",
    "curl_std",
)
# delta column -> the column it is the first difference of
DELTA_SOURCES = {
    "delta_flow_u": "flow_u",
    "delta_flow_v": "flow_v",
    "delta_flow_mean": "flow_mean",
    "delta_flow_net": "flow_net",
    "delta_div_mean": "div_normalized_mean",
}
CELL_PARTS = ("u", "v", "magnitude", "net")

SAMPLE_COLUMNS = (
    FRAME_COLUMNS
    + FIELD_COLUMNS
    + tuple(DELTA_SOURCES)
    + tuple(f"grid_{r}_{c}_{p}" for r in range(GRID) for c in range(GRID) for p in CELL_PARTS)
)

SIGNAL_COLUMNS = (
    "vertical_flow_gradient",
    "lateral_flow_asymmetry",
    "expansion_index",
    "roll_index",
    "directional_turbulence",
    "global_flow_magnitude",
    "center_residual",
    "tunnel_vision",
)
WINDOW_STATS = ("mean", "max", "std", "median", "q90", "min")
PITCH_COLUMN = "pitch_rate_rms"
FEATURE_COLUMNS = tuple(f"{s}_{st}" for s in SIGNAL_COLUMNS for st in WINDOW_STATS) + (PITCH_COLUMN,)

GRADES = (0, 1, 2, 3)
# relevance gain of grade 0, 1, 2, 3
GAINS = (0.0, 1.0, 3.0, 9.0)

SAMPLES_SCHEMA = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("sample_idx", T.IntegerType()),
        T.StructField("t", T.DoubleType()),
    ]
    + [T.StructField(n, T.FloatType()) for n in SAMPLE_COLUMNS]
)


def feature_name(feature: str | int, names: tuple[str, ...] = SAMPLE_COLUMNS) -> str:
    """A column name from a name or a zero-based position (given as int or digits)."""
    text = str(feature).strip()
    if not text:
        raise ValueError("a feature is named or numbered; got an empty string")
    if text.lstrip("+-").isdigit():
        position = int(text)
        if not 0 <= position < len(names):
            raise ValueError(f"feature position must be within 0..{len(names) - 1}, got {position}")
        return names[position]
    if text not in names:
        raise ValueError(f"unknown feature {text!r}")
    return text


def require_columns(df: DataFrame, names: tuple[str, ...], dtype: str | None = None) -> DataFrame:
    """Check that `df` holds exactly `names`, in this order, among its columns of the contract.

    Columns outside the contract (ids, times) may stand around them. `dtype` is a
    simple type name such as ``float``; values are not looked at.
    """
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    order = [c for c in df.columns if c in set(names)]
    if order != list(names):
        raise ValueError("columns are present but not in the order of the contract")
    if dtype is not None:
        kinds = dict(df.dtypes)
        wrong = [f"{n}: {kinds[n]}" for n in names if kinds[n] != dtype]
        if wrong:
            raise ValueError(f"expected type {dtype} for {', '.join(wrong)}")
    return df
