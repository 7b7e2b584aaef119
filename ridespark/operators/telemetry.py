"""Camera and ride telemetry: attitude, accelerations, positions, clocks.

A telemetry row is keyed by `video_id` and `t` (seconds, strictly increasing per
video). Attitude is `qw, qx, qy, qz`, acceleration `ax, ay, az`, a fix `lat, lon,
alt` with velocity `vx, vy` where the device gives one. All may be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rotation as R
from ..functions.geo import bearing_degrees, compass, haversine_m, position
from ..plans.ordered import CHUNK, HALO, halo_one_row, running
from ..plans.quantiles import exact_quantiles
from ..session import freeze
from .asof import nearest
from .signals import is_finite
from .smoothing import high_pass, time_derivative

KEYS = ("video_id",)
GRAVITY = 9.80665
AXES = "XYZ"


def quaternion() -> Column:
    return R.unit_quaternion(*[F.col(f"q{c}").cast("double") for c in "wxyz"])


# -- pitch ------------------------------------------------------------------


def pitch_series(telemetry: DataFrame, *, keys: Sequence[str] = KEYS, width: float = 300.0) -> DataFrame:
    """Pitch (degrees) and its rate (degrees/s) over the samples with an attitude.

    Videos with fewer than three such samples give no rows.
    """
    # The filter looks at the inputs: one on the angle would be pushed down as its whole formula.
    n = F.sqrt(sum((F.col(f"q{c}").cast("double") * F.col(f"q{c}") for c in "wxyz"), F.lit(0.0)))
    seen = telemetry.where((n >= 1e-6) & (n < F.lit(float("inf"))) & is_finite(F.col("t")))
    pitch = seen.withColumn("_q", quaternion()).select(*keys, "t", R.euler_degrees(F.col("_q"))["pitch"].alias("pitch"))
    enough = pitch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 3).select(*keys)
    return time_derivative(
        pitch.join(enough, list(keys), "left_semi"), {"rate": "pitch"}, keys=keys, width=width
    )


def window_rms(
    windows: DataFrame,
    rates: DataFrame,
    *,
    value: str = "rate",
    offset: float = 0.0,
    bucket: float = 2.0,
    name: str = "pitch_rate_rms",
    keys: Sequence[str] = KEYS,
    ids: Sequence[str] = ("window_index",),
) -> DataFrame:
    """Root mean square of the samples with start+offset <= t < end+offset, per window.

    `ids` tells the windows of a key apart.

    Windows are spread over time buckets, a sample lies in one; both meet on (key,
    bucket) and the exact bounds are checked there. Windows without a sample are absent.
    """
    keys = list(keys)
    edge = lambda x, shift: F.floor((x + shift) / bucket).cast("long")
    spans = windows.select(*keys, *ids, "start_s", "end_s").withColumn(
        "_b", F.explode(F.sequence(edge(F.col("start_s"), -1e-6), edge(F.col("end_s"), 1e-6)))
    )
    points = rates.select(*keys, F.col("t").alias("_t"), F.col(value).alias("_v"), edge(F.col("t") - offset, 0.0).alias("_b"))
    hit = spans.join(points, [*keys, "_b"]).where(
        (F.col("_t") >= F.col("start_s") + offset) & (F.col("_t") < F.col("end_s") + offset)
    )
    return hit.groupBy(*keys, *ids).agg(F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias(name))


def missing_telemetry(windows: DataFrame, name: str = "pitch_rate_rms", *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Windows without a telemetry value, as issue rows."""
    return windows.where(F.col(name).isNull()).select(
        *keys,
        F.lit("error").alias("severity"),
        F.lit("no_telemetry").alias("code"),
        F.concat(
            F.lit("no telemetry sample in window "), F.col("window_index").cast("string")
        ).alias("message"),
    )


# -- accelerations ----------------------------------------------------------


def _upper_medians(df: DataFrame, columns: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    q = exact_quantiles(df, keys, columns, [0.5], upper=True)
    return q.select(*keys, *[F.col(n)[0].alias(n) for n in columns])


def acceleration_units(telemetry: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per video: unit of the accelerometer guessed from its median length, factor to g, axis medians in g."""
    a = tuple(F.col(f"a{c}").cast("double") for c in "xyz")
    rows = telemetry.where(a[0].isNotNull() & a[1].isNotNull() & a[2].isNotNull())
    med = _upper_medians(
        rows, {"unit_median": R.length(a)} | {f"med_{n}": c for n, c in zip("xyz", a)}, keys
    )
    m = F.col("unit_median")
    # fixed values: typical range of a resting sensor in g, m/s2 and mg
    unit = F.when(m.between(0.5, 3.0), "g").when(m.between(5.0, 30.0), "m/s2").when(m.between(500.0, 3000.0), "mg").otherwise("unknown")
    factor = F.when(F.col("unit") == "m/s2", 1 / GRAVITY).when(F.col("unit") == "mg", 1e-3).otherwise(1.0)
    return (
        med.withColumn("unit", unit)
        .withColumn("unit_scale", factor)
        .withColumns({f"med_{c}": F.col(f"med_{c}") * F.col("unit_scale") for c in "xyz"})
    )


def axis_mapping(units: DataFrame, *, axes: str = "auto", invert: Sequence[str] = ()) -> DataFrame:
    """Which sensor axis points sideways, ahead and up, and which are flipped.

    "auto" takes the axis with the largest absolute median as vertical. Otherwise
    `axes` names lateral, longitudinal and vertical, as in "YXZ".
    """
    unknown = set(invert) - {"lateral", "longitudinal", "vertical"}
    if unknown:
        raise ValueError(f"cannot invert {sorted(unknown)}")
    if axes == "auto":
        size = {c: F.abs(F.col(f"med_{c}")) for c in "xyz"}
        vertical = (
            F.when((size["x"] >= size["y"]) & (size["x"] >= size["z"]), "X")
            .when(size["y"] >= size["z"], "Y")
            .otherwise("Z")
        )
        out = units.withColumn("vertical_axis", vertical).withColumns(
            {
                "lateral_axis": F.when(F.col("vertical_axis") == "Y", "Z").otherwise("Y"),
                "longitudinal_axis": F.when(F.col("vertical_axis") == "X", "Z").otherwise("X"),
            }
        )
        median = F.when(F.col("vertical_axis") == "X", F.col("med_x")).when(
            F.col("vertical_axis") == "Y", F.col("med_y")
        ).otherwise(F.col("med_z"))
        flips = {"lateral": F.lit(True), "longitudinal": F.lit(False), "vertical": median < 0}
    else:
        if sorted(axes.upper()) != list(AXES):
            raise ValueError("axes is 'auto' or an ordering of X, Y and Z")
        names = ("lateral", "longitudinal", "vertical")
        out = units.withColumns({f"{n}_axis": F.lit(a) for n, a in zip(names, axes.upper())})
        flips = {n: F.lit(False) for n in names}
    return out.withColumns({f"invert_{n}": ~f if n in invert else f for n, f in flips.items()})


def _along(v: tuple[Column, ...], axis: Column) -> Column:
    return F.when(axis == "X", v[0]).when(axis == "Y", v[1]).otherwise(v[2])


def vehicle_motion(
    telemetry: DataFrame,
    *,
    gravity: str = "quat",
    highpass_seconds: float = 1.0,
    level: bool = True,
    axes: str = "auto",
    invert: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Lateral, longitudinal, vertical and combined acceleration (g) and attitude per sample.

    Gravity is the median of the accelerations turned into world axes ("quat", from ten
    samples with attitude on), else what a slow moving mean holds ("highpass", also the
    fallback), or left in ("none"). Levelling turns measured gravity onto the vertical
    axis. Samples without acceleration keep null accelerations.
    """
    if gravity not in ("quat", "highpass", "none"):
        raise ValueError("gravity is quat, highpass or none")
    keys = list(keys)
    frame = axis_mapping(acceleration_units(telemetry, keys=keys), axes=axes, invert=invert)
    rows = telemetry.withColumn("_q", quaternion()).join(frame, keys, "left")
    rows = R.keep(rows, "_q", tuple(F.col("_q")[c] for c in "wxyz"), "wxyz")
    complete = F.col("ax").isNotNull() & F.col("ay").isNotNull() & F.col("az").isNotNull()
    rows = R.keep(
        rows, "_a", tuple(F.when(complete, F.col(f"a{c}").cast("double") * F.col("unit_scale")) for c in "xyz")
    )
    q, acc = R.named("_q", "wxyz"), R.named("_a")
    rows = freeze(R.keep(rows, "_w", R.rotate(q, acc)))  # read for the medians, the counts and the motion
    pull = _upper_medians(rows, {f"_g{c}": F.col(f"_w{c}") for c in "xyz"}, keys)
    enough = rows.groupBy(*keys).agg(F.count("_wx").alias("_nw")).where(F.col("_nw") >= 10)
    rows = rows.join(pull.join(enough, keys).drop("_nw"), keys, "left")
    pulled = F.col("_gx").isNotNull()

    if gravity == "none":
        rows = R.keep(rows, "_d", acc).withColumn("gravity_used", F.lit("none"))
    else:
        by_attitude = pulled if gravity == "quat" else F.lit(False)
        used = "highpass (fallback)" if gravity == "quat" else "highpass"
        turned = R.keep(rows.where(by_attitude), "_r", R.minus(R.named("_w"), R.named("_g")))
        turned = R.keep(turned, "_d", R.rotate(q, R.named("_r"), inverse=True)).drop("_rx", "_ry", "_rz")
        out = turned.withColumn("gravity_used", F.lit("quat"))
        # The moving mean is planned only when some video needs it.
        if gravity == "highpass" or not telemetry.join(enough, keys, "left_anti").isEmpty():
            slow = freeze(R.keep(rows.where(~by_attitude), "_d", acc))  # read once per running sum
            slow = high_pass(slow, ["_dx", "_dy", "_dz"], seconds=highpass_seconds, keys=keys)
            out = out.unionByName(slow.withColumn("gravity_used", F.lit(used)))
        rows = out

    rows = rows.withColumns({"_gn": R.length(R.named("_g")), "_mn": R.length(R.named("med_"))})
    rows = R.keep(rows, "_u", R.unit(R.named("_g"), F.col("_gn")))
    rows = R.keep(rows, "_v", R.rotate(q, R.named("_u"), inverse=True))
    rows = rows.withColumn("_vn", R.length(R.named("_v")))
    sees = F.col("_ux").isNotNull() & F.col("_qw").isNotNull()
    static = R.unit(R.named("med_"), F.col("_mn"), 0.5)
    down = tuple(F.when(sees, m).otherwise(s) for m, s in zip(R.unit(R.named("_v"), F.col("_vn")), static))
    sign = F.when(F.col("invert_vertical"), -1.0).otherwise(1.0)
    up = tuple(F.when(F.col("vertical_axis") == a, sign).otherwise(0.0) for a in AXES)
    rows = R.keep(R.keep(rows, "_n", down), "_t", up)
    known = F.col("_nx").isNotNull()
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), R.dot(R.named("_n"), R.named("_t"))))
    rows = rows.withColumn("tilt", F.when(F.col("_dx").isNotNull() & known, F.degrees(F.acos(cosine))))
    if level:
        rows = R.rotate_onto(rows, R.named("_n"), R.named("_t"), R.named("_d"), "_l")
        rows = R.keep(rows, "_d", tuple(F.when(known, l).otherwise(d) for l, d in zip(R.named("_l"), R.named("_d"))))
    along = {
        n: _along(R.named("_d"), F.col(f"{n}_axis")) * F.when(F.col(f"invert_{n}"), -1.0).otherwise(1.0)
        for n in ("lateral", "longitudinal", "vertical")
    }
    angle = R.euler_degrees(F.col("_q"))
    return (
        rows.withColumns(along)
        .withColumn("combined", F.hypot("lateral", "longitudinal"))
        .select(
            *telemetry.columns,
            *[F.col(f"_a{c}").alias(f"acc_{c}_g") for c in "xyz"],
            "lateral",
            "longitudinal",
            "vertical",
            "combined",
            *[angle[n].alias(n) for n in ("roll", "pitch", "yaw")],
            "tilt",
            "unit",
            "gravity_used",
        )
    )


def camera_tilt(motion: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Upper median of the tilt between measured gravity and the vertical axis; null without any."""
    return _upper_medians(motion, {"tilt_deg": F.col("tilt")}, keys)


# -- clocks -----------------------------------------------------------------


def sample_times(raw: DataFrame, *, order: str = "frame", keys: Sequence[str] = KEYS) -> DataFrame:
    """`t` from the device clock (`timestamp_us`, relative to the first one), else `track_time`."""
    first = raw.where(F.col("timestamp_us").isNotNull()).groupBy(*keys).agg(
        F.min_by("timestamp_us", order).alias("_base")
    )
    device = (F.col("timestamp_us") - F.col("_base")) / 1e6
    return raw.join(first, list(keys), "left").withColumn("t", F.coalesce(device, F.col("track_time"))).drop("_base")


# fixed value: recordings are named with this prefix and a 14-digit date and time
NAME_PATTERN = r"(?:^|[/\\])DJI_(\d{14})[^/\\]*$"


def recording_start(
    telemetry: DataFrame, videos: DataFrame, *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Absolute start per video: first satellite time minus t, else file name, else container time."""
    fixed = telemetry.where(F.col("gps_time").isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct("t", "gps_time"), "t").alias("_g")
    )
    micros = lambda ts: F.unix_micros(ts)
    by_gps = F.timestamp_micros(micros(F.col("_g.gps_time")) - F.round(F.col("_g.t") * 1e6).cast("long"))
    by_name = F.try_to_timestamp(
        F.nullif(F.regexp_extract("video", NAME_PATTERN, 1), F.lit("")), F.lit("yyyyMMddHHmmss")
    )
    made = F.col("creation_time")
    return videos.join(fixed, list(keys), "left").select(
        *keys,
        F.coalesce(by_gps, by_name, made).alias("start_time"),
        F.when(by_gps.isNotNull(), "satellite")
        .when(by_name.isNotNull(), "file name")
        .when(made.isNotNull(), "container")
        .otherwise("unknown")
        .alias("start_source"),
    )


def align_clocks(
    frames: DataFrame,
    ride: DataFrame,
    *,
    video_epoch: Column,
    ride_start: Column,
    offset: float = 0.0,
    keys: Sequence[str] = KEYS,
    width: float = 60.0,
) -> DataFrame:
    """The ride sample nearest to each video frame, across the two clocks.

    `ride.t` counts from the start of the ride; both epochs are columns of `frames`.
    """
    shifted = frames.withColumn("ride_t", video_epoch + F.col("t") + offset - ride_start)
    return nearest(shifted, ride, left_t="ride_t", right_t="t", keys=keys, prefix="ride_", width=width)


def cadence(telemetry: DataFrame, *, keys: Sequence[str] = KEYS, width: float = 300.0) -> DataFrame:
    """Samples per second, from the median positive step; 1.0 where there is none."""
    near = halo_one_row(telemetry.select(*keys, "t").distinct(), keys, "t", width)
    w = W.partitionBy(*keys, CHUNK).orderBy("t")
    steps = near.select(*keys, HALO, (F.col("t") - F.lag("t").over(w)).alias("step")).where(
        ~F.col(HALO) & (F.col("step") > 0)
    )
    med = exact_quantiles(steps, keys, {"step": F.col("step")}, [0.5])
    return telemetry.select(*keys).distinct().join(med, list(keys), "left").select(
        *keys, F.coalesce(1 / F.col("step")[0], F.lit(1.0)).alias("rate_hz")
    )


def covered_cadence(log: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Records per second over the covered interval, for logs with start and end times."""
    span = F.max_by("end_s", "start_s") - F.min("start_s")
    return log.groupBy(*keys).agg(
        F.when(span > 0, F.count(F.lit(1)) / span).otherwise(1.0).alias("rate_hz")
    )


# -- positions --------------------------------------------------------------


def valid_fix(telemetry: DataFrame, *, unit: str | None = None, status: str | None = None) -> DataFrame:
    """Null out fixes that cannot be positions; radians (unit 0) become degrees."""
    fix = position(F.col("lat"), F.col("lon"), F.col(unit) if unit else None)
    if status:
        fix = F.when(F.coalesce(F.col(status), F.lit(0)) != 1, fix)
    return telemetry.withColumn("_fix", fix).withColumns(
        {"lat": F.col("_fix.lat"), "lon": F.col("_fix.lon")}
    ).drop("_fix")


def gps_track(telemetry: DataFrame, *, keys: Sequence[str] = KEYS, width: float = 300.0) -> DataFrame:
    """Rows with a fix, plus step, running distance, speed and heading.

    Device velocity wins where there is one; otherwise speed and heading come from the
    step since the previous fix, the heading only when it is longer than 5 cm.
    """
    keys = list(keys)
    fixes = telemetry.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    for c in ("vx", "vy"):
        if c not in fixes.columns:
            fixes = fixes.withColumn(c, F.lit(None).cast("double"))
    near = halo_one_row(fixes, keys, "t", width)
    w = W.partitionBy(*keys, CHUNK).orderBy("t")
    near = near.withColumns({f"_{c}": F.lag(c).over(w) for c in ("t", "lat", "lon")}).where(~F.col(HALO))
    here, there = (F.col("_lat"), F.col("_lon")), (F.col("lat"), F.col("lon"))
    device = F.col("vx").isNotNull() & F.col("vy").isNotNull()
    moving = (F.col("vx") != 0) | (F.col("vy") != 0)
    steps = near.withColumn("step_m", haversine_m(*here, *there)).withColumns(
        {
            "speed_ms": F.when(device, F.hypot("vx", "vy")).when(
                F.col("t") > F.col("_t"), F.col("step_m") / (F.col("t") - F.col("_t"))
            ),
            "heading_deg": F.when(
                device, F.when(moving, compass(F.degrees(F.atan2("vx", "vy"))))
            ).when(F.col("step_m") > 0.05, bearing_degrees(*here, *there)),
        }
    ).drop(CHUNK, HALO, "_t", "_lat", "_lon")
    own = F.coalesce(F.col("step_m"), F.lit(0.0))
    total = running(steps, keys, F.col("t"), width, [F.col("t")], {"_before": ("sum", own)})
    return total.withColumn("distance_m", F.col("_before") + own).drop("_before")


# -- rates and ranges -------------------------------------------------------

UPSAMPLED = ("speed", "gradient", "altitude", "total_power", "lat", "lon")


def upsample(
    telemetry: DataFrame,
    per_interval: int,
    *,
    names: Sequence[str] = UPSAMPLED,
    keys: Sequence[str] = KEYS,
    width: float = 300.0,
) -> DataFrame:
    """`per_interval` rows per sample, `names` interpolated towards the next sample.

    The last sample of a key stays one row. A null on either side keeps the own value.
    """
    keys = list(keys)
    names = [n for n in names if n in telemetry.columns]
    near = halo_one_row(telemetry, keys, "t", width)
    w = W.partitionBy(*keys, CHUNK).orderBy("t")
    near = near.withColumns({f"_next_{n}": F.lead(n).over(w) for n in ["t", *names]}).where(~F.col(HALO))
    steps = F.when(F.col("_next_t").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.lit(per_interval - 1))
    )
    out = near.withColumn("step", F.explode(steps))
    share = F.col("step") / F.lit(float(per_interval))
    value = lambda n: F.coalesce(F.col(n) + (F.col(f"_next_{n}") - F.col(n)) * share, F.col(n))
    return out.select(*[value(n).alias(n) if n in names else F.col(n) for n in telemetry.columns], "step")


def between_times(telemetry: DataFrame, start: float, duration: float | None) -> DataFrame:
    """Samples within [start, start + duration], both ends included."""
    out = telemetry.where(F.col("t") >= start)
    return out if duration is None else out.where(F.col("t") <= start + duration)


def paired_fixes(telemetry: DataFrame) -> DataFrame:
    return telemetry.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def display_range(telemetry: DataFrame, value: str, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Smallest and largest value with 5 % room on both sides; a flat one gets 0.05."""
    lo, hi = F.min(value), F.max(value)
    room = F.when(hi - lo < 1e-9, 0.05).otherwise((hi - lo) * 0.05)
    return telemetry.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        (lo - room).alias("range_low"), (hi + room).alias("range_high")
    )


# fixed values: ride channel -> divisor of the stored integer
RIDE_ZERO_WHEN_MISSING = {
    "speed": 100,
    "cadence": 100,
    "motor_torque": 100,
    "rider_torque": 100,
    "total_torque": 100,
    "rider_power": 100,
    "motor_power": 100,
    "total_power": 100,
    "distance_km": 1000,
    "rider_energy_kj": 1000,
    "odometer_km": 1000,
}
RIDE_NULL_WHEN_MISSING = {"altitude": 100, "gradient": 100}
RIDE_NO_TEMPERATURE = -99900


def ride_channels(raw: DataFrame) -> DataFrame:
    """Stored ride integers in their units. Columns that are not channels stay as they are."""
    rules: dict[str, Column] = {}
    for name, divisor in RIDE_ZERO_WHEN_MISSING.items():
        rules[name] = F.coalesce(F.col(name), F.lit(0)) / divisor
    for name, divisor in RIDE_NULL_WHEN_MISSING.items():
        rules[name] = F.col(name) / divisor
    rules["temperature"] = F.when(F.col("temperature") != RIDE_NO_TEMPERATURE, F.col("temperature") / 100)
    rules["pressure"] = F.when(F.col("pressure") != 0, F.col("pressure") / 100)
    out = raw.withColumns({n: c for n, c in rules.items() if n in raw.columns})
    if "timestamp" in raw.columns:
        out = out.withColumn("date", F.when(F.col("timestamp") != 0, F.timestamp_seconds("timestamp")))
    return out
