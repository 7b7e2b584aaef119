"""Quaternions (w, x, y, z) and 3-vectors as tuples of columns.

Vectors are tuples of plain columns, not structs: Spark inlines a struct into whatever
reads its fields, so chained rotations of structs grow without bound. Steps that reuse a
result therefore store it as scalar columns with `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]


def named(prefix: str, parts: str = "xyz") -> tuple[Column, ...]:
    return tuple(F.col(prefix + p) for p in parts)


def keep(df: DataFrame, prefix: str, v: tuple[Column, ...], parts: str = "xyz") -> DataFrame:
    return df.withColumns({prefix + p: c for p, c in zip(parts, v)})


def fixed(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, n: Column, floor: float = 1e-9) -> Vec:
    """`a` divided by its length `n`; null when that is not above `floor`."""
    return tuple(F.when(n > floor, p / n) for p in a)


def unit_quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Normalized quaternion as a struct; null when its norm is below 1e-6 or not finite."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    return F.when(
        (n >= 1e-6) & (n < F.lit(float("inf"))),
        F.struct((w / n).alias("w"), (x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z")),
    )


def euler_degrees(q: Column) -> Column:
    """Roll, pitch and yaw of a unit quaternion struct."""
    w, x, y, z = (q[c] for c in "wxyz")
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    return F.when(
        q.isNotNull(),
        F.struct(
            F.degrees(roll).alias("roll"), F.degrees(pitch).alias("pitch"), F.degrees(yaw).alias("yaw")
        ),
    )


def rotate(q: Quat, v: Vec, *, inverse: bool = False) -> Vec:
    """v + 2w(q x v) + 2 q x (q x v); the inverse turns the other way. `q` and `v` are stored columns."""
    axis = tuple(-c if inverse else c for c in q[1:])
    once = tuple(2 * c for c in cross(axis, v))
    twice = cross(axis, once)
    return tuple(p + q[0] * a + b for p, a, b in zip(v, once, twice))


def rotate_onto(df: DataFrame, source: Vec, target: Vec, v: Vec, out: str) -> DataFrame:
    """Add `v` turned by the shortest rotation that takes unit vector `source` to `target`, as `out`x, y, z."""
    df = keep(df, "_k", cross(source, target))
    k = named("_k")
    df = df.withColumns(
        {"_c": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(source, target))), "_s": length(k)}
    )
    c, s = F.col("_c"), F.col("_s")
    # opposite directions: half a turn about any axis at right angles to the source
    flat = F.abs(source[0]) < 0.9
    helper = (F.when(flat, 1.0).otherwise(0.0), F.when(flat, 0.0).otherwise(1.0), F.lit(0.0))
    df = keep(df, "_h", cross(source, helper))
    h = named("_h")
    df = df.withColumn("_hn", length(h))
    df = keep(df, "_h", tuple(F.coalesce(x, y) for x, y in zip(unit(h, F.col("_hn")), fixed(0, 0, 1))))
    df = keep(df, "_k", tuple(F.when(s >= 1e-9, p / s) for p in k))
    df = df.withColumns({"_hv": dot(h, v), "_kv": dot(k, v) * (1 - c)})
    kxv = cross(k, v)
    turned = tuple(
        F.when((s < 1e-9) & (c > 0), v[i])
        .when(s < 1e-9, 2 * h[i] * F.col("_hv") - v[i])
        .otherwise(v[i] * c + kxv[i] * s + k[i] * F.col("_kv"))
        for i in range(3)
    )
    return keep(df, out, turned).drop(*[f"_{n}{p}" for n in "kh" for p in "xyz"], "_c", "_s", "_hn", "_hv", "_kv")
