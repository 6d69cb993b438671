"""Scalar expressions: rounding bounds, error-free sums, time encoding, damping, vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridspark.contracts import require

# Machine epsilon of the two accumulator types.
EPS = {"f64": 2.0**-52, "f32": 2.0**-23}
DAY_SECONDS = 86400.0


def accumulator(x: Column, kind: str = "f64") -> Column:
    """`x` in the accumulator type, cast before any product is taken."""
    require(kind in EPS, "accumulator", "accumulator", f"{kind!r} is neither f32 nor f64")
    return x.cast("float" if kind == "f32" else "double")


def error_bound(n: Column, magnitude: Column, kind: str = "f64") -> Column:
    """n * eps * sum|x|, widened by one ulp; null at and beyond the validity limit 2/eps."""
    bound = n.cast("double") * F.lit(EPS[kind]) * magnitude
    widened = bound * F.lit(1.0 + EPS["f64"])
    return F.when((n.cast("double") < F.lit(2.0 / EPS[kind])) & (magnitude >= 0), widened)


def two_sum_error(a: Column, b: Column, s: Column) -> Column:
    """The exact rounding error of s = a + b."""
    v = s - a
    return (a - (s - v)) + (b - v)


def quantile_rank(n: Column, q: Column) -> Column:
    """The 1-based order statistic a probability selects: clamp(ceil(q n), 1, n)."""
    return F.greatest(F.lit(1), F.least(n, F.ceil(q * n).cast("bigint"))).cast("bigint")


def encode_time(t: Column) -> tuple[Column, Column]:
    """(whole seconds, fraction in [0, 1))."""
    whole = F.floor(t).cast("bigint")
    return whole, t - whole.cast("double")


def decode_time(whole: Column, fraction: Column) -> Column:
    return whole.cast("double") + fraction


def damping(elapsed: Column, timescale: Column) -> Column:
    """exp(-elapsed / timescale), both in seconds."""
    return F.exp(-elapsed / timescale)


def damping_in_rotations(elapsed: Column, rotations: Column, rotation_seconds: Column) -> Column:
    return F.exp(-elapsed / (rotations * rotation_seconds))


def ratio_to_unit(x: Column, unit: Column) -> Column:
    """A quantity reported as a multiple of a sourced constant of the same dimension."""
    return x / unit


# Vectors as (x, y, z) triples of columns.

Triple = tuple[Column, Column, Column]


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Triple, b: Triple) -> Triple:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def minus(a: Triple, b: Triple) -> Triple:
    return (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def plus(a: Triple, b: Triple) -> Triple:
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2])


def norm(a: Triple) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Triple) -> Triple:
    n = norm(a)
    return (a[0] / n, a[1] / n, a[2] / n)


def arc_length(a: Triple, b: Triple) -> Column:
    return F.atan2(norm(cross(a, b)), dot(a, b))


def midpoint(a: Triple, b: Triple) -> Triple:
    return normalize(plus(a, b))


def circumcentre(a: Triple, b: Triple, c: Triple) -> Triple:
    """The pole of the small circle through three corners, on their own side of the sphere."""
    n = cross(minus(b, a), minus(c, a))
    sign = F.when(dot(n, plus(plus(a, b), c)) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return normalize((n[0] * sign, n[1] * sign, n[2] * sign))


def triangle_area(a: Triple, b: Triple, c: Triple) -> Column:
    """Spherical excess from the triple product."""
    triple = dot(a, cross(b, c))
    return 2.0 * F.atan2(F.abs(triple), 1.0 + dot(a, b) + dot(b, c) + dot(c, a))


def triangle_area_by_sides(a: Triple, b: Triple, c: Triple) -> Column:
    """Spherical excess from the three arc lengths (l'Huilier), the check of `triangle_area`."""
    p, q, r = arc_length(b, c), arc_length(c, a), arc_length(a, b)
    s = (p + q + r) / 2.0
    t = F.tan(s / 2) * F.tan((s - p) / 2) * F.tan((s - q) / 2) * F.tan((s - r) / 2)
    return 4.0 * F.atan(F.sqrt(t))


def latitude(p: Triple) -> Column:
    return F.atan2(p[2], F.hypot(p[0], p[1]))


def longitude(p: Triple) -> Column:
    """In (-pi, pi]; adding zero turns -0.0 into 0.0 so the date line has one sign."""
    return F.atan2(p[1] + F.lit(0.0), p[0])


def east_north_frame(lat: Column, lon: Column) -> tuple[Triple, Triple]:
    """The unit east and north vectors at a point."""
    east = (-F.sin(lon), F.cos(lon), F.lit(0.0))
    north = (-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat))
    return east, north


def lift(u_east: Column, u_north: Column, lat: Column, lon: Column) -> Triple:
    e, n = east_north_frame(lat, lon)
    return tuple(u_east * e[i] + u_north * n[i] for i in range(3))


def project(v: Triple, lat: Column, lon: Column) -> tuple[Column, Column]:
    e, n = east_north_frame(lat, lon)
    return dot(v, e), dot(v, n)
