"""Number theory, interpolation, fixed point, geometry, vectors, matrices and easing curves."""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col, let

BIG = T.DecimalType(38, 0)


# Whole numbers (decimal(38, 0); results that don't fit are null)


def big(function):
    """A pandas UDF over whole numbers of any size; null in, null out."""

    @F.pandas_udf(BIG)
    def run(*columns: pd.Series) -> pd.Series:
        def one(*values):
            if any(v is None or v != v for v in values):
                return None
            r = function(*(int(v) for v in values))
            return None if r is None or abs(r) >= 10**38 else Decimal(r)

        return pd.Series([one(*v) for v in zip(*columns, strict=True)], dtype=object)

    return lambda *columns: run(*[col(c).cast(BIG) for c in columns])


gcd = big(math.gcd)
lcm = big(math.lcm)
mod_pow = big(lambda a, b, m: pow(a, b, m) if m > 0 and (b >= 0 or math.gcd(a, m) == 1) else None)
mod_inv = big(lambda a, m: pow(a, -1, m) if m > 0 and math.gcd(a, m) == 1 else None)


def is_prime_number(n: int) -> bool:
    """Miller-Rabin with the first 13 primes as bases: exact below 3.3e24."""
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
    if n < 2:
        return False
    for p in small:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in small:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def is_prime(n: Column | str) -> Column:
    return big(lambda v: int(is_prime_number(v)))(n) == 1


def to_radix(n: Column | str, base: int) -> Column:
    return F.lower(F.conv(col(n).cast("string"), 10, base))


def from_radix(s: Column | str, base: int) -> Column:
    return F.conv(col(s), base, 10).cast("long")


def to_bytes(n: Column | str) -> Column:
    """Big-endian bytes of a 64-bit whole number, without leading zeros."""
    digits = F.hex(col(n).cast("long"))
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits))


def from_bytes(b: Column | str) -> Column:
    return F.conv(F.hex(col(b)), 16, 10).cast(BIG)


# Interpolation


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def linear(a, b, t) -> Column:
    return col(a) + col(t) * (col(b) - col(a))


def smoothstep(lo, hi, x) -> Column:
    t = clamp((col(x) - col(lo)) / (col(hi) - col(lo)), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def smootherstep(lo, hi, x) -> Column:
    t = clamp((col(x) - col(lo)) / (col(hi) - col(lo)), 0.0, 1.0)
    return t * t * t * (t * (t * 6 - 15) + 10)


def hermite(p0, m0, p1, m1, t) -> Column:
    p0, m0, p1, m1, t = map(col, (p0, m0, p1, m1, t))
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * p0 + (t3 - 2 * t2 + t) * m0 + (3 * t2 - 2 * t3) * p1 + (t3 - t2) * m1


def catmull_rom(p0, p1, p2, p3, t, tension: float = 0.5) -> Column:
    return hermite(p1, tension * (col(p2) - col(p0)), p2, tension * (col(p3) - col(p1)), t)


def bezier(points: list, t) -> Column:
    """de Casteljau's scheme over any number of control values."""
    row = [col(p) for p in points]
    while len(row) > 1:
        row = [linear(a, b, t) for a, b in zip(row, row[1:], strict=False)]
    return row[0]


def bilinear(a, b, c, d, x, y) -> Column:
    """Corner values a (0,0), b (1,0), c (0,1), d (1,1)."""
    return linear(linear(a, b, x), linear(c, d, x), y)


def bicubic(grid: list[list], x, y) -> Column:
    """A 4 x 4 grid of values around the unit square."""
    return catmull_rom(*[catmull_rom(*row, x) for row in grid], y)


def barycentric(values: list, weights: list) -> Column:
    out = F.lit(0.0)
    for v, w in zip(values, weights, strict=True):
        out = out + col(v) * col(w)
    return out


def sample_curve(xs: Column, ys: Column, x) -> Column:
    """Piecewise linear through sorted array points; constant beyond the ends."""
    n = F.size(xs)
    at = F.greatest(F.least(F.size(F.filter(xs, lambda v: v <= col(x))), n - 1), F.lit(1))
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(x) - x0) / F.nullif(x1 - x0, F.lit(0.0))))
    return F.when(n == 1, F.get(ys, F.lit(0))).otherwise(y0 + F.coalesce(t, F.lit(0.0)) * (y1 - y0))


# Fixed point


def from_fixed(n: Column | str, fraction_bits: int = 16) -> Column:
    return col(n) / F.lit(float(1 << fraction_bits))


def to_fixed(x: Column | str, fraction_bits: int = 16) -> Column:
    return F.floor(col(x) * (1 << fraction_bits) + 0.5).cast("long")


# Geometry. Points: struct<x, y>; polygons: array of points.


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def circle_contains(cx, cy, r, p: Column) -> Column:
    return F.pow(p["x"] - col(cx), 2) + F.pow(p["y"] - col(cy), 2) <= F.pow(col(r), 2)


def circles_meet(ax, ay, ar, bx, by, br) -> Column:
    return F.pow(col(ax) - col(bx), 2) + F.pow(col(ay) - col(by), 2) <= F.pow(col(ar) + col(br), 2)


def rect_contains(x, y, w, h, p: Column) -> Column:
    return (p["x"] >= col(x)) & (p["x"] <= col(x) + col(w)) & (p["y"] >= col(y)) & (p["y"] <= col(y) + col(h))


def rects_meet(a: tuple, b: tuple) -> Column:
    ax, ay, aw, ah = map(col, a)
    bx, by, bw, bh = map(col, b)
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def line_length(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def closest_on_line(a: Column, b: Column, p: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.when(size > 0, size)))
    t = F.when(size > 0, t).otherwise(0.0)
    return point(a["x"] + t * dx, a["y"] + t * dy)


def distance_to_line(a: Column, b: Column, p: Column) -> Column:
    return line_length(closest_on_line(a, b, p), p)


def lines_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The point where segments ab and cd cross; null if they don't or are parallel."""
    den = (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])
    safe = F.when(den != 0, den)
    t = ((c["x"] - a["x"]) * (d["y"] - c["y"]) - (c["y"] - a["y"]) * (d["x"] - c["x"])) / safe
    u = ((c["x"] - a["x"]) * (b["y"] - a["y"]) - (c["y"] - a["y"]) * (b["x"] - a["x"])) / safe
    return F.when(t.between(0, 1) & u.between(0, 1), point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])))


def edges_of(polygon: Column) -> Column:
    return F.transform(polygon, lambda p, i: F.struct(p.alias("a"), F.get(polygon, F.pmod(i + 1, F.size(polygon))).alias("b")))


def signed_area(polygon: Column) -> Column:
    return F.aggregate(edges_of(polygon), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def polygon_area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon))


def is_ccw(polygon: Column) -> Column:
    return signed_area(polygon) > 0


def bbox(polygon: Column) -> Column:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


def polygon_contains(polygon: Column, p: Column) -> Column:
    """Even-odd rule."""
    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dy = b["y"] - a["y"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.when(dy != 0, dy).otherwise(1.0) + a["x"])

    return F.size(F.filter(edges_of(polygon), crossing)) % 2 == 1


def simplify(polygon: Column | str, tolerance: float) -> Column:
    """Ramer-Douglas-Peucker on an open line of points."""

    def reduce(points):
        keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
        while todo:
            i, j = todo.pop()
            (ax, ay), (bx, by) = points[i], points[j]
            size, far, at = math.hypot(bx - ax, by - ay), tolerance, -1
            for k in range(i + 1, j):
                x, y = points[k]
                d = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / size if size else math.hypot(x - ax, y - ay)
                if d > far:
                    far, at = d, k
            if at >= 0:
                keep.add(at)
                todo += [(i, at), (at, j)]
        return [points[k] for k in sorted(keep)]

    kind = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))

    @F.udf(kind, useArrow=True)
    def run(points):
        if points is None:
            return None
        pts = [(p["x"], p["y"]) for p in points]
        return [{"x": x, "y": y} for x, y in (reduce(pts) if len(pts) > 2 else pts)]

    return run(col(polygon))


def hit_test(shapes: Column, p: Column) -> Column:
    """The index of the last (topmost) rectangle struct<x, y, width, height> that holds the point; -1 for none."""
    hits = F.transform(shapes, lambda s, i: F.when((p["x"] >= s["x"]) & (p["x"] <= s["x"] + s["width"]) & (p["y"] >= s["y"]) & (p["y"] <= s["y"] + s["height"]), i).otherwise(-1))
    return F.coalesce(F.array_max(hits), F.lit(-1))


def transformed(p: Column, m: list[float]) -> Column:
    """An affine transform [a, b, c, d, e, f] of a point."""
    a, b, c, d, e, f = map(F.lit, map(float, m))
    return point(a * p["x"] + c * p["y"] + e, b * p["x"] + d * p["y"] + f)


# Vectors and matrices


def pairwise(a, b, op) -> Column:
    return F.zip_with(col(a), col(b), op)


def vector_add(a, b) -> Column:
    return pairwise(a, b, lambda x, y: x + y)


def vector_sub(a, b) -> Column:
    return pairwise(a, b, lambda x, y: x - y)


def vector_mul(a, b) -> Column:
    return pairwise(a, b, lambda x, y: x * y)


def vector_scale(a, k) -> Column:
    return F.transform(col(a), lambda x: x * k)


def dot(a, b) -> Column:
    return F.aggregate(pairwise(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_length(a) -> Column:
    return F.sqrt(dot(a, a))


def distance(a, b) -> Column:
    return let(pairwise(a, b, lambda x, y: x.cast("double") - y.cast("double")), lambda d: F.sqrt(dot(d, d)))


def cosine(a, b) -> Column:
    return dot(a, b) / F.nullif(vector_length(a) * vector_length(b), F.lit(0.0))


def vector_normalize(a) -> Column:
    return let(vector_length(a), lambda n: F.transform(col(a), lambda x: F.when(n > 0, x / F.when(n > 0, n)).otherwise(0.0)))


def lerp(a, b, t) -> Column:
    return pairwise(a, b, lambda x, y: x + t * (y - x))


def matrix_multiply(a, b) -> Column:
    """Matrices as arrays of rows."""
    columns = lambda m: F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))
    return let(columns(col(b)), lambda cols: F.transform(col(a), lambda row: F.transform(cols, lambda c: dot(row, c))))


def transpose(m) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(col(m), F.lit(0))) - 1), lambda j: F.transform(col(m), lambda r: F.get(r, j)))


def invert(m) -> Column:
    """The inverse of a square matrix; null if singular."""
    import numpy as np

    @F.udf(T.ArrayType(T.ArrayType(T.DoubleType())), useArrow=True)
    def run(rows):
        try:
            return None if rows is None else np.linalg.inv(np.array([list(r) for r in rows], dtype=float)).tolist()
        except np.linalg.LinAlgError:
            return None

    return run(col(m))


# Easing: (t, b, c, d) is time, start, change, duration.


def _in(kind: str, x: Column) -> Column:
    """The accelerating half of a curve over [0, 1]."""
    powers = {"Quad": 2, "Cubic": 3, "Quart": 4, "Quint": 5}
    if kind in powers:
        return F.pow(x, F.lit(powers[kind]))
    if kind == "Sine":
        return 1 - F.cos(x * math.pi / 2)
    if kind == "Expo":
        return F.when(x == 0, 0.0).otherwise(F.pow(F.lit(2.0), 10 * (x - 1)))
    if kind == "Circ":
        return 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - x * x))
    if kind == "Back":
        s = 1.70158
        return x * x * ((s + 1) * x - s)
    if kind == "Elastic":
        return F.when(x == 0, 0.0).when(x == 1, 1.0).otherwise(-F.pow(F.lit(2.0), 10 * (x - 1)) * F.sin((x - 1 - 0.075) * 2 * math.pi / 0.3))
    if kind == "Bounce":
        return 1 - bounce(1 - x)
    raise ValueError(f"no easing {kind!r}")


def bounce(x: Column) -> Column:
    n, d = 7.5625, 2.75
    return (
        F.when(x < 1 / d, n * x * x).when(x < 2 / d, n * (x - 1.5 / d) * (x - 1.5 / d) + 0.75)
        .when(x < 2.5 / d, n * (x - 2.25 / d) * (x - 2.25 / d) + 0.9375).otherwise(n * (x - 2.625 / d) * (x - 2.625 / d) + 0.984375)
    )


def ease(name: str, t, b=0.0, c=1.0, d=1.0) -> Column:
    """linear, or easeIn / easeOut / easeInOut and Quad, Cubic, Quart, Quint, Sine, Expo, Circ, Elastic, Back, Bounce."""
    x = col(t) / d
    if name == "linear":
        return b + c * x
    if name.startswith("easeInOut"):
        kind = name.removeprefix("easeInOut")
        y = F.when(x < 0.5, _in(kind, 2 * x) / 2).otherwise(1 - _in(kind, 2 - 2 * x) / 2)
    elif name.startswith("easeOut"):
        y = 1 - _in(name.removeprefix("easeOut"), 1 - x)
    else:
        y = _in(name.removeprefix("easeIn"), x)
    return b + c * y
