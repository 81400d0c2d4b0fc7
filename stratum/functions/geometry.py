"""Column functions over points, quads, boxes, bit strings and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lit_col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(lit_col(a), lit_col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroid(quad: Column | str) -> Column:
    """struct<x, y> of the mean corner."""
    quad = lit_col(quad)
    mean = lambda i: F.aggregate(quad, F.lit(0.0), lambda s, p: s + p[i]) / F.size(quad)
    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def bounds(quad: Column | str) -> Column:
    """struct<x0, y0, x1, y1> of a polygon."""
    quad = lit_col(quad)
    axis = lambda i: F.transform(quad, lambda p: p[i])
    return F.struct(F.array_min(axis(0)).alias("x0"), F.array_min(axis(1)).alias("y0"), F.array_max(axis(0)).alias("x1"), F.array_max(axis(1)).alias("y1"))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Shared area of two boxes over the smaller area; areas count as 1 at least."""
    area = lambda q: F.greatest(F.lit(1.0), (q.x1 - q.x0) * (q.y1 - q.y0))
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1") / F.least(area(a), area(b))


def shift_scale(quad: Column | str, dx: Column | float = 0.0, dy: Column | float = 0.0, scale: Column | float = 1.0) -> Column:
    return F.transform(lit_col(quad), lambda p: F.array(p[0] * scale + dx, p[1] * scale + dy))


def rising_bits(vector: Column | str) -> Column:
    """A difference hash: bit i is 1 where element i + 1 is larger than element i."""
    vector = lit_col(vector)
    return F.transform(F.sequence(F.lit(1), F.size(vector) - 1), lambda i: (F.get(vector, i) > F.get(vector, i - 1)).cast("int"))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(lit_col(a), lit_col(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def angle_between(a: Column, b: Column) -> Column:
    """Angle between two undirected lines in degrees, at most 90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def line_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from the infinite line through two points."""
    return F.abs((x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)) / F.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)


def cell(c: Column | str, size: float) -> Column:
    return F.floor(lit_col(c) / F.lit(size)).cast("bigint")


def snap(c: Column | str, origin: float, step: float, last: int) -> Column:
    """The grid line nearest to a coordinate, kept inside the grid."""
    return F.least(F.greatest(F.rint((lit_col(c) - origin) / step).cast("bigint"), F.lit(0)), F.lit(last))


def affine(x: Column, y: Column, a: Column, b: Column, c: Column) -> Column:
    return a + b * x + c * y
