"""Planar geometry on arrays of coordinates, and directions between points. All of it stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistaframe.functions.arrays import bound

#: Absolute tolerance of the axis directions, in radians. Fixed value.
AXIS_TOLERANCE = 0.01


def common_length(x: Column, y: Column) -> Column:
    return F.least(F.size(x), F.size(y))


def cut_to(values: Column, n: Column) -> Column:
    return F.slice(values, F.lit(1), F.greatest(n, F.lit(0)))


def points(x: Column, y: Column) -> Column:
    """ARRAY<STRUCT<x, y>> up to the shorter list."""
    n = common_length(x, y)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(x, i).alias("x"), F.get(y, i).alias("y")))).when(n == 0, F.expr("array()"))


def polygon_area(x: Column, y: Column) -> Column:
    """Area by the shoelace formula over the common length; 0 with fewer than four points, NULL without arrays."""
    n = common_length(x, y)
    at = lambda a, i: F.get(a, i)
    terms = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: at(x, i) * at(y, (i + 1) % n) - at(x, (i + 1) % n) * at(y, i),
    )
    area = F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2
    return F.when(n >= 4, area).when(n >= 0, F.lit(0.0))


def mean_of(values: Column) -> Column:
    """Mean of an array; NULL if it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values).cast("double"))


def centroid(x: Column, y: Column) -> Column:
    """STRUCT(x, y): mean of the vertices, not of the area; NULL without points."""
    n = common_length(x, y)
    return F.when(n > 0, F.struct(mean_of(cut_to(x, n)).alias("x"), mean_of(cut_to(y, n)).alias("y")))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle of the way from a to b."""
    return F.atan2(by - ay, bx - ax)


def horizontal(theta: Column) -> Column:
    return F.when((theta > -math.pi / 2) & (theta <= math.pi / 2), "left").otherwise("right")


def vertical(theta: Column) -> Column:
    return F.when((theta > 0) & (theta <= math.pi), "above").otherwise("under")


def direction(theta: Column) -> Column:
    """One word close to an axis, else two; at the axes the words are those of the reference, which contradict the halves."""
    near = lambda c: F.abs(theta - c) <= AXIS_TOLERANCE
    return (
        F.when(near(0.0), "right")
        .when(near(math.pi) | near(-math.pi), "left")
        .when(near(math.pi / 2), "above")
        .when(near(-math.pi / 2), "under")
        .when(theta.isNotNull(), F.concat(horizontal(theta), F.lit(" and "), vertical(theta)))
    )


def direction_legacy(theta: Column) -> Column:
    """The older rule: horizontal within 45 degrees of the x axis, else vertical."""
    flat = (F.abs(theta) < math.pi / 4) | (F.abs(theta) > 3 * math.pi / 4)
    return F.when(flat, horizontal(theta)).when(theta.isNotNull(), vertical(theta))


def normalized(x: Column, y: Column, width: Column, height: Column) -> Column:
    """STRUCT(x, y) as ratios of an image's size."""
    return F.struct(F.try_divide(x, width).alias("x"), F.try_divide(y, height).alias("y"))


def scaled_255(values: Column) -> Column:
    """Min-max to whole numbers 0 to 255, cut, not rounded; all zero if the values are all equal."""
    bounds = F.struct(values.alias("v"), F.array_min(values).alias("low"), F.array_max(values).alias("high"))
    return bound(bounds, lambda t: F.transform(t["v"], lambda v: F.when(t["high"] > t["low"], F.floor((v - t["low"]) / (t["high"] - t["low"]) * 255)).otherwise(F.lit(0)).cast("int")))


def scaled_16_to_8(values: Column) -> Column:
    """16-bit depth to 8 bits on the fixed scale 0 to 65535."""
    return F.transform(values, lambda v: F.floor(v / 65535 * 255).cast("int"))
