"""Plane geometry as column expressions. Angles are in degrees, clockwise positive."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distance(ax, ay, bx, by) -> Column:
    dx, dy = column(bx) - column(ax), column(by) - column(ay)
    return F.sqrt(dx * dx + dy * dy)


def clockwise_angle(ax, ay, bx, by) -> Column:
    """From vector a to vector b, in [-180, 180]."""
    turn = F.atan2(column(by), column(bx)) - F.atan2(column(ay), column(ax))
    return -F.degrees(F.when(F.abs(turn) > math.pi, turn - F.signum(turn) * 2 * math.pi).otherwise(turn))


def _half_turn(ax: float | None, ay: float | None, bx: float | None, by: float | None) -> float | None:
    if ax is None:
        return None
    turn = math.atan2(by, bx) - math.atan2(ay, ax)
    return -math.degrees(turn - math.copysign(2 * math.pi, turn) if abs(turn) > math.pi else turn)


def clockwise_angle_of_steps(ax, ay, bx, by) -> Column:
    """The same, where vectors point in opposite ways with the sign that the C library's arctangent gives.

    180 and -180 are one turn; which comes out depends on the last bit of either arctangent, and Java's differs from C's in a fifth of all vectors.
    Only opposite vectors are sent to Python.
    """
    a, b = (column(ax), column(ay)), (column(bx), column(by))
    opposite = (a[0] * b[1] == a[1] * b[0]) & (a[0] * b[0] + a[1] * b[1] < 0)
    about = F.udf(_half_turn, "double", useArrow=False)(*[F.when(opposite, c) for c in (*a, *b)])
    return F.coalesce(about, clockwise_angle(*a, *b))


def rotated(x, y, radians: Column) -> tuple[Column, Column]:
    x, y, c, s = column(x), column(y), F.cos(radians), F.sin(radians)
    return c * x - s * y, s * x + c * y


def to_upright(target_x, target_y) -> Column:
    """Radians that turn the target onto the upper y axis; 0 for a target at the origin."""
    x, y = column(target_x), column(target_y)
    size = F.sqrt(x * x + y * y)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.radians(clockwise_angle(F.lit(0.0), size, x, y)))


def over_square(x: Column, y: Column) -> tuple[Column, Column]:
    """A vector divided by its squared length; null for a null or zero vector."""
    square = x * x + y * y
    return F.try_divide(x, square), F.try_divide(y, square)


def polyline_length(points: list[tuple[str, str]]) -> Column:
    """Summed segment lengths; null if any coordinate is."""
    return reduce(lambda a, b: a + b, [distance(*p, *q) for p, q in zip(points, points[1:], strict=False)])


def joint_angles(points: list[tuple[str, str]]) -> Column:
    """Array of angles at the inner points of a polyline, in [0, 360)."""
    found = []
    for (ax, ay), (bx, by), (cx, cy) in zip(points, points[1:], points[2:], strict=False):
        angle = clockwise_angle(column(ax) - column(bx), column(ay) - column(by), column(cx) - column(bx), column(cy) - column(by))
        found.append(F.pmod(angle, F.lit(360.0)))
    return F.array(*found)


def polyline_distance(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> Column:
    """Summed point distances of two polylines, of the better of b's two directions."""
    total = lambda other: reduce(lambda x, y: x + y, [distance(*p, *q) for p, q in zip(a, other, strict=True)])
    return F.least(total(b), total(b[::-1]))


def rescale(x, radius) -> Column:
    """Positions -radius..radius to 1..-1 around the middle of a 2 radius wide axis."""
    return -(2 * column(x) / (2 * F.lit(radius)) - 1)
