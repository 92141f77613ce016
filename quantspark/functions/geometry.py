"""Column functions of points, boxes and segments; all in codegen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """A box of four columns."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2

    def expanded(self, by: float | Column) -> Box:
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def contains(self, x: Column, y: Column) -> Column:
        return x.between(self.x0, self.x1) & y.between(self.y0, self.y1)

    def h_overlap(self, other: Box) -> Column:
        return F.greatest(F.lit(0.0), F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0))

    def distance(self, x: Column, y: Column) -> Column:
        """From the nearest place of the box; 0 inside."""
        zero = F.lit(0.0)
        return F.hypot(F.greatest(self.x0 - x, zero, x - self.x1), F.greatest(self.y0 - y, zero, y - self.y1))


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(square, F.lit(0.0)))))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def axis_angle(dx: Column, dy: Column) -> Column:
    """Degrees to the nearer axis, 0 to 45."""
    return F.degrees(F.atan2(F.least(F.abs(dx), F.abs(dy)), F.greatest(F.abs(dx), F.abs(dy))))


def is_axis_aligned(dx: Column, dy: Column, tol_deg: float = 2.0) -> Column:
    return axis_angle(dx, dy) <= tol_deg


def is_diagonal(dx: Column, dy: Column, min_deg: float) -> Column:
    return ((dx != 0) | (dy != 0)) & (axis_angle(dx, dy) >= min_deg)


def unit(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The direction, (0, 0) for a point."""
    n = F.nullif(length(x1, y1, x2, y2), F.lit(0.0))
    return F.coalesce((x2 - x1) / n, F.lit(0.0)), F.coalesce((y2 - y1) / n, F.lit(0.0))


def canonical(dx: Column, dy: Column) -> tuple[Column, Column]:
    """One direction for a line's two."""
    turn = (dx < 0) | ((dx == 0) & (dy < 0))
    return F.when(turn, -dx).otherwise(dx), F.when(turn, -dy).otherwise(dy)


def parallel(ax: Column, ay: Column, bx: Column, by: Column, cos_tol: float) -> Column:
    return F.abs(ax * bx + ay * by) >= cos_tol


def offset(dx: Column, dy: Column, x: Column, y: Column) -> Column:
    """Signed distance of the line through (x, y) from the origin."""
    return dx * y - dy * x


def projection(dx: Column, dy: Column, x: Column, y: Column) -> Column:
    return x * dx + y * dy


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) have each other's ends on different sides."""

    def left(s: tuple[Column, ...], x: Column, y: Column) -> Column:
        return (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0]) > 0

    return (left(b, a[0], a[1]) != left(b, a[2], a[3])) & (left(a, b[0], b[1]) != left(a, b[2], b[3]))


def bezier(coords: Column, steps: int) -> Column:
    """The pieces of a cubic curve (eight coordinates) as an array of (x1, y1, x2, y2)."""

    def at(i: Column) -> tuple[Column, Column]:
        t = i / F.lit(float(steps))
        u = 1 - t
        k = (u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t)
        x, y = ((k[0] * coords[0 + d] + k[1] * coords[2 + d] + k[2] * coords[4 + d] + k[3] * coords[6 + d]) for d in (0, 1))
        return x, y

    def piece(i: Column) -> Column:
        (x1, y1), (x2, y2) = at(i), at(i + 1)
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), piece)


def color_close(a: tuple[Column, ...], b: tuple[Column, ...], tol: float) -> Column:
    """Colours agree channel by channel; a missing colour agrees with a missing one alone."""
    known = a[0].isNotNull() & b[0].isNotNull()
    near = (F.abs(a[0] - b[0]) <= tol) & (F.abs(a[1] - b[1]) <= tol) & (F.abs(a[2] - b[2]) <= tol)
    return F.when(known, near).otherwise(a[0].isNull() & b[0].isNull())


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")
