"""Rectangle algebra as column expressions.

A ``Box`` holds four columns, so predicates stay flat and reach the scan. Null coordinates give
null results, as in SQL.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Round half up, also below zero."""
    return F.floor(x + F.lit(0.5))


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def from_corners(cls, xs: list[Column], ys: list[Column]) -> Box:
        """Envelope of any points, such as the four corners of a quad."""
        return cls(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    @classmethod
    def empty(cls) -> Box:
        return cls(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(-1.0))

    @property
    def width(self) -> Column:
        return F.greatest(F.lit(0.0), self.x1 - self.x0)

    @property
    def height(self) -> Column:
        return F.greatest(F.lit(0.0), self.y1 - self.y0)

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def is_empty(self) -> Column:
        return (self.x0 >= self.x1) | (self.y0 >= self.y1)

    @property
    def is_valid(self) -> Column:
        return (self.x0 <= self.x1) & (self.y0 <= self.y1)

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def intersect(self, o: Box) -> Box:
        return Box(F.greatest(self.x0, o.x0), F.greatest(self.y0, o.y0), F.least(self.x1, o.x1), F.least(self.y1, o.y1))

    def union(self, o: Box) -> Box:
        return Box(F.least(self.x0, o.x0), F.least(self.y0, o.y0), F.greatest(self.x1, o.x1), F.greatest(self.y1, o.y1))

    def contains(self, o: Box) -> Column:
        """Closed containment."""
        return (o.x0 >= self.x0) & (o.x1 <= self.x1) & (o.y0 >= self.y0) & (o.y1 <= self.y1)

    def contains_point(self, x: Column, y: Column) -> Column:
        return (x >= self.x0) & (x <= self.x1) & (y >= self.y0) & (y <= self.y1)

    def holds_point(self, x: Column, y: Column) -> Column:
        """Half-open membership, as of a glyph centre in a table cell."""
        return (x >= self.x0) & (x < self.x1) & (y >= self.y0) & (y < self.y1)

    def intersects(self, o: Box) -> Column:
        """Open overlap."""
        return (self.x0 < o.x1) & (o.x0 < self.x1) & (self.y0 < o.y1) & (o.y0 < self.y1)

    def disjoint(self, o: Box, strict: bool = False) -> Column:
        """No overlap; boxes that touch are disjoint unless ``strict``."""
        if strict:
            return (self.x1 < o.x0) | (o.x1 < self.x0) | (self.y1 < o.y0) | (o.y1 < self.y0)
        return (self.x1 <= o.x0) | (o.x1 <= self.x0) | (self.y1 <= o.y0) | (o.y1 <= self.y0)

    def almost_in(self, o: Box, share: float = 0.8) -> Column:
        """More than ``share`` of this box's area lies in the other."""
        return self.intersect(o).area > self.area * F.lit(share)

    def inflate(self, d: float) -> Box:
        return Box(self.x0 - d, self.y0 - d, self.x1 + d, self.y1 + d)

    def shift(self, d: tuple[float, float, float, float]) -> Box:
        return Box(*(c + F.lit(v) for c, v in zip(self, d, strict=True)))

    def normalized(self) -> Box:
        return Box(F.least(self.x0, self.x1), F.least(self.y0, self.y1), F.greatest(self.x0, self.x1), F.greatest(self.y0, self.y1))

    def irect(self) -> Box:
        return Box(F.floor(self.x0), F.floor(self.y0), F.ceil(self.x1), F.ceil(self.y1))

    def same(self, o: Box) -> Column:
        return (self.x0 == o.x0) & (self.y0 == o.y0) & (self.x1 == o.x1) & (self.y1 == o.y1)

    def gap(self, o: Box) -> Column:
        """Distance between the edges of two boxes, 0 if they overlap."""
        dx = F.greatest(F.lit(0.0), self.x0 - o.x1, o.x0 - self.x1)
        dy = F.greatest(F.lit(0.0), self.y0 - o.y1, o.y0 - self.y1)
        return F.sqrt(dx * dx + dy * dy)

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(self, ("x0", "y0", "x1", "y1"), strict=True)))

    def columns(self, suffix: str = "") -> list[Column]:
        return [c.alias(f"{n}{suffix}") for c, n in zip(self, ("x0", "y0", "x1", "y1"), strict=True)]

    def transform(self, m: tuple[float, float, float, float, float, float]) -> Box:
        """Envelope of the box under the affine map (a, b, c, d, e, f)."""
        a, b, c, d, e, f = map(F.lit, m)
        pts = [(a * x + c * y + e, b * x + d * y + f) for x in (self.x0, self.x1) for y in (self.y0, self.y1)]
        return Box.from_corners([p[0] for p in pts], [p[1] for p in pts])


def envelope(prefix: str = "") -> list[Column]:
    """Aggregates for the envelope of a group."""
    return [F.min(f"{prefix}x0").alias("x0"), F.min(f"{prefix}y0").alias("y0"), F.max(f"{prefix}x1").alias("x1"), F.max(f"{prefix}y1").alias("y1")]


def derotate(box: Box, rotation: int, width: float, height: float) -> Box:
    """The box on an upright page; ``width`` and ``height`` are those of the rotated page as shown."""
    return {0: box, 90: Box(box.y0, width - box.x1, box.y1, width - box.x0), 180: Box(width - box.x1, height - box.y1, width - box.x0, height - box.y0), 270: Box(height - box.y1, box.x0, height - box.y0, box.x1)}[rotation % 360]
