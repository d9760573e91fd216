"""Geometry as column expressions. A box is (y1, x1, y2, x2), its far edges outside."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    y1: Column
    x1: Column
    y2: Column
    x2: Column


def box(prefix: str = "") -> Box:
    """The box in columns ``<prefix>y1`` and so on; ``prefix`` may be an alias with its dot."""
    return Box(*(F.col(f"{prefix}{c}") for c in Box._fields))


def box_in(s: Column) -> Box:
    """The box in a struct's fields."""
    return Box(*(s[c] for c in Box._fields))


def area(b: Box) -> Column:
    return (b.y2 - b.y1) * (b.x2 - b.x1)


def intersection(a: Box, b: Box) -> Column:
    """Area that two boxes share; 0 if they don't meet."""
    dx = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    dy = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((dx > 0) & (dy > 0), dx * dy).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 if the boxes are disjoint or empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def touches(a: Box, b: Box) -> Column:
    """Whether two boxes meet, shared edges included."""
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) / 2


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) / 2


def clip(b: Box, window: Box) -> Box:
    inside = lambda v, low, high: F.greatest(F.least(v, high), low)
    return Box(inside(b.y1, window.y1, window.y2), inside(b.x1, window.x1, window.x2), inside(b.y2, window.y1, window.y2), inside(b.x2, window.x1, window.x2))


def normalised(b: Box, height: Column, width: Column) -> Box:
    """Pixel box to unit box: the far edges move in by a pixel first."""
    h, w = F.nullif(height - 1, F.lit(0.0)), F.nullif(width - 1, F.lit(0.0))
    return Box(b.y1 / h, b.x1 / w, (b.y2 - 1) / h, (b.x2 - 1) / w)


def denormalised(b: Box, height: Column, width: Column) -> Box:
    """Unit box to pixel box, rounded half to even."""
    r = lambda v: F.bround(v, 0)
    return Box(r(b.y1 * (height - 1)), r(b.x1 * (width - 1)), r(b.y2 * (height - 1) + 1), r(b.x2 * (width - 1) + 1))


def with_deltas(b: Box, dy: Column, dx: Column, dh: Column, dw: Column) -> Box:
    """A box moved by a share of its size and scaled by exponents."""
    h, w = b.y2 - b.y1, b.x2 - b.x1
    cy, cx = b.y1 + h / 2 + dy * h, b.x1 + w / 2 + dx * w
    h2, w2 = h * F.exp(dh), w * F.exp(dw)
    return Box(cy - h2 / 2, cx - w2 / 2, cy + h2 / 2, cx + w2 / 2)


def deltas(b: Box, target: Box) -> tuple[Column, Column, Column, Column]:
    """What :func:`with_deltas` needs to turn ``b`` into ``target``; null where either has no extent."""
    positive = lambda v: F.when(v > 0, v)
    h, w = positive(b.y2 - b.y1), positive(b.x2 - b.x1)
    th, tw = positive(target.y2 - target.y1), positive(target.x2 - target.x1)
    return (center_y(target) - center_y(b)) / h, (center_x(target) - center_x(b)) / w, F.log(th / h), F.log(tw / w)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


class Segment(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


#: Below this determinant two segments count as parallel, and parallel ones don't meet.
PARALLEL = 1e-10


def _crossing(a: Segment, b: Segment) -> tuple[Column, Column, Column]:
    det = (a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2)
    safe = F.when(F.abs(det) >= PARALLEL, det)
    t = ((a.x1 - b.x1) * (b.y1 - b.y2) - (a.y1 - b.y1) * (b.x1 - b.x2)) / safe
    u = ((a.x1 - b.x1) * (a.y1 - a.y2) - (a.y1 - b.y1) * (a.x1 - a.x2)) / safe
    return t, u, F.coalesce((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.lit(False))


def segments_meet(a: Segment, b: Segment) -> Column:
    return _crossing(a, b)[2]


def crossing_point(a: Segment, b: Segment) -> Column:
    """Struct (x, y) where two segments meet, else null."""
    t, _, meet = _crossing(a, b)
    return F.when(meet, F.struct((a.x1 + t * (a.x2 - a.x1)).alias("x"), (a.y1 + t * (a.y2 - a.y1)).alias("y")))


def edges(b: Box) -> list[Segment]:
    """Top, right, bottom and left edge."""
    return [Segment(b.x1, b.y1, b.x2, b.y1), Segment(b.x2, b.y1, b.x2, b.y2), Segment(b.x2, b.y2, b.x1, b.y2), Segment(b.x1, b.y2, b.x1, b.y1)]


def inside(x: Column, y: Column, b: Box) -> Column:
    return (x >= b.x1) & (x <= b.x2) & (y >= b.y1) & (y <= b.y2)


def segment_meets_box(s: Segment, b: Box) -> Column:
    """An end lies inside, or an edge is met."""
    found = inside(s.x1, s.y1, b) | inside(s.x2, s.y2, b)
    for e in edges(b):
        found = found | segments_meet(s, e)
    return found


def fpn_level(h: Column, w: Column, image_area: Column) -> Column:
    """Pyramid level 2 to 5 of a box in unit coordinates; null for one without extent."""
    level = 4 + F.bround(F.log2(F.sqrt(F.when(h * w > 0, h * w)) / (224.0 / F.sqrt(image_area))), 0)
    # least and greatest pass nulls over
    return F.when(level.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(2), level.cast("int"))))
