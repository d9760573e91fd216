"""Pixels and millimetres; ``scale`` is millimetres a pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def px_to_mm(px: Column, scale: Column) -> Column:
    return px * scale


def mm_to_px(mm: Column, scale: Column) -> Column:
    """Null where the scale is 0."""
    return F.try_divide(mm, scale)


def line_to_mm(points: Column, scale: Column) -> Column:
    """An array of [x, y, ...] arrays as [x, y] in mm; points of fewer than two coordinates are left out."""
    whole = F.filter(points, lambda p: F.size(p) >= 2)
    return F.transform(whole, lambda p: F.array(px_to_mm(F.get(p, F.lit(0)), scale), px_to_mm(F.get(p, F.lit(1)), scale)))


def thickness_to_mm(t: Column, scale: Column) -> Column:
    """A struct (average, min, max, profile) in mm, missing values as 0 and a missing profile as empty; null stays null."""
    one = lambda k: px_to_mm(F.coalesce(t[k], F.lit(0.0)), scale).alias(k)
    profile = F.transform(F.coalesce(t["profile"], F.array().cast("array<double>")), lambda v: px_to_mm(v, scale)).alias("profile")
    return F.when(t.isNotNull(), F.struct(one("average"), one("min"), one("max"), profile))


def box_to_mm(b: Column, scale: Column) -> Column:
    """A struct (x1, y1, x2, y2) in mm, missing values as 0; null stays null."""
    return F.when(b.isNotNull(), F.struct(*[px_to_mm(F.coalesce(b[k], F.lit(0.0)), scale).alias(k) for k in ("x1", "y1", "x2", "y2")]))


def position_to_mm(position: Column, scale: Column) -> Column:
    """A junction's [x, y, ...] as [x, y] in mm; one of fewer coordinates stays as it is."""
    moved = F.array(px_to_mm(F.get(position, F.lit(0)), scale), px_to_mm(F.get(position, F.lit(1)), scale))
    return F.when(F.size(position) >= 2, moved).otherwise(position)
