"""Classification of detections: bands, sizes and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorlake.functions.geometry import Box, center_x, center_y
from floorlake.schemas import CLASS_NAMES


def bands(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first limit that ``value`` is below."""
    out = None
    for limit, label in steps:
        out = F.when(value < limit, label) if out is None else out.when(value < limit, label)
    return out.otherwise(rest)


def noted(*notes: tuple[Column, str | Column]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in notes]), lambda x: x.isNotNull())


def class_name(class_id: Column) -> Column:
    out = F.lit("unknown")
    for k, name in CLASS_NAMES.items():
        if k:
            out = F.when(class_id == k, name).otherwise(out)
    return out


def class_name_maps(class_ids: Column) -> Column:
    """For an array of class ids, a map with the name of each; an empty one for other classes."""
    names = F.create_map(*[F.lit(x) for k, name in CLASS_NAMES.items() if k for x in (k, name)])
    none = F.create_map().cast("map<string,string>")
    return F.transform(class_ids, lambda i: F.when(F.element_at(names, i).isNotNull(), F.create_map(F.lit("name"), F.element_at(names, i))).otherwise(none))


def confidence_band(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")


# Area and width limits, in pixels, and their labels.
def door_size(w: Column, h: Column) -> Column:
    return bands(w * h, [(2000, "small"), (6000, "standard"), (10000, "large")], "oversized")


def door_access(w: Column) -> Column:
    return F.when(w > 80, "ADA_compliant_likely").when(w > 60, "standard_width").otherwise("narrow_door")


def window_size(w: Column, h: Column) -> Column:
    return bands(w * h, [(1000, "small"), (4000, "standard"), (8000, "large")], "oversized")


def window_glazing(w: Column, h: Column) -> Column:
    return bands(w * h, [(2000, "single_glazing_likely"), (6000, "double_glazing_likely")], "triple_glazing_likely")


def window_type(w: Column, h: Column) -> Column:
    return F.when(w > h, "horizontal").otherwise("vertical")


def window_notes(w: Column, h: Column) -> Column:
    """Notes on size, orientation and proportions, in this order; a window without height has proportion 0."""
    ratio = F.when(h > 0, w / h).otherwise(F.lit(0.0))
    wide = w > h
    return noted(
        (w * h < 1000, "Small window - possibly for ventilation or light"),
        (w * h > 8000, "Large window - likely for significant natural lighting"),
        (wide, "Horizontal window orientation"),
        (wide & (w > 2 * h), "Wide horizontal window - panoramic view"),
        (~wide, "Vertical window orientation"),
        (~wide & (h > 2 * w), "Tall vertical window - floor-to-ceiling style"),
        (ratio > 3, "Very wide window - modern architectural style"),
        (ratio < 0.5, "Very tall window - contemporary design"),
    )


def door_orientation(b: Box, width: Column, height: Column) -> Column:
    """Struct (door_type, estimated_swing, hinge_side, confidence) from the door's place in its image."""
    vertical = (b.y2 - b.y1) > (b.x2 - b.x1)
    left, low = center_x(b) < width / 2, center_y(b) > height / 2
    pick = lambda a, c, d, e: F.when(vertical, F.when(left, a).otherwise(c)).otherwise(F.when(low, d).otherwise(e))
    return F.struct(
        F.when(vertical, "vertical").otherwise("horizontal").alias("door_type"),
        pick("opens_leftward", "opens_rightward", "opens_upward", "opens_downward").alias("estimated_swing"),
        pick("left_edge", "right_edge", "bottom_edge", "top_edge").alias("hinge_side"),
        F.lit(0.4).alias("confidence"),
    )


def door_notes(w: Column, h: Column, swing: Column, confidence: Column) -> Column:
    return noted(
        ((w > h) & (w >= 80), "Likely a standard interior door (32+ inches)"),
        ((w > h) & (w < 80), "Possible narrow door or entry"),
        (swing.contains("upward"), "May open into upper room/hallway"),
        (swing.contains("downward"), "May open into lower room/hallway"),
        (swing.contains("leftward"), "Opens toward left side of floor plan"),
        (swing.contains("rightward"), "Opens toward right side of floor plan"),
        (confidence < 0.5, "Low confidence - manual verification recommended"),
        (confidence > 0.7, "High confidence orientation prediction"),
    )


def percent(part: Column, whole: Column) -> Column:
    """``12.3%``; null where the whole is 0."""
    return F.format_string("%.1f%%", F.try_divide(part, whole) * 100)
