import math

import pytest
from pyspark.sql import functions as F

from floorlake.functions import classify as c
from floorlake.functions import geometry as g


def value(spark, column):
    x = spark.range(1).select(column.alias("x")).first()["x"]
    return x


def lit_box(y1, x1, y2, x2):
    return g.Box(*(F.lit(float(v)) for v in (y1, x1, y2, x2)))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (0, 10, 10, 20), 0.0), ((0, 0, 10, 10), (0, 5, 10, 15), 1 / 3), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0), ((0, 0, 4, 4), (10, 10, 12, 12), 0.0)],
)
def test_iou(spark, a, b, want):
    assert value(spark, g.iou(lit_box(*a), lit_box(*b))) == pytest.approx(want)
    assert value(spark, g.iou(lit_box(*b), lit_box(*a))) == pytest.approx(want)


def test_touching_boxes(spark):
    assert value(spark, g.touches(lit_box(0, 0, 10, 10), lit_box(0, 10, 10, 20)))
    assert not value(spark, g.touches(lit_box(0, 0, 10, 10), lit_box(0, 11, 10, 20)))


def test_boxes_there_and_back(spark):
    b = lit_box(10, 20, 110, 220)
    unit = g.normalised(b, F.lit(800.0), F.lit(600.0))
    back = g.denormalised(unit, F.lit(800.0), F.lit(600.0))
    assert [value(spark, x) for x in back] == [10, 20, 110, 220]
    other = lit_box(30, 10, 90, 300)
    moved = g.with_deltas(b, *g.deltas(b, other))
    assert [value(spark, x) for x in moved] == pytest.approx([30, 10, 90, 300])
    assert value(spark, g.normalised(b, F.lit(1.0), F.lit(1.0)).y1) is None
    assert value(spark, g.deltas(lit_box(0, 0, 0, 0), b)[2]) is None


def test_rounds_half_to_even(spark):
    assert [value(spark, x) for x in g.denormalised(lit_box(0.5, 0.5, 0.5, 0.5), F.lit(6.0), F.lit(4.0))] == [2, 2, 4, 2]


def seg(*v):
    return g.Segment(*(F.lit(float(x)) for x in v))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((0, 0, 10, 10), (0, 10, 10, 0), (5, 5)), ((0, 0, 10, 0), (0, 1, 10, 1), None), ((0, 0, 10, 0), (5, 0, 15, 0), None), ((0, 0, 5, 0), (5, -5, 5, 5), (5, 0)), ((0, 0, 4, 0), (5, -5, 5, 5), None)],
)
def test_crossing(spark, a, b, want):
    got = value(spark, g.crossing_point(seg(*a), seg(*b)))
    assert (None if got is None else (got["x"], got["y"])) == want
    assert value(spark, g.segments_meet(seg(*a), seg(*b))) == (want is not None)


def test_segment_and_box(spark):
    b = lit_box(0, 0, 10, 10)
    assert value(spark, g.segment_meets_box(seg(2, 2, 4, 4), b)) and value(spark, g.segment_meets_box(seg(-5, 5, 15, 5), b))
    assert not value(spark, g.segment_meets_box(seg(-5, 11, 15, 11), b))


@pytest.mark.parametrize(("score", "want"), [(0.5, "low"), (0.51, "medium"), (0.8, "medium"), (0.81, "high")])
def test_confidence_bands(spark, score, want):
    assert value(spark, c.confidence_band(F.lit(score))) == want


@pytest.mark.parametrize(("w", "h", "size"), [(20, 99, "small"), (20, 100, "standard"), (60, 100, "large"), (100, 100, "oversized")])
def test_door_sizes(spark, w, h, size):
    assert value(spark, c.door_size(F.lit(w), F.lit(h))) == size


@pytest.mark.parametrize(("w", "want"), [(60, "narrow_door"), (61, "standard_width"), (80, "standard_width"), (81, "ADA_compliant_likely")])
def test_door_access(spark, w, want):
    assert value(spark, c.door_access(F.lit(w))) == want


@pytest.mark.parametrize(("area", "size", "glazing"), [(999, "small", "single"), (1000, "standard", "single"), (2000, "standard", "double"), (4000, "large", "double"), (6000, "large", "triple"), (8000, "oversized", "triple")])
def test_window_classes(spark, area, size, glazing):
    assert value(spark, c.window_size(F.lit(area), F.lit(1))) == size
    assert value(spark, c.window_glazing(F.lit(area), F.lit(1))) == f"{glazing}_glazing_likely"


def test_window_notes(spark):
    assert value(spark, c.window_notes(F.lit(100.0), F.lit(0.0))) == ["Small window - possibly for ventilation or light", "Horizontal window orientation", "Wide horizontal window - panoramic view", "Very tall window - contemporary design"]
    assert value(spark, c.window_notes(F.lit(50.0), F.lit(50.0))) == ["Vertical window orientation"]


def test_names_and_percent(spark):
    assert [value(spark, c.class_name(F.lit(k))) for k in (0, 1, 2, 3, 7)] == ["unknown", "wall", "window", "door", "unknown"]
    assert value(spark, c.percent(F.lit(1.0), F.lit(8.0))) == "12.5%"


def test_fpn_level(spark):
    level = lambda s: value(spark, g.fpn_level(F.lit(s), F.lit(s), F.lit(800.0 * 800.0)))
    assert [level(224 / 800), level(112 / 800), level(1.0), level(0.001)] == [4, 3, 5, 2]
    assert level(0.0) is None
    assert math.isclose(value(spark, g.distance(*(F.lit(float(x)) for x in (0, 0, 3, 4)))), 5.0)
