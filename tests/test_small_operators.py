"""Operators that no other test calls."""

from floorlake import schemas
from floorlake.operators import suppress


def test_strongest_junctions(spark):
    rows = [(1, float(k), float(k % 3), k % 5) for k in range(30)] + [(2, 1.0, 1.0, 7)]
    d = spark.createDataFrame(rows, "image_id long, x double, y double, score int")
    got = sorted((r["image_id"], r["score"], r["x"]) for r in suppress.strongest_junctions(d).collect())
    want = sorted((r[3], r[1], r[2]) for r in rows if r[0] == 1)[-20:]
    assert got == sorted([(1, s, x) for s, x, _ in want] + [(2, 7, 1.0)])


def test_a_little_is_added_to_the_union_of_icons(spark):
    # two boxes of one place with no area between them but their own: the overlap is whole without the addition, and 4 / (4 + 4) with it
    rows = [(1, 1, 4, 0.9, 0.0, 0.0, 2.0, 2.0), (1, 2, 4, 0.8, 0.0, 0.0, 2.0, 2.0)]
    d = spark.createDataFrame(rows, schemas.DETECTIONS)
    kept = lambda **k: sorted(r["det_id"] for r in suppress.suppress_boxes(d, **k).collect())
    assert kept(threshold=0.5) == [1] and kept(threshold=0.5, extra_union=1e-6) == [1] and kept(threshold=0.5, extra_union=4.0) == [1, 2]
