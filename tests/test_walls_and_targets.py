"""Wall tables from masks, line repair, drawing selection, sampled targets and records on small fixtures."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from floorlake import schemas
from floorlake.functions import classify, units
from floorlake.operators import evaluate, prepare, raster, selection, texts
from floorlake.plans import reports
from test_text_and_raster import drawn, runs_of


def one(spark, x):
    return spark.range(1).select(x.alias("x")).first()["x"]


def test_largest_component():
    m = drawn("##..# ##..# ....# .#...")
    assert raster.largest_component(m).tolist() == drawn("##... ##... ..... .....").tolist()
    assert not raster.largest_component(np.zeros((3, 4), bool)).any()


def plain_pieces(m, y, x):
    """Pieces of the eight neighbours, corners touching."""
    cells = {(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and m[y + a, x + b]}
    n = 0
    while cells:
        n += 1
        todo = [cells.pop()]
        while todo:
            a, b = todo.pop()
            near = {c for c in cells if max(abs(c[0] - a), abs(c[1] - b)) == 1}
            cells -= near
            todo += near
    return n


def test_meeting_points_by_the_rule():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.4, 0.6):
        m = rng.random((70, 60)) < share
        want = []
        for y in range(2, 68):
            for x in range(2, 58):
                if m[y, x] and plain_pieces(m, y, x) >= 3 and all(math.dist((y, x), p) >= 15 for p in want):
                    want.append((y, x))
        assert raster.meeting_points(m) == want


def test_line_repair():
    m = np.zeros((20, 20), bool)
    m[8:12, 2:18] = True
    assert raster.repaired([(3.0, 9.0), (5.0, 6.0), (7.0, 1.0), (-4.0, 50.0)], m) == [(3.0, 9.0), (3.0, 8.0)]
    far = [(0.0, 0.0), (19.0, 0.0)]
    assert raster.validated(far, m) == far and raster.validated([(1.0, 1.0)], m) == [(1.0, 1.0)]
    bar = [(y, x) for y in (10,) for x in range(2, 18)]
    line = raster.inner_line(bar, m)
    assert len(line) >= 2 and all(m[int(y), int(x)] for x, y in line) and raster.inner_line(bar[:1], m) == []
    thin = np.zeros((20, 20), bool)
    thin[10, 2:9] = True  # too few pixels for a centered line
    assert raster.inner_line([(10, x) for x in range(2, 9)], thin) == [(2.5, 10.0), (3.0, 10.0), (4.0, 10.0), (5.0, 10.0), (6.0, 10.0), (7.0, 10.0), (7.5, 10.0)]


def test_walls_from_masks(spark):
    m = np.zeros((240, 240), bool)
    m[95:106, 40:200] = True
    m[20:180, 95:106] = True
    images = spark.createDataFrame([(1, 240.0, 240.0, 2.0)], schemas.IMAGES)
    rows = reports.wall_parameters(runs_of(spark, m), images, "R2_", cleaned=False).orderBy("wall_seq").collect()
    assert [r["wall_id"] for r in rows] == ["R2_W1", "R2_W2", "R2_W3", "R2_W4"]
    table = {r["wall_seq"]: r for r in raster.wall_table(runs_of(spark, m), cleaned=False).collect()}
    for r in rows:
        line = [(p["x"], p["y"]) for p in table[r["wall_seq"]]["line"]]
        assert [tuple(p) for p in r["centerline"]] == [(2 * x, 2 * y) for x, y in line]
        assert abs(r["length"] - 2 * sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))) < 1e-9
        assert r["box"]["x1"] == 2 * min(x for x, _ in line) and r["segment_area"] >= len(line)
        assert r["thickness"]["average"] == 2 * table[r["wall_seq"]]["thickness"]["average"] and 0 <= r["orientation_degrees"] < 180
    ends = [r["start_junction"] or r["end_junction"] for r in rows]
    assert ends.count(1) >= 1  # some end at the crossing
    assert reports.wall_parameters(runs_of(spark, m).limit(0), images).count() == 0


def test_units(spark):
    s = F.lit(2.0)
    assert one(spark, units.mm_to_px(F.lit(3.0), F.lit(0.0))) is None
    assert one(spark, units.line_to_mm(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(5.0))), s)) == [[2.0, 4.0]]
    assert one(spark, units.position_to_mm(F.array(F.lit(1.0)), s)) == [1.0] and one(spark, units.position_to_mm(F.array(F.lit(1.0), F.lit(4.0)), s)) == [2.0, 8.0]
    assert one(spark, units.box_to_mm(F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"), s)) is None


def test_class_names_of_an_array(spark):
    assert one(spark, classify.class_name_maps(F.array(*map(F.lit, (1, 0, 3, 9))))) == [{"name": "wall"}, {}, {"name": "door"}, {}]


def test_drawn_lines(spark):
    points = spark.createDataFrame([(1, 0, 100.0, 0.0), (1, 1, 104.0, 3.0), (2, 0, 10.0, 10.0), (2, 1, 90.0, 10.0), (2, 2, 90.0, 200.0), (3, 0, 500.0, 500.0)], schemas.PATH_POINTS)
    assert [(r["path_id"], r["pos"]) for r in selection.line_steps(points).collect()] == [(2, 2)]


def test_boxes_without_a_line(spark):
    box = lambda i, x1, x2: (1, i, 1, 0.9, 0.0, x1, 10.0, x2)
    boxes = spark.createDataFrame([box(1, 0.0, 10.0), box(2, 1.0, 11.0), box(3, 30.0, 40.0), box(4, 50.0, 50.0)], schemas.DETECTIONS)
    drawn_boxes = spark.createDataFrame([box(9, 32.0, 60.0)], schemas.DETECTIONS)
    assert sorted(r["det_id"] for r in selection.without_line(boxes, drawn_boxes).collect()) == [1, 4]
    walls = spark.createDataFrame([(1, k, k, 0.0, 0.0, 1.0, 1.0, 2.0) for k in (1, 2)], schemas.WALLS)
    assert [r["wall_seq"] for r in selection.interior_walls(walls, walls.filter("wall_seq = 1")).collect()] == [2]
    assert [r["wall_seq"] for r in selection.exterior_walls(walls, walls.filter("wall_seq = 1")).collect()] == [1]


def test_sampled_targets(spark):
    gt = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, -1, 100.0, 100.0, 200.0, 200.0)], "image_id long, gt_id long, class_id int, y1 double, x1 double, y2 double, x2 double")
    near = [(1, i, 0.0, 0.0, 10.0, 9.0) for i in range(30)]
    far = [(1, 100 + i, 50.0, 0.0, 60.0, 10.0) for i in range(60)]
    crowd = [(1, 200 + i, 110.0, 110.0, 120.0, 120.0) for i in range(5)]
    rois = spark.createDataFrame(near + far + crowd, "image_id long, roi_id long, y1 double, x1 double, y2 double, x2 double")
    rows = evaluate.detection_targets(rois, gt, per_image=20).collect()
    assert sum(r["positive"] for r in rows) == 6 and len(rows) == 18 and all((r["gt_id"], r["class_id"]) == ((1, 1) if r["positive"] else (None, 0)) for r in rows)
    assert not any(r["roi_id"] >= 200 for r in rows) and rows and {tuple(r) for r in rows} == {tuple(r) for r in evaluate.detection_targets(rois, gt, per_image=20).collect()}
    labels = [r["label"] for r in evaluate.anchor_targets(rois.withColumnRenamed("roi_id", "anchor_id"), gt, per_image=20).collect()]
    assert len(labels) == 95 and labels.count(1) == 10 and labels.count(-1) == 10
    assert evaluate.detection_targets(rois.limit(0), gt).count() == 0


def test_random_rois(spark):
    gt = spark.createDataFrame([(1, i, 1, 40.0 * i, 50.0, 40.0 * i + 20, 80.0) for i in range(4)], "image_id long, gt_id long, class_id int, y1 double, x1 double, y2 double, x2 double")
    images = spark.createDataFrame([(1, 300.0, 200.0, 1.0), (2, 100.0, 90.0, 1.0)], schemas.IMAGES)
    rows = evaluate.random_rois(gt, images, 100).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in evaluate.random_rois(gt.repartition(3), images, 100).collect()}
    by = {i: [r for r in rows if r["image_id"] == i] for i in (1, 2)}
    assert all(90 <= len(v) <= 100 and sorted(r["roi_id"] for r in v) == list(range(1, len(v) + 1)) for v in by.values())
    limits = {1: (200, 300), 2: (90, 100)}
    assert all(0 <= r["y1"] <= r["y2"] - 1 and r["y2"] <= limits[r["image_id"]][0] and 0 <= r["x1"] <= r["x2"] - 1 and r["x2"] <= limits[r["image_id"]][1] for r in rows)
    assert sum(20 <= r["x1"] and r["x2"] <= 110 for r in by[1]) >= 85 and len({(r["y1"], r["x1"]) for r in by[1]}) > 80


def test_passes_of_recognition(spark):
    one_ = spark.createDataFrame([(1, 1, "Bath", 0.0, 0.0, 1.0, 1.0, 0.9, None)], schemas.TEXT_REGIONS)
    assert sorted(r["method"] for r in texts.recognised({"original": one_, "enhanced": one_.drop("method")}).collect()) == ["enhanced", "original"]


def test_losses(spark):
    p = F.array(F.lit(0.2), F.lit(0.8))
    assert abs(one(spark, evaluate.sparse_cross_entropy(F.lit(1), p)) + math.log(0.8)) < 1e-12
    assert one(spark, evaluate.sparse_cross_entropy(F.lit(2), p)) is None


def test_records(spark):
    d = spark.createDataFrame([(1, 2, 3, 0.9, 1.0, 2.0, 3.0, 4.0), (1, 1, 7, 0.9, 0.0, 0.0, 1.0, 1.0)], schemas.DETECTIONS)
    images = spark.createDataFrame([(1, 100.0, 50.0, 1.0), (2, 3000.0, 10.0, 1.0)], schemas.IMAGES)
    doors = spark.createDataFrame([(1, 7.5)], "image_id long, average_door double")
    rows = {r["image_id"]: r["legacy"] for r in prepare.detection_json(d, images, doors).collect()}
    assert [x["name"] for x in rows[1]["classes"]] == ["unknown", "door"] and rows[1]["points"][1]["x2"] == 4.0 and rows[1]["averageDoor"] == 7.5
    assert rows[2]["classes"] == [] and rows[2]["averageDoor"] == 0.0 and rows[2]["Width"] == 3000
    assert {tuple(r) for r in prepare.keep_ratio(images, 1000).collect()} == {(1, 1.0, 100, 50), (2, 1 / 3, 1000, 3)}
    stamp = {r["timestamp"] for r in prepare.stamped(images).collect()}
    assert len(stamp) == 1 and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}", stamp.pop())
    whole = lambda *x: F.array(*map(F.lit, x))
    meta = one(spark, prepare.parsed_meta(prepare.image_meta(F.lit(7), whole(1, 2, 3), whole(4, 5, 6), whole(0, 1, 2, 3), F.lit(0.5), F.array().cast("array<int>"))))
    assert meta["image_id"] == 7 and meta["window"] == [0, 1, 2, 3] and meta["scale"] == 0.5 and meta["active_class_ids"] == []
    assert prepare.without_zero_rows(spark.createDataFrame([(0, 0), (0, 1)], "a int, b int"), ["a", "b"]).count() == 1
