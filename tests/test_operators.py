import pytest
from pyspark.sql import functions as F

from floorlake import schemas
from floorlake.operators import evaluate, masks, metrics, pairs, paths, segments, suppress
from floorlake.plans import reports

IMAGES = [(1, 1000.0, 1000.0, 2.0), (2, 100.0, 100.0, 1.0)]


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame(IMAGES, schemas.IMAGES)


def dets(spark, rows):
    return spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], schemas.DETECTIONS)


def test_overlaps_and_report(spark, images):
    d = dets(spark, [(1, 1, 1, 0.9, 0, 0, 10, 10), (1, 2, 1, 0.5, 0, 1, 10, 11), (1, 3, 3, 0.8, 500, 500, 600, 520), (1, 4, 1, 0.2, 0, 0, 100, 100)])
    assert [(r["a_id"], r["b_id"]) for r in pairs.overlap_pairs(d).collect()] == [(1, 2)]
    rows = {r["image_id"]: r for r in reports.accuracy_report(d, images).collect()}
    assert rows[1]["overall"]["total_detections"] == 4 and rows[1]["spatial"]["bbox_overlaps"] == 1
    assert rows[1]["quality"].asDict() == {"high_confidence": 1, "medium_confidence": 1, "low_confidence": 2}
    assert [x["reason"] for x in rows[1]["spatial"]["size_anomalies"]] == ["unusually_large"]
    assert rows[2]["overall"]["total_detections"] == 0 and rows[2]["objects"]["walls"]["count"] == 0
    assert rows[2]["reliability_score"] == 20 and rows[2]["recommendations"][-1].startswith("Low reliability")


def test_reliability_parts(spark):
    r = spark.range(1).select(metrics.reliability(F.lit(60), F.lit(1.0), F.lit(30), F.lit(5)).alias("x")).first()
    assert r["x"] == 40 + 15 + 0 + 0


def test_suppression_order(spark):
    d = dets(spark, [(1, 1, 1, 0.5, 0, 0, 10, 10), (1, 2, 1, 0.9, 0, 0, 10, 10), (1, 3, 1, 0.5, 0, 0, 10, 10), (1, 4, 2, 0.1, 0, 0, 10, 10), (2, 5, 1, 0.3, 5, 5, 5, 5)])
    assert {r["det_id"] for r in suppress.suppress_boxes(d).collect()} == {2, 4, 5}
    assert {r["det_id"] for r in suppress.refine_detections(d).collect()} == {2, 5}
    assert {r["det_id"] for r in suppress.top_detections(d, 1).collect()} == {2, 5}
    assert suppress.suppress_boxes(d.limit(0)).count() == 0
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 3, 30.0, 0.0)], "image_id long, p_id int, x double, y double")
    kept = lambda radius: [r["p_id"] for r in suppress.dedup_points(points, radius, F.col("p_id")).orderBy("p_id").collect()]
    assert kept(5.0) == [1, 2, 3] and kept(5.1) == [1, 3]


def test_suppression_of_a_large_group(spark):
    apart = [(1, i, 1, 0.5, 10 * (i % 100), 10 * (i // 100), 10 * (i % 100) + 5, 10 * (i // 100) + 5) for i in range(suppress.MAX_CANDIDATES + 50)]
    d = dets(spark, [*apart, (1, 9000, 1, 0.1, 0, 0, 5, 5), (2, 9001, 1, 0.9, 0, 0, 5, 5)])
    assert {r["det_id"] for r in suppress.suppress_boxes(d).collect()} == {*range(suppress.MAX_CANDIDATES + 50), 9001}


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.7])
def test_groups_of_any_size_are_suppressed_alike(spark, monkeypatch, threshold):
    rows = [(1 + i % 2, i, 1, (7919 * i % 100) / 100, 104729 * i % 90, 1299709 * i % 90, 104729 * i % 90 + 2 + 31 * i % 60, 1299709 * i % 90 + 2 + 37 * i % 50) for i in range(150)]
    d = dets(spark, [*rows, (1, 500, 1, 0.9, 7, 7, 7, 7)])
    kept = lambda: {r["det_id"] for r in suppress.suppress_boxes(d, threshold).collect()}
    want = kept()
    monkeypatch.setattr(suppress, "MAX_CANDIDATES", 5)
    assert kept() == want


def test_proposals(spark):
    a = spark.createDataFrame([(1, i, 0, 0.5 + i / 10, 0.1, 0.1, 0.4, 0.4, 0.0, 0.0, 0.0, 0.0) for i in range(3)], schemas.DETECTIONS + ", dy double, dx double, dh double, dw double")
    assert [r["det_id"] for r in suppress.proposals(a).collect()] == [2]


def test_walls_and_junctions(spark, images):
    walls = spark.createDataFrame([(1, 1, 10, 0.0, 0.0, 100.0, 0.0, 4.0), (1, 2, 11, 100.0, 0.0, 100.0, 200.0, 6.0), (1, 3, 12, 500.0, 500.0, 510.0, 500.0, 8.0)], schemas.WALLS)
    junctions = spark.createDataFrame([(1, 1, 104.0, 3.0), (1, 2, 100.0, 0.0), (1, 3, 800.0, 800.0)], schemas.JUNCTIONS)
    con = {r["wall_seq"]: (r["start_junction"], r["end_junction"]) for r in pairs.wall_connections(walls, junctions).collect()}
    assert con == {1: (None, 1), 2: (1, None), 3: (None, None)}
    kinds = {r["j_seq"]: (r["connected_walls"], r["junction_type"]) for r in pairs.junction_types(junctions, pairs.wall_connections(walls, junctions)).collect()}
    assert kinds == {1: ([1, 2], "corner"), 2: ([], "unknown"), 3: ([], "unknown")}
    ext = {r["wall_seq"]: r for r in reports.connected_walls(walls, junctions, images).collect()}
    assert ext[1]["exterior_reasons"] == ["left_boundary", "top_boundary", "long_boundary_wall"] and ext[1]["length"] == 200.0
    assert ext[3]["exterior_reasons"] == ["unconnected"]
    p = metrics.perimeter(reports.connected_walls(walls, junctions, images)).first()
    assert p["exterior_wall_count"] == 3 and p["perimeter_area"] == 0.0 and p["left"] == 0
    said = metrics.wall_insights(reports.connected_walls(walls, junctions, images), pairs.junction_types(junctions, pairs.wall_connections(walls, junctions)), images)
    assert {r["image_id"]: r["insights"][-1] for r in said.collect()}[2] == metrics.NO_WALLS
    more = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 1, 6.0, 6.0)], schemas.JUNCTIONS)
    assert sorted((r["image_id"], r["j_seq"]) for r in reports.with_fallback_junctions(junctions, more).collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]


def test_paths(spark):
    pts = [("a", 1, 0.0, 0.0), ("a", 2, 3.0, 4.0), ("a", 3, 3.0, 10.0), ("b", 1, 1.0, 1.0), ("c", 1, 10.0, 0.0), ("c", 2, 0.0, 0.0)]
    d = spark.createDataFrame(pts, "path_id string, pos int, x double, y double")
    assert {r["path_id"]: r["length"] for r in paths.path_length(d).collect()} == {"a": 11.0, "b": 0.0, "c": 10.0}
    angle = {r["path_id"]: r["orientation_degrees"] for r in paths.path_orientation(d).collect()}
    assert angle["b"] == 0 and angle["c"] == 0 and 73 < angle["a"] < 74
    smooth = {(r["path_id"], r["pos"]): r["x"] for r in paths.smooth_path(d).collect()}
    assert smooth["a", 1] == 1.5 and smooth["a", 2] == 2.0 and smooth["c", 1] == 10.0


def runs(spark, rows):
    return spark.createDataFrame(rows, schemas.MASK_RUNS)


def pixels(df):
    return {(r["image_id"], r["y"], x) for r in df.collect() for x in range(r["x_start"], r["x_end"])}


def test_masks(spark, images):
    a = runs(spark, [(1, 1, 1, 0, 0, 5), (1, 2, 1, 0, 5, 8), (1, 3, 1, 0, 9, 9), (1, 4, 1, 1, 2, 4), (2, 5, 1, 99, 98, 100)])
    b = runs(spark, [(1, 9, 3, 0, 3, 6), (1, 8, 3, 2, 0, 4)])
    assert [(r["x_start"], r["x_end"]) for r in masks.union_runs(a).filter("image_id = 1 and y = 0").collect()] == [(0, 8)]
    pa, pb = pixels(a), pixels(b)
    assert pixels(masks.except_runs(a, b)) == pa - pb and pixels(masks.intersect_runs(a, b)) == pa & pb
    grown = pixels(masks.dilate_runs(a, images, 3, 4))
    assert grown == {(i, y + dy, x + dx) for i, y, x in pa for dy in (-1, 0, 1) for dx in (-2, -1, 0, 1) if 0 <= y + dy < (1000 if i == 1 else 100) and 0 <= x + dx < (1000 if i == 1 else 100)}
    boxes = {r["det_id"]: (r["area"], r["y1"], r["x1"], r["y2"], r["x2"]) for r in masks.mask_boxes(a).collect()}
    assert boxes[1] == (5, 0, 0, 1, 5) and 3 not in boxes
    assert {(r["a_id"], r["b_id"]): r["iou"] for r in masks.mask_iou(a, b).collect()} == {(1, 9): 2 / 6, (2, 9): 1 / 5}
    d = dets(spark, [(1, 9, 3, 0.9, 0, 3, 1, 6)])
    assert pixels(masks.clean_walls(a, d, images)) == {p for p in pa if p[0] == 2}


def test_matching_and_average_precision(spark):
    gt = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1, 20.0, 20.0, 30.0, 30.0)], "image_id long, gt_id long, class_id int, y1 double, x1 double, y2 double, x2 double")
    row = lambda i, k, s, y: (1, i, k, s, y, y, y + 10, y + 10)
    pred = spark.createDataFrame([row(1, 1, 0.9, 0.0), row(2, 1, 0.8, 50.0), row(3, 1, 0.7, 20.0), row(4, 1, 0.6, 0.0), row(5, 2, 0.99, 20.0)], "image_id long, pred_id long, class_id int, score double, y1 double, x1 double, y2 double, x2 double")
    m = evaluate.greedy_matches(gt, pred)
    assert {r["pred_id"]: r["gt_id"] for r in m.collect()} == {1: 1, 2: None, 3: 2, 4: None, 5: None}
    pr = [(r["precision"], r["recall"]) for r in evaluate.precision_recall(m, gt).orderBy("rank").collect()]
    assert pr == [(0, 0), (1 / 2, 1 / 2), (1 / 3, 1 / 2), (2 / 4, 1), (2 / 5, 1)]
    assert evaluate.average_precision(m, gt).first()["ap"] == pytest.approx(0.5)
    perfect = evaluate.greedy_matches(gt, gt.withColumnRenamed("gt_id", "pred_id").withColumn("score", F.lit(1.0)))
    assert evaluate.average_precision(perfect, gt).first()["ap"] == 1.0
    assert evaluate.average_precision(m.limit(0), gt).first()["ap"] == 0.0
    assert evaluate.recall_at(gt, pred).first()["recall"] == 1.0
    labels = evaluate.assign_anchors(pred.withColumnRenamed("pred_id", "anchor_id"), gt)
    assert {r["anchor_id"]: r["label"] for r in labels.collect()} == {1: 1, 2: -1, 3: 1, 4: 1, 5: 1}


def test_split_around_windows(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 5.0, 100.0, 5.0), (1, 2, 0.0, 90.0, 100.0, 90.0), (1, 3, 45.0, 5.0, 55.0, 5.0), (1, 4, 50.0, 5.0, 100.0, 5.0)], schemas.SEGMENTS)
    w = dets(spark, [(1, 7, 2, 0.9, 0, 46, 10, 54), (1, 8, 2, 0.9, 0, 10, 10, 20)])
    parts = {}
    for r in segments.split_around_windows(s, w).orderBy("seg_id", "part").collect():
        parts.setdefault(r["seg_id"], []).append((r["x1"], r["x2"]))
    assert parts == {1: [(0.0, 40.0), (60.0, 100.0)], 2: [(0.0, 100.0)], 4: [(60.0, 100.0)]}


def test_doors(spark, images):
    d = dets(spark, [(1, 5, 3, 0.9, 100, 100, 160, 140), (1, 6, 3, 0.9, 120, 130, 150, 190), (1, 7, 2, 0.9, 0, 0, 10, 50)])
    rows = {r["det_id"]: r for r in reports.door_records(d, images).collect()}
    assert rows[5]["door_id"] == 1 and rows[5]["door_type"] == "vertical" and rows[5]["width_mm"] == 80.0 and rows[5]["from_left"] == "12.0%"
    assert rows[6]["door_use"] == "entrance" and rows[6]["hinge_side"] == "top_edge"
    said = {r["image_id"]: r["insights"] for r in metrics.door_insights(d.filter("class_id = 3"), pairs.close_doors(d.filter("class_id = 3"), images), images).collect()}
    assert said[1] == ["Found 1 pairs of doors in close proximity", "Mixed door orientation layout"]
    assert said[2] == ["No doors detected for layout analysis"]
    assert [r["window_id"] for r in reports.window_records(d, images).collect()] == [1]


def test_icons(spark):
    d = spark.createDataFrame([(100.0, 10.0, 10.0, 40.0, 100.0), (100.0, 30.0, 10.0, 40.0, 100.0), (500.0, 20.0, 20.0, 80.0, 100.0)], "area double, width double, height double, perimeter double, mean double")
    assert pairs.icon_candidates(d).count() == 1


def test_ap_over_thresholds_keeps_a_prediction_one_row(spark):
    n = 60
    gt = spark.range(n).selectExpr("id % 4 image_id", "id gt_id", "cast(id % 2 as int) class_id", "cast(id * 37 % 90 as double) y1", "cast(id * 53 % 90 as double) x1").selectExpr("*", "y1 + 20 y2", "x1 + 20 x2")
    pred = gt.filter("image_id < 3").selectExpr("image_id", "gt_id pred_id", "class_id", "gt_id * 7 % 10 / 10D score", "y1 + gt_id % 5 y1", "x1 - gt_id % 7 x1", "y2 + gt_id % 5 y2", "x2 - gt_id % 3 x2")
    steps = [0.5, 0.6, 0.75, 0.9]
    got = evaluate.ap_over_thresholds(gt, pred, steps)
    each = [{r["image_id"]: r["ap"] for r in evaluate.average_precision(evaluate.greedy_matches(gt, pred, t), gt).collect()} for t in steps]
    for r in got.collect():
        assert r["ap"] == pytest.approx(sum(e[r["image_id"]] for e in each) / len(steps))
    assert len(each[0]) == 4 and {e[3] for e in each} == {0.0} and 0 < each[3][0] < each[0][0]
    # the windows and what is sorted for them are of predictions, not of predictions and thresholds
    text = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 2 and not [line for line in windows if "threshold" in line]
