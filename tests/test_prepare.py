from pyspark.sql import functions as F

from floorlake import schemas
from floorlake.operators import masks, prepare


def test_resize_plans(spark):
    d = spark.createDataFrame([(1, 400.0, 200.0, 1.0), (2, 1000.0, 900.0, 1.0), (3, 4000.0, 1000.0, 1.0)], schemas.IMAGES)
    rows = {r["image_id"]: r for r in prepare.resize_plan(d).collect()}
    assert [rows[i]["scale"] for i in (1, 2, 3)] == [4.0, 1.0, 0.4]
    assert (rows[1]["y1"], rows[1]["x1"], rows[1]["y2"], rows[1]["x2"]) == (400, 0, 1200, 1600)
    p = {r["image_id"]: (r["out_width"], r["out_height"], r["y1"]) for r in prepare.resize_plan(d, mode="pad64").collect()}
    assert p == {1: (1600, 832, 16), 2: (1024, 960, 30), 3: (4032, 1024, 12)}
    assert prepare.resize_plan(d, mode="none").first()["out_width"] == 400
    boxes = spark.createDataFrame([(1, 1, 1, 0.9, 400.0, 0.0, 800.0, 400.0), (1, 2, 1, 0.9, 400.0, 0.0, 400.0, 400.0)], schemas.DETECTIONS)
    back = prepare.to_original(boxes, prepare.resize_plan(d)).collect()
    assert [(r["det_id"], r["y1"], r["x1"], r["y2"], r["x2"]) for r in back] == [(1, 0, 0, 100, 100)]


def test_records_and_masks(spark):
    d = spark.createDataFrame([(1, i, 1, 0.5, 0.0, 0.0, 4.0, 8.0) for i in range(6)], schemas.DETECTIONS)
    runs = spark.createDataFrame([(1, i, 1, 0, 0, i) for i in range(6)], schemas.MASK_RUNS)
    images = spark.createDataFrame([(1, 10.0, 10.0, 1.0)], schemas.IMAGES)
    rows = {r["det_id"]: r for r in prepare.object_records(d, runs, images).collect()}
    assert rows[0]["mask"] is None and rows[5]["mask"]["coverage_pct"] == 5.0 and rows[5]["center"]["x"] == 4.0
    assert {r["det_id"] for r in prepare.largest_masks(d, masks.mask_boxes(runs)).collect()} == {2, 3, 4, 5}


def test_small_parts(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first()["x"]
    assert one(prepare.label(F.lit("door"), F.lit(0.5))) == "door (0.50)"
    assert one(prepare.first_name(F.lit("a, b"))) == "a"
    p = one(prepare.checkpoint_parts(F.lit("/logs/plan20240131T0915/weights_plan_0007.h5")))
    assert (str(p["started"]), p["epoch"]) == ("2024-01-31 09:15:00", 7)
    assert one(prepare.checkpoint_parts(F.lit("x")))["epoch"] is None
    w = spark.createDataFrame([("a", "Dense", False, 1.0), ("a", "Dense", False, 1.0), ("b", "Conv2D", True, 0.0), ("c", "Dense", False, -2000.0), ("c", "Dense", False, 1.0)], "tensor string, kind string, is_bias boolean, value double")
    assert {r["tensor"]: r["alert"] for r in prepare.weight_stats(w).collect()} == {"a": "dead", "b": "", "c": "overflow"}
    r = spark.createDataFrame([(1, 1, "t", 1.0, 2.0, 3.0, 4.0, 0.5, "original")], schemas.TEXT_REGIONS)
    moved = prepare.in_region(r, spark.createDataFrame([(1, 10.0, 20.0)], "image_id long, crop_x1 double, crop_y1 double")).first()
    assert (moved["x1"], moved["y1"], moved["x2"], moved["y2"]) == (11.0, 22.0, 13.0, 24.0)
