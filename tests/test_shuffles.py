"""What grows into pixels is dealt before it does and never broadcast, and what took its place gives the same rows."""

from pyspark.sql import functions as F

from floorlake import picture_queries, queries
from floorlake.adapters import Views
from floorlake.functions import geometry as g
from floorlake.operators import evaluate, masks, matching, metrics, pairs

IMAGES = "image_id long, width double, height double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark, path, n=60):
    rows = [(e, e % 3, ("view", "signup", "purchase")[e % 3]) for e in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(path / "events.parquet"))
    return str(path)


def test_pixels_are_not_shuffled_by_windows(spark, tmp_path):
    d = events(spark, tmp_path)
    for name in ("window_sums", "mean_threshold", "adaptive_threshold"):
        # the pictures' rows, and the images among them
        assert plan(queries.QUERIES[name](spark, d)).count("Exchange hashpartitioning") == 2


def test_pixels_are_not_broadcast(spark, tmp_path):
    d = events(spark, tmp_path)
    for name in ("box_brightness", "equalised_pixels", "unmolded_masks", "expanded_masks", "transposed_masks"):
        for line in plan(queries.QUERIES[name](spark, d)).splitlines():
            # sizes of images may be
            assert "BroadcastHashJoin" not in line or "BroadcastHashJoin [image_id" in line and ", y#" not in line and "det_id" not in line and "tx" not in line


def test_masks_are_shuffled_once_to_be_transposed(spark, tmp_path):
    v = Views(spark, events(spark, tmp_path))
    assert plan(picture_queries.transposed_masks(v)).count("Exchange") == 1


def test_growing_twice_in_one_step(spark):
    images = spark.createDataFrame([(1, 40.0, 30.0)], IMAGES)
    runs = [(1, 5, 6, 9), (1, 12, -9, -4), (1, 13, -3, 2), (1, -8, 20, 23), (1, -3, 30, 31), (1, 33, 38, 45), (1, 29, 41, 60), (1, 29, 15, 15), (1, 36, 3, 5)]
    d = spark.createDataFrame(runs, "image_id long, y long, x_start long, x_end long")
    pixels = lambda r: sorted((x["y"], x["x_start"], x["x_end"]) for x in r.collect())
    for h, w, a, b in ((3, 5, 7, 7), (4, 4, 8, 6), (1, 2, 6, 1), (10, 10, 20, 20)):
        slow = masks.dilate_runs(masks.dilate_runs(d, images, h, w), images, a, b)
        assert pixels(masks.dilate_runs(d, images, h, w, (a, b))) == pixels(slow) and slow.count() > 0


def test_a_spread_of_two_is_no_matter_of_order(spark):
    thickness = [5, 9, 4, 10, 4, 10, 7, 5, 7, 4, 6, 6, 9, 10, 9, 5, 6, 8, 7, 9, 5, 7, 7, 4, 8, 9, 9]
    assert sum((27 * t - sum(thickness)) ** 2 for t in thickness) == 4 * 27**3
    said = set()
    for turn in range(0, 27, 3):
        rows = [(1, 10.0, float(t), 0.0, 1, 1) for t in thickness[turn:] + thickness[:turn]]
        for some in (rows, rows[::-1]):
            walls = spark.createDataFrame(some, "image_id long, length double, thickness double, orientation double, start_junction int, end_junction int").coalesce(1)
            junctions = spark.createDataFrame([], "image_id long, wall_count long")
            got = metrics.wall_insights(walls, junctions, walls.select("image_id").distinct()).select(F.explode("insights").alias("i"))
            said |= {r["i"] for r in got.collect() if "thickness" in r["i"]}
    assert said == {"Variable wall thickness detected - may indicate different wall types"}


def test_templates_meet_pixels_without_a_broadcast_of_these(spark):
    pixels = spark.createDataFrame([(1, y, x, (y * 5 + x * 3) % 17 * 10) for y in range(6) for x in range(6)], "image_id long, y long, x long, value long")
    templates = spark.createDataFrame([(1, y, x, (y * 5 + x * 3) % 17 * 10) for y in range(3) for x in range(3)], "template_id long, y long, x long, value long")
    found = matching.template_hits(pixels, templates)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in text.splitlines() if "BroadcastHashJoin" in line and "__y" in line] and "SortMergeJoin" in text
    assert (1, 0, 0) in [(r["template_id"], r["y"], r["x"]) for r in found.collect()]


def test_levels_are_dealt_before_they_are_boxes(spark, tmp_path):
    rows = [(e, e % 40, "view") for e in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "many" / "events.parquet"))
    found = queries.QUERIES["anchor_pyramid"](spark, str(tmp_path / "many"))
    by_task = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("image_id").alias("images")).collect()
    assert len(by_task) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["images"] for r in by_task) == 40


def test_anchors_rounded_by_grid_line_are_those_rounded_by_box(spark):
    shapes = evaluate.backbone_shapes(spark.createDataFrame([(1, 100.0, 70.0), (2, 4.0, 9.0)], IMAGES))
    scales = {4: 32.0, 8: 64.0, 16: 128.0, 32: 256.0, 64: 512.0}
    sides = ("y1", "x1", "y2", "x2")
    for step in (1, 3):
        want = evaluate.anchor_boxes(shapes, scales, step=step).withColumns({c: F.round(c, 3) for c in sides})
        got = evaluate.anchor_boxes(shapes, scales, step=step, digits=3)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_segments_meet_windows_in_many_tasks_and_far_ones_are_not_compared(spark, tmp_path):
    rows = [(e, e % 40, ("view", "signup")[e % 2]) for e in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    v = Views(spark, str(tmp_path))
    met = pairs.first_windows(v.segments.filter("seg_id % 4 = 0 or image_id % 2 = 0"), v.detections.withColumn("image_id", F.col("image_id") - F.col("image_id") % 2).filter("class_id = 2"))
    text = plan(met)
    # dealt by image whatever the file's parts are, and cheap bounds come before crossings
    assert text.count("REPARTITION_BY_NUM") == 2
    condition = next(line for line in text.splitlines() if "Join" in line and "image_id" in line)
    assert "greatest(" in condition


def test_first_windows_against_every_pair(spark):
    ends = [(0, 0, 30, 0), (0, 0, 0, 30), (50, 50, 50.0000001, 90), (-20, 7, 60, 7.5), (5, 5, 6, 6), (40, 0, 0, 40), (17, 3, 16.9, 60), (80, 80, 90, 90), (None, 5.0, 12.0, 12.0), (36, 10, 60, 10), (36.5, 10, 60, 10)]
    s = spark.createDataFrame([(1, i, *[None if c is None else float(c) for c in e]) for i, e in enumerate(ends)], "image_id long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    boxes = [(10, 10, 30, 30), (0, 40, 20, 60), (48, 30, 52, 40), (200, 200, 210, 210), (16, 58, 18, 70)]
    w = spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate(boxes)], "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double")
    box = g.Box(F.col("w.y1") - 6, F.col("w.x1") - 6, F.col("w.y2") + 6, F.col("w.x2") + 6)
    every = s.alias("s").crossJoin(w.alias("w")).filter(g.segment_meets_box(g.Segment(*(F.col(f"s.{c}") for c in ("x1", "y1", "x2", "y2"))), box))
    want = sorted(map(tuple, every.groupBy("seg_id").agg(F.min("det_id")).collect()))
    assert sorted((r["seg_id"], r["det_id"]) for r in pairs.first_windows(s, w).collect()) == want and len(want) > 5
