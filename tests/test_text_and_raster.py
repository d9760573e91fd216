import numpy as np
import pytest
from pyspark.sql import functions as F

from floorlake import queries, schemas
from floorlake.adapters import Views
from floorlake.functions import text as t
from floorlake.operators import raster, texts


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("  living  ROOM ", "Living Room"), ("EAT-IN kitchen1a bath", "Eat-In Kitchen1A Bath"), ("1/2 bath 3", "1/2 Bath 3"), ("Bath1", "Bath1"), ("Kitchen 2", "Kitchen"),
        ("bedroom 2", "Bedroom 2"), ("x", ""), ("a den", "A Den"), ("안방 1", "안방"), ("거실!", "거실"), ("den\U0001f600", ""), ("\\uc624h", ""), ("@@##", ""), ("", ""), (None, None),
    ],
)
def test_clean_room_name(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(t.clean_room_name(F.col("t"))).first()[0] == want


def test_similarity(spark):
    pairs = [("laundry", "lauivdry", 0.375), ("", "", 0.0), ("a", "", 0.0), ("bath", "bath", 1.0)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string, w double").select(t.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [p[2] for p in pairs]


REASONS = [
    ("Living Room", 0.9, None), ("", 0.9, "empty"), (None, 0.9, "empty"), ("x", 0.9, "single_character"), ("Zzyzx", 0.2, "low_confidence"), ("dining", 0.2, None), ("dining", None, None), ("@@##a", 0.9, "not_alphanumeric"),
    ("alamy room", 0.9, "watermark"), ("12", 0.9, "number"), ("123", 0.9, None), ("North Wing", 0.9, "descriptive"), ("fire exit", 0.9, "descriptor"), ("the quick brown fox", 0.9, "too_many_words"),
    ("abcdefghijklmnopqrstuvwxyzabcd", 0.9, None), ("abcdefghijklmnopqrstuvwxyzabcde", 0.9, "too_long"), ("거실", 0.9, None), ("conference room", 0.9, None), ("1/2 Bath", 0.9, None),
]


def test_reject_reasons(spark):
    rows = [(1, i, x, 400.0, 400.0, 450.0, 420.0, c, "original") for i, (x, c, _) in enumerate(REASONS)]
    images = spark.createDataFrame([(1, 1000.0, 1000.0, 1.0)], schemas.IMAGES)
    got = {r["region_id"]: r["reject_reason"] for r in texts.room_reasons(spark.createDataFrame(rows, schemas.TEXT_REGIONS), images).collect()}
    assert [got[i] for i in range(len(REASONS))] == [w for *_, w in REASONS]
    places = [(0, 0, 50, 20, "title_area"), (400, 860, 450, 880, "legend_area"), (0, 400, 50, 420, "margin"), (400, 400, 402, 402, "too_small"), (400, 400, 600, 500, "too_large")]
    rows = [(1, i, "Kitchen", float(a), float(b), float(c), float(d), 0.9, "original") for i, (a, b, c, d, _) in enumerate(places)]
    got = {r["region_id"]: r["reject_reason"] for r in texts.room_reasons(spark.createDataFrame(rows, schemas.TEXT_REGIONS), images).collect()}
    assert [got[i] for i in range(5)] == [p[4] for p in places]


def regions(spark, rows):
    return spark.createDataFrame([(1, i, x, float(a), float(b), float(a) + 20, float(b) + 10, c, m) for i, (x, a, b, c, m) in enumerate(rows)], schemas.TEXT_REGIONS)


def test_duplicates(spark):
    d = regions(spark, [("Bedroom", 0, 0, 0.5, "original"), ("bedroom 1", 5, 5, 0.9, "enhanced"), ("Kitchen", 5, 5, 0.4, "original"), ("bedroom", 300, 300, 0.2, "original"), ("", 0, 0, 0.9, "original"), ("z", 9, 9, 0.9, "preprocessed_upscaled"), ("faint", 9, 9, 0.05, "original")])
    kept = texts.accepted(d)
    assert {r["region_id"] for r in kept.collect()} == {0, 1, 2, 3}
    assert {r["region_id"] for r in texts.dedup_regions(kept).collect()} == {1, 2, 3}
    assert {r["region_id"] for r in texts.cluster_regions(kept).collect()} == {1, 2, 3}


def test_merging(spark):
    d = regions(spark, [("room", 60, 2, 0.5, "original"), ("living", 0, 0, 0.9, "enhanced"), ("master", 0, 200, 0.4, "original"), ("bedroom", 40, 205, 0.3, "original"), ("room", 500, 200, 0.6, "original"), ("x", 0, 400, 0.5, "original"), ("formal", 0, 600, 0.5, "original"), ("lounge", 60, 600, 0.5, "original")])
    rows = {r["text"]: r for r in texts.merge_regions(d).collect()}
    # the pair is compared in alphabetical order, in which "master bedroom" is no listed name
    assert set(rows) == {"living room", "master", "bedroom", "room", "x", "formal lounge"}
    assert (rows["living room"]["x2"], rows["living room"]["confidence"], rows["living room"]["method"]) == (80.0, 0.9, "enhanced+original")
    images = spark.createDataFrame([(1, 2000.0, 2000.0, 2.0)], schemas.IMAGES)
    moved = d.withColumns({c: F.col(c) + 900 for c in ("x1", "y1", "x2", "y2")})
    names = [(r["space_id"], r["name"]) for r in texts.space_names(moved, images).orderBy("space_id").collect()]
    assert names == [("SPACE_1", "Living Room"), ("SPACE_2", "Master"), ("SPACE_3", "Room"), ("SPACE_4", "Bedroom"), ("SPACE_5", "Formal Lounge")]


def drawn(text):
    return np.array([[c == "#" for c in line] for line in text.split()])


def test_components():
    m = drawn("##..# ##... ....# #...#")
    assert raster.components(m).tolist() == [[1, 1, 0, 0, 2], [1, 1, 0, 0, 0], [0, 0, 0, 0, 3], [4, 0, 0, 0, 3]]
    assert raster.components(np.zeros((3, 3), bool)).max() == 0
    spiral = drawn("######## #......# #.####.# #.#..#.# #.##.#.# #....#.# ######.#")
    assert raster.components(spiral).max() == 1
    assert raster.drop_small(m, 2).sum() == 6


def test_distances():
    rng = np.random.default_rng(2)
    m = rng.random((17, 13)) < 0.85
    outside = np.argwhere(~m)
    want = [[np.sqrt(((outside - (y, x)) ** 2).sum(1).min()) if m[y, x] else 0 for x in range(13)] for y in range(17)]
    assert np.allclose(raster.distances(m), want)


def test_skeleton_and_walk():
    bar = np.zeros((15, 60), bool)
    bar[5:10, 5:55] = True
    bones = raster.skeleton(bar)
    assert raster.components(bones).max() == 1 and not (bones & ~bar).any()
    line = raster.walk(list(zip(*np.nonzero(bones), strict=True)))
    assert len(line) > 40 and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(line, line[1:], strict=False))
    assert raster.walk([]) == [] and raster.walk([(3, 3)]) == [(3, 3)]
    assert raster.nearest_first([(0, 0), (5, 5), (1, 1)]) == [(0, 0), (1, 1), (5, 5)]
    assert raster.nearest_inside(bar, 2, 10, 5) == (5, 7) and raster.nearest_inside(bar, 0, 30, 3) is None


def runs_of(spark, mask, image_id=1):
    rows = [(image_id, 1, 1, int(y), int(x), int(x) + 1) for y, x in zip(*np.nonzero(mask), strict=True)]
    return spark.createDataFrame(rows, schemas.MASK_RUNS)


def test_segments_of_a_cross(spark):
    m = np.zeros((240, 240), bool)
    m[95:106, 40:200] = True
    m[20:180, 95:106] = True
    d = runs_of(spark, m)
    joints = raster.raster_junctions(d, cleaned=False).collect()
    assert len(joints) == 1 and abs(joints[0]["x"] - 100) <= 5 and abs(joints[0]["y"] - 100) <= 5
    lines = raster.wall_segments(d, cleaned=False).groupBy("wall_seq").count().collect()
    assert len(lines) == 4
    # opened, a crossing of thin lines is none
    assert raster.raster_junctions(d).count() == 0 and raster.wall_segments(d).select("wall_seq").distinct().count() == 1
    thick = raster.wall_thickness(d).collect()
    assert all(4 <= r["minimum"] <= r["average"] <= r["maximum"] <= 16 and len(r["profile"]) > 5 for r in thick)


def plain_junctions(m, most=20):
    """The rule in single steps: open by a cross, look at every fifth pixel, three directions two pixels away, 30 pixels apart."""
    h, w = m.shape
    at = lambda a, y, x: 0 <= y < h and 0 <= x < w and bool(a[y][x])
    near = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    small = [[all(at(m, y + a, x + b) for a, b in near) for x in range(w)] for y in range(h)]
    opened = [[any(at(small, y + a, x + b) for a, b in near) for x in range(w)] for y in range(h)]
    kept = []
    for y in range(5, h - 5, 5):
        for x in range(5, w - 5, 5):
            ways = sum(at(opened, y + a, x + b) for a in (-2, 0, 2) for b in (-2, 0, 2) if a or b)
            if at(opened, y, x) and ways >= 3 and 20 < x < w - 20 and 20 < y < h - 20 and all((y - a) ** 2 + (x - b) ** 2 >= 900 for a, b in kept):
                kept.append((y, x))
    if len(kept) > most:
        score = lambda p: sum(at(opened, p[0] + a, p[1] + b) for a in range(-3, 4) for b in range(-3, 4))
        kept = sorted(kept, key=lambda p: (score(p), p[1], p[0]), reverse=True)[:most]
    return kept


def test_junctions_by_the_rule():
    rng = np.random.default_rng(5)
    for share, shape, most in ((0.5, (120, 150), 20), (0.8, (160, 130), 20), (0.9, (150, 200), 3), (0.05, (90, 90), 20)):
        m = rng.random(shape) < share
        assert raster.branch_points(m, size=shape, most=most) == plain_junctions(m, most)


def test_centered_line_stays_inside():
    ring = np.zeros((60, 60), bool)
    ring[5:55, 5:55] = True
    ring[15:45, 15:45] = False
    line = raster.centered_line(ring)
    assert len(line) >= 2 and all(ring[int(y), int(x)] for x, y in line)
    few = np.zeros((9, 9), bool)
    few[4, :9] = True
    assert raster.centered_line(few) == []
    square = np.zeros((30, 30), bool)
    square[5:25, 5:25] = True
    assert len({round(x, 6) for x, _ in raster.centered_line(square)}) == 1  # equal sides: along its height


def test_centered_line(spark):
    m = np.zeros((40, 140), bool)
    m[10:21, 10:130] = True
    line = raster.centered_lines(runs_of(spark, m)).orderBy("pos").collect()
    assert 3 <= len(line) <= 20 and all(abs(r["y"] - 15) < 0.01 for r in line)
    assert raster.centered_line(np.zeros((5, 5), bool)) == []
    one = spark.createDataFrame([(1, 1, 1, 5, 7, 7)], schemas.MASK_RUNS)
    assert raster.wall_segments(one).count() == 0


def test_every_wall_becomes_a_bar(spark, tmp_path):
    spark.range(20).selectExpr("id event_id", "1L user_id", "'view' event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert queries.crossing_bars(Views(spark, str(tmp_path))).select("det_id").distinct().count() == 20
    lines = queries.QUERIES["centered_centerline"](spark, str(tmp_path))
    assert {r["det_id"] for r in lines.select("det_id").distinct().collect()} == set(range(20))
