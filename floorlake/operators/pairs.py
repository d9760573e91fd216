"""Joins between boxes, walls, junctions, masks and texts. Every one has an equality on image_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorlake.functions import geometry as g
from floorlake.staging import by_image


def _pairs(dets: DataFrame, condition: Column) -> DataFrame:
    a, b = dets.alias("a"), dets.alias("b")
    return a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.det_id") < F.col("b.det_id")) & condition)


def overlap_pairs(dets: DataFrame, threshold: float = 0.3) -> DataFrame:
    """image_id, a_id, b_id, iou of detections of one image that overlap by more than ``threshold``."""
    iou = g.iou(g.box("a."), g.box("b."))
    return _pairs(dets, iou > threshold).select("a.image_id", F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), iou.alias("iou"))


def overlap_counts(dets: DataFrame, threshold: float = 0.3) -> DataFrame:
    """image_id, overlaps; images without any have 0."""
    n = overlap_pairs(dets, threshold).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return dets.select("image_id").distinct().join(n, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("overlaps"))


def box_junctions(walls: DataFrame) -> DataFrame:
    """image_id, a_id, b_id, x, y: the middle of what two wall boxes share, touching ones included."""
    a, b = g.box("a."), g.box("b.")
    x = (F.greatest(a.x1, b.x1) + F.least(a.x2, b.x2)) / 2
    y = (F.greatest(a.y1, b.y1) + F.least(a.y2, b.y2)) / 2
    return _pairs(walls, g.touches(a, b)).select("a.image_id", F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), x.alias("x"), y.alias("y"))


def iou_matrix(first: DataFrame, second: DataFrame) -> DataFrame:
    """image_id, a_id, b_id, iou of every pair of a first and a second box of an image."""
    a, b = first.alias("a"), second.alias("b")
    pairs = a.join(b, F.col("a.image_id") == F.col("b.image_id"))
    return pairs.select("a.image_id", F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), g.iou(g.box("a."), g.box("b.")).alias("iou"))


def wall_connections(walls: DataFrame, junctions: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """image_id, wall_seq, start_junction, end_junction: the first junction in order within ``tolerance`` of each end, or null."""
    w, j = walls.alias("w"), junctions.alias("j")

    def near(x: str, y: str) -> Column:
        return F.when(g.distance(F.col(x), F.col(y), F.col("j.x"), F.col("j.y")) <= tolerance, F.col("j.j_seq"))

    reach = tolerance + 1e-9
    around = lambda x, y: (F.abs(F.col(x) - F.col("j.x")) <= reach) & (F.abs(F.col(y) - F.col("j.y")) <= reach)
    pairs = w.join(j, (F.col("w.image_id") == F.col("j.image_id")) & (around("w.sx", "w.sy") | around("w.ex", "w.ey")), "left")
    return pairs.groupBy("w.image_id", "w.wall_seq").agg(F.min(near("w.sx", "w.sy")).alias("start_junction"), F.min(near("w.ex", "w.ey")).alias("end_junction"))


def junction_types(junctions: DataFrame, connections: DataFrame) -> DataFrame:
    """image_id, j_seq, connected_walls, wall_count, junction_type; a junction without walls stays, with an empty list.

    The list holds up to as many walls as an image has.
    """
    ends = connections.select("image_id", "wall_seq", F.explode(F.array_distinct(F.array("start_junction", "end_junction"))).alias("j_seq")).filter("j_seq is not null")
    walls = ends.groupBy("image_id", "j_seq").agg(F.array_sort(F.collect_list("wall_seq")).alias("walls"))
    n = F.coalesce(F.size("walls"), F.lit(0))
    kind = F.when(n == 2, "corner").when(n == 3, "T_junction").when(n == 4, "cross_junction").when(n > 4, "complex_junction").otherwise("unknown")
    return junctions.join(walls, ["image_id", "j_seq"], "left").select(
        "image_id", "j_seq", F.coalesce("walls", F.array().cast("array<int>")).alias("connected_walls"), n.cast("long").alias("wall_count"), kind.alias("junction_type")
    )


def uncovered_walls(walls: DataFrame, doors: DataFrame, share: float = 0.35) -> DataFrame:
    """Walls of whose box no door covers more than ``share``; a box counts one square pixel at least."""
    w, d = walls.alias("w"), doors.alias("d")
    covered = g.intersection(g.box("w."), g.box("d.")) / F.greatest(F.lit(1.0), g.area(g.box("w.")))
    return w.join(d, (F.col("w.image_id") == F.col("d.image_id")) & (covered > share), "left_anti")


def first_windows(segments: DataFrame, windows: DataFrame, margin: float = 6.0) -> DataFrame:
    """image_id, seg_id, det_id and box of the first window in order that each segment meets, ``margin`` added around it."""
    # few bytes, but many pairs: those of a file would be one task
    s, w = by_image(segments).alias("s"), by_image(windows).alias("w")
    box = g.Box(F.col("w.y1") - margin, F.col("w.x1") - margin, F.col("w.y2") + margin, F.col("w.x2") + margin)
    segment = g.Segment(*(F.col(f"s.{c}") for c in ("x1", "y1", "x2", "y2")))
    # lines beyond a box by a pixel meet it only by rounding, which moves a crossing so far on lines that are all but level or upright
    apart = lambda a, b, low, high: (F.greatest(a, b) < low - 1) | (F.least(a, b) > high + 1)
    steep = lambda a, b: (a != b) & (F.abs(a - b) < 1)
    near = ~(apart(segment.x1, segment.x2, box.x1, box.x2) | apart(segment.y1, segment.y2, box.y1, box.y2)) | steep(segment.x1, segment.x2) | steep(segment.y1, segment.y2)
    pairs = s.join(w, (F.col("s.image_id") == F.col("w.image_id")) & near & g.segment_meets_box(segment, box))
    found = F.struct(F.col("w.det_id").alias("det_id"), *[v.alias(c) for c, v in box._asdict().items()])
    return pairs.groupBy("s.image_id", "s.seg_id").agg(F.min(found).alias("w")).select("image_id", "seg_id", "w.*")


def close_doors(doors: DataFrame, images: DataFrame, share: float = 0.2) -> DataFrame:
    """image_id, close_pairs: door pairs nearer than ``share`` of the image's smaller side; images with doors only."""
    limited = doors.join(images.select("image_id", F.least("width", "height").alias("side")), "image_id")
    a, b = g.box("a."), g.box("b.")
    near = g.distance(g.center_x(a), g.center_y(a), g.center_x(b), g.center_y(b)) < F.col("a.side") * share
    n = _pairs(limited, near).groupBy("a.image_id").agg(F.count(F.lit(1)).alias("n"))
    return doors.select("image_id").distinct().join(n, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("close_pairs"))


def icon_candidates(contours: DataFrame) -> DataFrame:
    """Contours (area, width, height, perimeter, mean) that may be icons: area, proportion, roundness and brightness in range."""
    round_ = 4 * F.lit(3.141592653589793) * F.col("area") / F.nullif(F.col("perimeter") * F.col("perimeter"), F.lit(0.0))
    ratio = F.try_divide(F.col("width"), F.col("height"))
    return contours.filter(F.col("area").between(25, 400) & ratio.between(0.6, 1.4) & (round_ >= 0.5) & F.col("mean").between(50, 240))
