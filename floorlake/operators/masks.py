"""Masks as runs: (image_id, det_id, class_id, y, x_start, x_end), ends outside. Set operations work on runs, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.staging import by_image


def mask_boxes(runs: DataFrame) -> DataFrame:
    """image_id, det_id, area, y1, x1, y2, x2: pixels and box of each mask, far edges outside. Empty runs count for nothing."""
    full = runs.filter("x_end > x_start")
    return full.groupBy("image_id", "det_id").agg(
        F.sum(F.col("x_end") - F.col("x_start")).alias("area"), F.min("y").alias("y1"), F.min("x_start").alias("x1"), (F.max("y") + 1).alias("y2"), F.max("x_end").alias("x2")
    )


def mask_summary(runs: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, det_id, pixels, total, coverage_pct and the box with its last row and column inside."""
    total = (F.col("width") * F.col("height")).cast("long")
    b = mask_boxes(runs).join(images, "image_id")
    return b.select("image_id", "det_id", F.col("area").alias("pixels"), total.alias("total"), (F.try_divide(F.col("area"), total) * 100).alias("coverage_pct"), "y1", "x1", (F.col("y2") - 1).alias("y2"), (F.col("x2") - 1).alias("x2"))


def mask_iou(first: DataFrame, second: DataFrame) -> DataFrame:
    """image_id, a_id, b_id, iou of masks that share a pixel. Runs of one mask don't overlap."""
    a, b = first.alias("a"), second.alias("b")
    meet = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.x_start") < F.col("b.x_end")) & (F.col("b.x_start") < F.col("a.x_end"))
    shared = F.least("a.x_end", "b.x_end") - F.greatest("a.x_start", "b.x_start")
    inter = a.join(b, meet).groupBy("a.image_id", F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id")).agg(F.sum(shared).alias("inter"))
    size = lambda d, i, n: mask_boxes(d).select("image_id", F.col("det_id").alias(i), F.col("area").alias(n))
    joined = inter.join(size(first, "a_id", "na"), ["image_id", "a_id"]).join(size(second, "b_id", "nb"), ["image_id", "b_id"])
    return joined.select("image_id", "a_id", "b_id", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("iou"))


def union_runs(runs: DataFrame) -> DataFrame:
    """image_id, y, x_start, x_end: runs of any mask joined, touching ones too."""
    order = Window.partitionBy("image_id", "y").orderBy("x_start", "x_end")
    before = F.max("x_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    full = runs.filter("x_end > x_start").select("image_id", "y", "x_start", "x_end")
    opened = full.withColumn("new", F.coalesce(F.col("x_start") > before, F.lit(True)).cast("int"))
    named = opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return named.groupBy("image_id", "y", "island").agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end")).drop("island")


def _cut(first: DataFrame, second: DataFrame, wanted: str) -> DataFrame:
    """Pieces of both unions between neighbouring ends where ``wanted`` holds of (in_a, in_b), joined again: no shuffle but that by row."""
    ends = lambda d, a, b: union_runs(d).select(
        "image_id", "y", F.explode(F.array(F.struct(F.col("x_start").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x_end").alias("x"), F.lit(-1).alias("d")))).alias("e")
    ).select("image_id", "y", "e.x", (F.col("e.d") * a).alias("da"), (F.col("e.d") * b).alias("db"))
    steps = ends(first, 1, 0).union(ends(second, 0, 1))
    order = Window.partitionBy("image_id", "y").orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # of ends at one place the last has counted all, and only its piece has a length
    pieces = steps.select("image_id", "y", F.col("x").alias("x_start"), F.lead("x").over(order).alias("x_end"), (F.sum("da").over(upto) > 0).alias("in_a"), (F.sum("db").over(upto) > 0).alias("in_b"))
    return union_runs(pieces.filter(wanted))


def except_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pixels of the first masks that no second mask has."""
    return _cut(first, second, "in_a and not in_b")


def intersect_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pixels that both a first and a second mask have."""
    return _cut(first, second, "in_a and in_b")


def dilate_runs(runs: DataFrame, images: DataFrame, height: int, width: int, *more: tuple[int, int]) -> DataFrame:
    """Masks grown by a rectangle of ``height`` x ``width`` pixels, inside the image, then by each of ``more`` in turn, inside it too.

    A rectangle of even size reaches one pixel farther up and to the left than down and to the right.
    """
    # once inside the image steps add up: between two of its pixels a way inside it is as long
    up, down = (sum((h - k) // 2 for h, _ in ((height, width), *more)) for k in (0, 1))
    left, right = (sum((w - k) // 2 for _, w in ((height, width), *more)) for k in (0, 1))
    size = images.select("image_id", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))
    # pixels outside count if the first step takes them inside
    inside = (F.col("y") >= -((height - 1) // 2)) & (F.col("y") < F.col("h") + height // 2)
    cut = {"x_start": F.greatest(F.col("x_start"), F.lit(-((width - 1) // 2)).cast("long")), "x_end": F.least(F.col("x_end"), F.col("w") + width // 2)}
    own = runs.select("image_id", "y", "x_start", "x_end").join(size, "image_id").filter(inside).withColumns(cut).filter("x_end > x_start")
    x1, x2 = F.greatest(F.col("x_start") - left, F.lit(0).cast("long")), F.least(F.col("x_end") + right, F.col("w"))
    first, last = F.greatest(F.col("y") - up, F.lit(0).cast("long")), F.least(F.col("y") + down, F.col("h") - 1)
    return union_runs(own.filter(first <= last).select("image_id", F.explode(F.sequence(first, last)).alias("y"), x1.alias("x_start"), x2.alias("x_end")))


def box_runs(dets: DataFrame, images: DataFrame, margin: int) -> DataFrame:
    """Boxes grown by ``margin`` pixels as runs, inside the image."""
    size = images.select("image_id", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))
    d = dets.join(size, "image_id")
    whole = lambda c: F.floor(F.col(c)).cast("long")
    y1, y2 = F.greatest(whole("y1") - margin, F.lit(0)), F.least(whole("y2") + margin, F.col("h"))
    x1, x2 = F.greatest(whole("x1") - margin, F.lit(0)), F.least(whole("x2") + margin, F.col("w"))
    rows = d.filter((y2 > y1) & (x2 > x1)).select("image_id", F.explode(F.sequence(y1, y2 - 1)).alias("y"), x1.alias("x_start"), x2.alias("x_end"))
    return union_runs(rows)


def clean_walls(runs: DataFrame, dets: DataFrame, images: DataFrame) -> DataFrame:
    """Wall pixels outside doors and windows, both grown: doors by 15 and 35 pixels and 40 around the box, windows by 10, 20 and 25."""
    # dealt before runs are grown to many rows, which then need no shuffle
    runs, dets = by_image(runs), by_image(dets)
    parts = []
    for class_id, first, second, margin in ((3, 15, 35, 40), (2, 10, 20, 25)):
        own = runs.filter(F.col("class_id") == class_id)
        parts.append(dilate_runs(own, images, first, first, (second, second)))
        parts.append(box_runs(dets.filter(F.col("class_id") == class_id), images, margin))
    holes = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return except_runs(runs.filter("class_id = 1"), holes)


def flipped_runs(runs: DataFrame, images: DataFrame) -> DataFrame:
    """Masks mirrored from left to right inside their image."""
    d = runs.join(images.select("image_id", F.col("width").cast("long").alias("w")), "image_id")
    return d.withColumns({"x_start": F.col("w") - F.col("x_end"), "x_end": F.col("w") - F.col("x_start")}).select(*runs.columns)


def ground_truth(runs: DataFrame, active: list[int] | None = None) -> DataFrame:
    """image_id, gt_id, class_id, y1, x1, y2, x2 of masks with a pixel or more, of the ``active`` classes where some are named."""
    own = runs if active is None else runs.filter(F.col("class_id").isin(active))
    kinds = own.filter("x_end > x_start").select("image_id", "det_id", "class_id").distinct()
    return mask_boxes(own).join(kinds, ["image_id", "det_id"]).select("image_id", F.col("det_id").alias("gt_id"), "class_id", "y1", "x1", "y2", "x2")
