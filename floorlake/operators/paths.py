"""Ordered points of a path: length, orientation, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.functions.geometry import distance


def path_length(points: DataFrame) -> DataFrame:
    """path_id, length: the sum of distances between neighbouring points; one point has length 0."""
    w = Window.partitionBy("path_id").orderBy("pos")
    step = distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"))
    return points.withColumn("step", step).groupBy("path_id").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def fold_angle(dy: Column, dx: Column) -> Column:
    """Direction in degrees, from 0 to less than 180 whichever way it runs."""
    angle = F.degrees(F.atan2(dy, dx))
    folded = F.when(angle < 0, angle + 180).otherwise(angle)
    return F.when(folded >= 180, folded - 180).otherwise(folded)


def path_orientation(points: DataFrame) -> DataFrame:
    """path_id, orientation_degrees from the first point to the last; 0 for a single point."""
    ends = points.groupBy("path_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"), F.count(F.lit(1)).alias("n"))
    angle = fold_angle(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x"))
    return ends.select("path_id", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(angle).alias("orientation_degrees"))


def smooth_path(points: DataFrame, reach: int = 1) -> DataFrame:
    """path_id, pos, x, y: each point the mean of itself and ``reach`` neighbours on both sides; paths too short for a full window stay as they are."""
    near = Window.partitionBy("path_id").orderBy("pos").rowsBetween(-reach, reach)
    n = F.count(F.lit(1)).over(Window.partitionBy("path_id"))
    mean = lambda c: F.when(n < 2 * reach + 1, F.col(c)).otherwise(F.avg(c).over(near)).alias(c)
    return points.select("path_id", "pos", mean("x"), mean("y"))


def wall_measures(walls: DataFrame, images: DataFrame) -> DataFrame:
    """Walls (image_id, wall_seq, sx, sy, ex, ey, thickness_avg) with length, thickness, orientation and box in mm."""
    s = F.col("mm_per_px")
    d = walls.join(images.select("image_id", "mm_per_px"), "image_id")
    return d.select(
        "image_id",
        "wall_seq",
        (distance(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")) * s).alias("length"),
        (F.col("thickness_avg") * s).alias("thickness"),
        fold_angle(F.col("ey") - F.col("sy"), F.col("ex") - F.col("sx")).alias("orientation"),
        (F.least("sx", "ex") * s).alias("x1"),
        (F.least("sy", "ey") * s).alias("y1"),
        (F.greatest("sx", "ex") * s).alias("x2"),
        (F.greatest("sy", "ey") * s).alias("y2"),
    )


def to_mm(points: Column, scale: Column) -> Column:
    """An array of (x, y) structs in mm; points without both coordinates are left out."""
    whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.transform(whole, lambda p: F.struct((p["x"] * scale).alias("x"), (p["y"] * scale).alias("y")))
