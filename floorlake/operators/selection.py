"""Which walls and lines a plan's drawing shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.functions import geometry as g
from floorlake.operators.suppress import greedy

#: Shorter lines aren't drawn, nor is what begins or ends in the legend, the corner of an image.
LEAST_LENGTH = 10.0
LEGEND_X, LEGEND_Y = 40.0, 140.0


def exterior_walls(walls: DataFrame, exterior: DataFrame) -> DataFrame:
    """Walls listed in ``exterior`` (image_id, wall_seq)."""
    return walls.join(exterior.select("image_id", "wall_seq"), ["image_id", "wall_seq"], "left_semi")


def interior_walls(walls: DataFrame, exterior: DataFrame) -> DataFrame:
    """Walls not listed in ``exterior`` (image_id, wall_seq)."""
    return walls.join(exterior.select("image_id", "wall_seq"), ["image_id", "wall_seq"], "left_anti")


def line_steps(points: DataFrame) -> DataFrame:
    """path_id, pos, x1, y1, x2, y2: the steps that are drawn of each path (path_id, pos, x, y).

    Paths shorter than LEAST_LENGTH or of fewer than two different points have none, nor is a step
    drawn that touches the legend.
    """
    w = Window.partitionBy("path_id").orderBy("pos")
    whole = Window.partitionBy("path_id")
    steps = points.select("path_id", "pos", F.lag("x").over(w).alias("x1"), F.lag("y").over(w).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    size = F.coalesce(g.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), F.lit(0.0))
    # a path with any length has two different points
    long = steps.withColumn("length", F.sum(size).over(whole)).filter((F.col("length") >= LEAST_LENGTH) & F.col("x1").isNotNull()).drop("length")
    legend = lambda x, y: (F.col(x) < LEGEND_X) & (F.col(y) < LEGEND_Y)
    return long.filter(~(legend("x1", "y1") | legend("x2", "y2")))


def without_line(boxes: DataFrame, drawn: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes (image_id, det_id, y1, x1, y2, x2), in the order of det_id, of which no drawn box or earlier one taken covers more than ``share``.

    One image's boxes that no drawn box covers are folded as one array.
    """
    b, d = boxes.alias("b"), drawn.alias("d")
    covered = F.try_divide(g.intersection(g.box("b."), g.box("d.")), g.area(g.box("b.")))
    left = b.join(d, (F.col("b.image_id") == F.col("d.image_id")) & (covered > share), "left_anti")
    clashes = lambda k, x: F.coalesce(F.try_divide(g.intersection(g.box_in(k), g.box_in(x)), g.area(g.box_in(x))) > share, F.lit(False))
    return greedy(left, ["image_id"], F.struct(F.col("det_id").alias("i")), ["det_id", "y1", "x1", "y2", "x2"], clashes)
