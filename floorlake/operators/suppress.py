"""Greedy suppression and top-k. Box groups of bounded size are folded as arrays, larger ones decided by joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.functions import geometry as g
from floorlake.staging import staged

#: Anchors of an image that become proposals, by score, and the boxes of a group that are folded as one array.
MAX_CANDIDATES = 6000
#: Below this threshold overlapping boxes may differ too much in size to be found by grid cells.
LEAST_GRID_THRESHOLD = 1 / 64


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= k).drop("__rank")


def top_detections(dets: DataFrame, k: int = 100) -> DataFrame:
    return top_k(dets, ["image_id"], [F.col("score").desc(), F.col("det_id")], k)


def greedy(df: DataFrame, keys: list[str], order: Column, fields: list[str], clashes) -> DataFrame:  # noqa: ANN001
    """Goes through each group in the order of struct ``order`` and keeps what clashes with nothing kept so far.

    ``clashes(kept, candidate)`` gets structs with ``fields``. A group is one row's array: bound it first.
    """
    item = F.struct(order.alias("order"), *fields)
    queue = F.array_sort(F.collect_list(item))
    empty = F.filter("queue", lambda _: F.lit(False))
    kept = F.aggregate("queue", empty, lambda acc, x: F.when(F.exists(acc, lambda k: clashes(k, x)), acc).otherwise(F.array_append(acc, x)))
    return df.groupBy(*keys).agg(queue.alias("queue")).select(*keys, F.inline(F.transform(kept, lambda x: F.struct(*[x[f].alias(f) for f in fields]))))


def suppress_boxes(dets: DataFrame, threshold: float = 0.3, keys: list[str] | None = None, extra_union: float = 0.0) -> DataFrame:
    """Non-maximum suppression in each group: by score, ties by det_id; a box goes if one kept overlaps it by more than ``threshold``.

    ``extra_union`` is added to the union's area (icons use a little). Keys are image and class by default;
    det_id is unique in a group. No box is left out: groups of more than ``MAX_CANDIDATES`` are decided by joins.
    """
    keys = keys or ["image_id", "class_id"]
    fields = ["det_id", "score", "y1", "x1", "y2", "x2"]

    def clashes(k: Column, x: Column) -> Column:
        a, b = g.box_in(k), g.box_in(x)
        if not extra_union:
            return g.iou(a, b) > threshold
        inter = g.intersection(a, b)
        return inter / (g.area(a) + g.area(b) - inter + extra_union) > threshold

    order = F.struct((-F.col("score")).alias("s"), F.col("det_id").alias("d"))
    large = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > MAX_CANDIDATES).select(*keys)
    if large.isEmpty():
        return greedy(dets, keys, order, fields, clashes)
    large = staged(large, "large-groups")
    few = greedy(dets.join(large, keys, "left_anti"), keys, order, fields, clashes)
    many = staged(dets.join(large, keys, "left_semi").select(*keys, *fields), "boxes")
    return few.unionByName(_decided(many, keys, _clashing(many, keys, order, fields, clashes, threshold)))


def _clashing(dets: DataFrame, keys: list[str], order: Column, fields: list[str], clashes, threshold: float) -> DataFrame:  # noqa: ANN001
    """keys, better, worse: the det_ids of every two clashing boxes of a group.

    Sides of boxes that overlap by more than ``threshold`` differ by less than a factor of 1/threshold, so both are in a cell
    of the larger one's level: a box of level n is shorter than 2^(n+1), the side of its cells.
    """
    b = g.box()
    item = F.struct(order.alias("order"), *fields)
    boxes = dets.filter((b.x2 > b.x1) & (b.y2 > b.y1)).withColumn("item", item)
    at: list[str] = []
    same = F.lit(True)
    if threshold >= LEAST_GRID_THRESHOLD:
        up = max(0, math.ceil(math.log2(1 / threshold) + 1e-9))
        for c in ("x", "y"):
            low, high = F.col(f"{c}1"), F.col(f"{c}2")
            boxes = boxes.withColumn(f"own_{c}", F.floor(F.log2(high - low)).cast("int")).withColumn(f"level_{c}", F.explode(F.sequence(F.col(f"own_{c}"), F.col(f"own_{c}") + up)))
            side = F.pow(F.lit(2.0), F.col(f"level_{c}") + 1)
            boxes = boxes.withColumn(f"cell_{c}", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
            at += [f"level_{c}", f"cell_{c}"]
            # each pair counts once: at the larger one's level, in the cell of the corner where the overlap begins
            corner = F.floor(F.greatest(F.col(f"a.{c}1"), F.col(f"b.{c}1")) / side)
            same = same & (F.col(f"level_{c}") == F.greatest(f"own_{c}_a", f"own_{c}_b")) & (F.col(f"cell_{c}") == corner)
    own = [f"own_{c}" for c in ("x", "y") if at]
    half = lambda n: boxes.select(*keys, *at, *[F.col(c).alias(f"{c}_{n}") for c in own], F.col("item").alias(n))
    pairs = half("a").join(half("b"), [*keys, *at]).filter((F.col("a.order") < F.col("b.order")) & same & clashes(F.col("a"), F.col("b")))
    return pairs.select(*keys, F.col("a.det_id").alias("better"), F.col("b.det_id").alias("worse"))


def _decided(dets: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """``dets`` without those that clash with a better one that stays, in rounds: what has no better one undecided stays, its clashes go."""
    left, gone = staged(pairs, "clashes"), []
    while not left.isEmpty():
        of = lambda c: left.select(*keys, F.col(c).alias("det_id"))  # noqa: B023, E731
        stay = of("better").distinct().join(of("worse"), [*keys, "det_id"], "left_anti").withColumnRenamed("det_id", "better")
        out = staged(left.join(stay, [*keys, "better"], "left_semi").select(*keys, F.col("worse").alias("det_id")).distinct(), "suppressed")
        gone.append(out)
        for c in ("better", "worse"):
            left = left.join(out.withColumnRenamed("det_id", c), [*keys, c], "left_anti")
        left = staged(left, "clashes")
    return dets.join(reduce(DataFrame.union, gone), [*keys, "det_id"], "left_anti").select(*dets.columns) if gone else dets


def refine_detections(dets: DataFrame, min_score: float = 0.15, threshold: float = 0.3, k: int = 100) -> DataFrame:
    """Detector output: classes other than background, scores of ``min_score`` or more, suppression by class, top ``k`` of an image."""
    good = dets.filter((F.col("class_id") > 0) & (F.col("score") >= min_score))
    return top_detections(suppress_boxes(good, threshold), k)


def dedup_points(points: DataFrame, radius: float, order: Column) -> DataFrame:
    """Points (image_id, p_id, x, y) of which no earlier kept one is nearer than ``radius``."""
    near = lambda k, p: g.distance(k["x"], k["y"], p["x"], p["y"]) < radius
    return greedy(points, ["image_id"], F.struct(order.alias("o"), F.col("p_id").alias("i")), ["p_id", "x", "y"], near)


def strongest_junctions(points: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` junctions (image_id, x, y, score) of an image with the most skeleton pixels around, ties by x and y, large first."""
    return top_k(points, ["image_id"], [F.col("score").desc(), F.col("x").desc(), F.col("y").desc()], k)


def proposals(anchors: DataFrame, scale: tuple[float, float, float, float] = (0.1, 0.1, 0.2, 0.2), threshold: float = 0.7, k: int = 1000) -> DataFrame:
    """Region proposals from anchors (image_id, det_id, class_id, score, box, dy, dx, dh, dw): best by score, moved, clipped to 0..1, suppressed."""
    best = top_k(anchors, ["image_id"], [F.col("score").desc(), F.col("det_id")], MAX_CANDIDATES)
    moved = g.with_deltas(g.box(), *(F.col(c) * s for c, s in zip(("dy", "dx", "dh", "dw"), scale, strict=True)))
    unit = g.clip(moved, g.Box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    boxes = best.select("image_id", "det_id", "class_id", "score", *[v.alias(c) for c, v in unit._asdict().items()])
    return top_detections(suppress_boxes(boxes, threshold, ["image_id"]), k)
