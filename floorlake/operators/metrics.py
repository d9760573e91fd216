"""Aggregates over the detections, walls and doors of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.functions import classify as c
from floorlake.functions import geometry as g
from floorlake.operators.pairs import overlap_counts
from floorlake.schemas import PLURALS

NO_WALLS = "No walls detected for analysis"


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def class_sums() -> dict[str, Column]:
    """Aggregates, a struct for each class that :func:`class_summary` lists, under its name."""
    area = g.area(g.box())

    def of(k: int) -> Column:
        own = lambda x: F.when(F.col("class_id") == k, x)
        score = own(F.col("score"))
        return F.struct(
            F.count(score).alias("count"), or_zero(F.avg(score)).alias("avg_confidence"), or_zero(F.avg(own(area))).alias("avg_size"), F.min(score).alias("min_confidence"), F.max(score).alias("max_confidence")
        )

    return {name: of(k) for k, name in PLURALS.items()}


def overall(dets: DataFrame, images: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """image_id, n, avg_confidence, high, medium, low, coverage_pct for each image, those without detections included.

    Coverage sums up box areas, so it can exceed 100. ``more`` are further aggregates of the same pass.
    """
    more = more or {}
    band = c.confidence_band(F.col("score"))
    sums = dets.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg"), F.sum(g.area(g.box())).alias("area"), *[F.count_if(band == b).alias(b) for b in ("high", "medium", "low")], *[v.alias(k) for k, v in more.items()]
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    share = F.try_divide(F.col("area"), F.col("width") * F.col("height")) * 100
    return images.join(sums, "image_id", "left").select("image_id", zero("n"), or_zero(F.col("avg")).alias("avg_confidence"), zero("high"), zero("medium"), zero("low"), or_zero(share).alias("coverage_pct"), *more)


def class_summary(dets: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, object, count, avg_confidence, avg_size, min_confidence, max_confidence for walls, windows and doors of every image.

    A class that an image doesn't have counts 0, with null confidences at both ends.
    """
    made = dets.groupBy("image_id", "class_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg"), F.avg(g.area(g.box())).alias("size"), F.min("score").alias("low"), F.max("score").alias("high")
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("class_id"), F.lit(v).alias("object")) for k, v in PLURALS.items()]))
    every = images.select("image_id", kinds.alias("k")).select("image_id", "k.*")
    return every.join(made, ["image_id", "class_id"], "left").select(
        "image_id", "object", F.coalesce("n", F.lit(0)).alias("count"), or_zero(F.col("avg")).alias("avg_confidence"), or_zero(F.col("size")).alias("avg_size"), F.col("low").alias("min_confidence"), F.col("high").alias("max_confidence")
    )


def size_anomalies(dets: DataFrame) -> DataFrame:
    """image_id, detection_id (place among the image's walls, from 0), area, median_area, reason of walls far larger or smaller than the median."""
    walls = dets.filter("class_id = 1").select("image_id", "det_id", g.area(g.box()).alias("area"))
    medians = walls.groupBy("image_id").agg(F.median("area").alias("median_area"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")) - 1
    placed = walls.withColumn("detection_id", place.cast("long")).join(medians, "image_id")
    large, small = F.col("area") > F.col("median_area") * 5, F.col("area") < F.col("median_area") * 0.2
    return placed.filter(large | small).select("image_id", "detection_id", "area", "median_area", F.when(large, "unusually_large").otherwise("unusually_small").alias("reason"))


def reliability(n: Column, avg: Column, high: Column, overlaps: Column) -> Column:
    """Up to 40 for confidence, 30 for the share of sure detections, 20 less 5 an overlap, and 10 for a usual number of detections."""
    count_score = F.when(n.between(1, 50), F.lit(10.0)).otherwise(F.greatest(F.lit(0.0), 10.0 - F.abs(n - 25)))
    return F.least(F.lit(40.0), avg * 40) + high / F.greatest(F.lit(1), n) * 30 + F.greatest(F.lit(0.0), 20.0 - 5 * overlaps) + count_score


def recommendations(n: Column, avg: Column, low: Column, overlaps: Column, anomalies: Column, score: Column) -> Column:
    said = lambda head, k, tail: F.concat(F.lit(head), k.cast("string"), F.lit(tail))
    return c.noted(
        (avg < 0.6, "Low average confidence detected. Consider using higher quality images or retraining the model."),
        (low > n * 0.3, "Many low-confidence detections found. Review these detections manually."),
        (overlaps > 0, said("Found ", overlaps, " overlapping detections. Check for duplicate objects.")),
        (anomalies > 0, said("Found ", anomalies, " size anomalies. Review unusual object sizes.")),
        (score > 80, "High reliability score! Results appear very accurate."),
        ((score > 60) & (score <= 80), "Good reliability score. Results are generally trustworthy."),
        (score <= 60, "Low reliability score. Carefully review all detections."),
    )


def accuracy(dets: DataFrame, images: DataFrame, more: dict[str, Column] | None = None, anomalies: Column | None = None) -> DataFrame:
    """All figures of the accuracy report, a row an image, before they are nested.

    ``more`` are further aggregates over an image's detections, ``anomalies`` one over its size anomalies.
    """
    listed = [] if anomalies is None else [anomalies]
    odd = size_anomalies(dets).groupBy("image_id").agg(F.count(F.lit(1)).alias("odd"), *listed)
    joined = overall(dets, images, more).join(overlap_counts(dets), "image_id", "left").join(odd, "image_id", "left")
    filled = joined.withColumns({"overlaps": F.coalesce("overlaps", F.lit(0)), "anomalies": F.coalesce("odd", F.lit(0))}).drop("odd")
    scored = filled.withColumn("reliability_score", reliability(F.col("n"), F.col("avg_confidence"), F.col("high"), F.col("overlaps")))
    names = ("n", "avg_confidence", "low", "overlaps", "anomalies", "reliability_score")
    return scored.withColumn("recommendations", recommendations(*map(F.col, names)))


def histogram(df: DataFrame, column: str, out: str) -> DataFrame:
    """image_id and a map from each value of ``column`` to its count, keys sorted."""
    counts = df.groupBy("image_id", column).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(column).alias("key"), F.col("n").alias("value"))))
    return counts.groupBy("image_id").agg(F.map_from_entries(entries).alias(out))


def exterior_flags(walls: DataFrame, images: DataFrame, margin: float = 0.03, long_wall: float = 150.0, span: float = 0.3) -> DataFrame:
    """Walls (image_id, wall_seq, x1, y1, x2, y2, length in mm, start_junction, end_junction) with exterior_reasons and is_exterior."""
    mm = images.select("image_id", (F.col("width") * F.col("mm_per_px")).alias("w"), (F.col("height") * F.col("mm_per_px")).alias("h"))
    d = walls.join(mm, "image_id")
    left, right = F.col("x1") <= F.col("w") * margin, F.col("x2") >= F.col("w") - F.col("w") * margin
    top, bottom = F.col("y1") <= F.col("h") * margin, F.col("y2") >= F.col("h") - F.col("h") * margin
    near = left | right | top | bottom
    reasons = c.noted(
        (left, "left_boundary"),
        (right, "right_boundary"),
        (top, "top_boundary"),
        (bottom, "bottom_boundary"),
        (~near & F.col("start_junction").isNull() & F.col("end_junction").isNull(), "unconnected"),
        (near & (F.col("length") > long_wall), "long_boundary_wall"),
        ((left | right) & (F.abs(F.col("y2") - F.col("y1")) > F.col("h") * span), "spans_vertical_edge"),
        ((top | bottom) & (F.abs(F.col("x2") - F.col("x1")) > F.col("w") * span), "spans_horizontal_edge"),
    )
    flagged = d.withColumn("exterior_reasons", reasons)
    return flagged.withColumn("is_exterior", F.size("exterior_reasons") > 0).drop("w", "h")


def perimeter(exterior: DataFrame, by_boundary: bool = False) -> DataFrame:
    """Perimeter figures of exterior walls. The area takes the two longest walls for sides if there are four walls or more.

    Boundary coverage counts reasons named ``left`` and so on, which no rule gives; ``by_boundary`` counts ``left_boundary`` instead.
    """
    longest = F.slice(F.sort_array(F.collect_list("length"), asc=False), 1, 2)
    suffix = "_boundary" if by_boundary else ""
    sides = [F.count_if(F.array_contains("exterior_reasons", f"{s}{suffix}")).alias(s) for s in ("left", "right", "top", "bottom")]
    sums = exterior.groupBy("image_id").agg(F.sum("length").alias("total"), F.count(F.lit(1)).alias("n"), longest.alias("l"), *sides)
    area = F.when(F.col("n") >= 4, F.get("l", F.lit(0)) * F.get("l", F.lit(1))).otherwise(F.lit(0.0))
    return sums.select(
        "image_id", F.col("total").alias("total_perimeter_length"), F.col("n").alias("exterior_wall_count"), area.alias("perimeter_area"), (F.col("total") / F.col("n")).alias("average_exterior_wall_length"), "left", "right", "top", "bottom"
    )


def wall_insights(walls: DataFrame, junctions: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, insights from walls (thickness, length, orientation, junctions at both ends) and junctions (wall_count)."""
    means = walls.groupBy("image_id").agg(F.avg("length").alias("mean"))
    long_wall = F.col("length") > F.col("mean") * 1.5
    o = F.col("orientation")
    w = walls.join(means, "image_id").groupBy("image_id").agg(
        # rounded, so that the order of rows doesn't decide on which side of 2 a spread of 2 lies
        F.round(F.stddev_pop(F.when(F.col("thickness") > 0, F.col("thickness"))), 9).alias("spread"),
        F.count_if(long_wall).alias("long"),
        F.count_if(F.col("start_junction").isNull() & F.col("end_junction").isNull()).alias("alone"),
        F.count_if((o <= 30) | (o >= 150)).alias("h"),
        F.count_if(o.between(60, 120)).alias("v"),
    )
    busy = junctions.filter("wall_count > 3").groupBy("image_id").agg(F.count(F.lit(1)).alias("busy"))
    j = images.select("image_id").join(w, "image_id", "left").join(busy, "image_id", "left")
    said = lambda k, tail: F.concat(F.lit("Found "), F.col(k).cast("string"), F.lit(tail))
    notes = c.noted(
        (F.col("spread") < 2.0, "Consistent wall thickness throughout floor plan"),
        (F.col("spread") >= 2.0, "Variable wall thickness detected - may indicate different wall types"),
        (F.col("long") > 0, said("long", " notably long walls - potential load-bearing structures")),
        (F.col("busy") > 0, said("busy", " complex junctions with 4+ walls")),
        (F.col("alone") > 0, said("alone", " isolated wall segments")),
        (F.col("h") > F.col("v") * 1.5, "Predominantly horizontal wall layout"),
        ((F.col("v") > F.col("h") * 1.5) & ~(F.col("h") > F.col("v") * 1.5), "Predominantly vertical wall layout"),
        (~(F.col("h") > F.col("v") * 1.5) & ~(F.col("v") > F.col("h") * 1.5), "Balanced horizontal and vertical wall layout"),
    )
    return j.select("image_id", F.when(F.col("h").isNull(), F.array(F.lit(NO_WALLS))).otherwise(notes).alias("insights"))


def door_insights(doors: DataFrame, close: DataFrame, images: DataFrame, margin: float = 0.1) -> DataFrame:
    """image_id, insights on the layout of an image's doors: close pairs, orientation, those near the boundary."""
    x, y = g.center_x(g.box()), g.center_y(g.box())
    edge = lambda v, size: (v < F.col(size) * margin) | (v > F.col(size) * (1 - margin))
    kind = c.door_orientation(g.box(), F.col("width"), F.col("height"))["door_type"]
    d = doors.join(images, "image_id").groupBy("image_id").agg(
        F.count_if(kind == "horizontal").alias("h"), F.count_if(kind == "vertical").alias("v"), F.count_if(edge(x, "width") | edge(y, "height")).alias("edge")
    )
    j = images.select("image_id").join(d, "image_id", "left").join(close, "image_id", "left")
    notes = c.noted(
        (F.col("close_pairs") > 0, F.concat(F.lit("Found "), F.col("close_pairs").cast("string"), F.lit(" pairs of doors in close proximity"))),
        (F.col("h") > F.col("v"), "Predominantly horizontal door layout"),
        (F.col("v") > F.col("h"), "Predominantly vertical door layout"),
        (F.col("v") == F.col("h"), "Mixed door orientation layout"),
        (F.col("edge") > 0, F.concat(F.col("edge").cast("string"), F.lit(" doors positioned near floor plan boundaries"))),
    )
    return j.select("image_id", F.when(F.col("h").isNull(), F.array(F.lit("No doors detected for layout analysis"))).otherwise(notes).alias("insights"))
