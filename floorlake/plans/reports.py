"""Accuracy report and floor-plan report, one nested row an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.functions import classify as c
from floorlake.functions import geometry as g
from floorlake.functions import units
from floorlake.operators import metrics, pairs, paths, raster
from floorlake.staging import staged


def accuracy_report(dets: DataFrame, images: DataFrame) -> DataFrame:
    """image_id with overall, quality, objects, spatial, reliability_score and recommendations."""
    sums = metrics.class_sums()
    none = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("avg_confidence"), F.lit(0.0).alias("avg_size"), *[F.lit(None).cast("double").alias(f"{x}_confidence") for x in ("min", "max")])
    odd = F.array_sort(F.collect_list(F.struct("detection_id", "area", "median_area", "reason"))).alias("size_anomalies")
    d = metrics.accuracy(dets, images, sums, odd)
    d = d.withColumn("objects", F.create_map(*[x for name in sorted(sums) for x in (F.lit(name), F.coalesce(name, none))]))
    return d.select(
        "image_id",
        F.struct(F.col("n").alias("total_detections"), F.col("coverage_pct").alias("image_coverage"), F.col("avg_confidence").alias("average_confidence")).alias("overall"),
        F.struct(*[F.col(x).alias(f"{x}_confidence") for x in ("high", "medium", "low")]).alias("quality"),
        "objects",
        F.struct(F.col("overlaps").alias("bbox_overlaps"), F.coalesce("size_anomalies", F.array()).alias("size_anomalies")).alias("spatial"),
        "reliability_score",
        "recommendations",
    )


def door_records(dets: DataFrame, images: DataFrame) -> DataFrame:
    """A row a door: place, size, orientation, classes and notes. Ids count from 1 in an image, by det_id."""
    d = dets.filter("class_id = 3").join(images, "image_id")
    b = g.box()
    w, h, s = b.x2 - b.x1, b.y2 - b.y1, F.col("mm_per_px")
    d = d.withColumn("o", c.door_orientation(b, F.col("width"), F.col("height")))
    vertical = F.col("o.door_type") == "vertical"
    return d.select(
        "image_id",
        F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")).cast("long").alias("door_id"),
        "det_id",
        (g.center_x(b) * s).alias("center_x_mm"),
        (g.center_y(b) * s).alias("center_y_mm"),
        c.percent(g.center_x(b), F.col("width")).alias("from_left"),
        c.percent(g.center_y(b), F.col("height")).alias("from_top"),
        (F.when(vertical, w).otherwise(h) * s).alias("width_mm"),
        (F.when(vertical, h).otherwise(w) * s).alias("height_mm"),
        F.when(h > 0, w / h).otherwise(F.lit(0.0)).alias("aspect_ratio"),
        F.when(w < h, "interior").otherwise("entrance").alias("door_use"),
        F.col("o.door_type").alias("door_type"),
        F.col("o.estimated_swing").alias("estimated_swing"),
        F.col("o.hinge_side").alias("hinge_side"),
        c.door_size(w, h).alias("size_category"),
        c.door_access(w).alias("accessibility"),
        c.door_notes(w, h, F.col("o.estimated_swing"), F.col("o.confidence")).alias("notes"),
    )


def window_records(dets: DataFrame, images: DataFrame) -> DataFrame:
    """A row a window: place, size, classes and notes. Ids count from 1 in an image, by det_id."""
    d = dets.filter("class_id = 2").join(images, "image_id")
    b = g.box()
    w, h, s = b.x2 - b.x1, b.y2 - b.y1, F.col("mm_per_px")
    return d.select(
        "image_id",
        F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")).cast("long").alias("window_id"),
        "det_id",
        (g.center_x(b) * s).alias("center_x_mm"),
        (g.center_y(b) * s).alias("center_y_mm"),
        c.percent(g.center_x(b), F.col("width")).alias("from_left"),
        c.percent(g.center_y(b), F.col("height")).alias("from_top"),
        (F.greatest(w, h) * s).alias("width_mm"),
        c.window_type(w, h).alias("window_type"),
        c.window_size(w, h).alias("size_category"),
        c.window_glazing(w, h).alias("glazing_type"),
        c.window_notes(w, h).alias("notes"),
    )


def connected_walls(walls: DataFrame, junctions: DataFrame, images: DataFrame) -> DataFrame:
    """Walls in mm with their junctions and whether they are exterior."""
    linked = paths.wall_measures(walls, images).join(pairs.wall_connections(walls, junctions), ["image_id", "wall_seq"])
    return metrics.exterior_flags(linked, images)


def floorplan_summary(dets: DataFrame, walls: DataFrame, junctions: DataFrame, spaces: DataFrame, images: DataFrame) -> DataFrame:
    """image_id with counts of walls, doors, windows, junctions and spaces, wall length and thickness, exterior share and mean confidence."""
    n = F.count(F.lit(1))
    w = connected_walls(walls, junctions, images).groupBy("image_id").agg(
        n.alias("walls"), F.sum("length").alias("wall_length"), F.avg("thickness").alias("wall_thickness"), F.count_if("is_exterior").alias("exterior_walls")
    )
    d = dets.groupBy("image_id").agg(F.count_if(F.col("class_id") == 3).alias("doors"), F.count_if(F.col("class_id") == 2).alias("windows"), F.avg("score").alias("confidence"))
    j = junctions.groupBy("image_id").agg(n.alias("junctions"))
    s = spaces.groupBy("image_id").agg(n.alias("spaces"), F.avg("confidence").alias("space_confidence"), F.array_sort(F.collect_set("method")).alias("methods"))
    out = images.select("image_id")
    for part in (w, d, j, s):
        out = out.join(part, "image_id", "left")
    zero = {k: F.coalesce(k, F.lit(0)) for k in ("walls", "exterior_walls", "doors", "windows", "junctions", "spaces")}
    zero |= {k: metrics.or_zero(F.col(k)) for k in ("wall_length", "wall_thickness", "confidence", "space_confidence")}
    return out.withColumns(zero | {"methods": F.coalesce("methods", F.array().cast("array<string>"))})


def floorplan_report(dets: DataFrame, walls: DataFrame, junctions: DataFrame, spaces: DataFrame, images: DataFrame) -> DataFrame:
    """The summary with the records of an image's walls, doors, windows and spaces as arrays. An image bounds each of them."""
    out = floorplan_summary(dets, walls, junctions, spaces, images)
    parts = {
        "wall_records": (connected_walls(walls, junctions, images), "wall_seq"),
        "door_records": (door_records(dets, images), "door_id"),
        "window_records": (window_records(dets, images), "window_id"),
        "space_records": (spaces, "space_id"),
    }
    for name, (rows, order) in parts.items():
        fields = [order, *[k for k in rows.columns if k not in ("image_id", order)]]
        out = out.join(rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)), "image_id", "left")
    return out


def with_fallback_junctions(junctions: DataFrame, more: DataFrame, least: int = 4) -> DataFrame:
    """Junctions, and those of ``more`` after them for images that have fewer than ``least``; numbers go on."""
    n = junctions.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    few = more.join(n, "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < least)
    return junctions.select("image_id", "j_seq", "x", "y").unionByName(few.select("image_id", (F.col("j_seq") + F.col("n")).cast("int").alias("j_seq"), "x", "y"))


def wall_parameters(runs: DataFrame, images: DataFrame, prefix: str = "", cleaned: bool = True) -> DataFrame:
    """From wall masks to walls: image_id, wall_seq, wall_id, and in mm centerline, length, thickness and box, then orientation_degrees, start_junction, end_junction, segment_area.

    ``prefix`` names the region that the masks are of.
    """
    parts, scale = staged(raster.wall_parts(runs, images, cleaned), "walls"), F.col("mm_per_px")
    table = raster.wall_rows(parts)
    ends = pairs.wall_connections(table, raster.joint_rows(parts)).select("image_id", "wall_seq", "start_junction", "end_junction")
    steps = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: g.distance(a["x"], a["y"], b["x"], b["y"]))
    length = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
    d = table.join(ends, ["image_id", "wall_seq"]).join(images.select("image_id", "mm_per_px"), "image_id")
    return d.select(
        "image_id",
        "wall_seq",
        F.concat(F.lit(f"{prefix}W"), F.col("wall_seq").cast("string")).alias("wall_id"),
        units.line_to_mm(F.transform("line", lambda p: F.array(p["x"], p["y"])), scale).alias("centerline"),
        units.px_to_mm(length, scale).alias("length"),
        units.thickness_to_mm(F.col("thickness"), scale).alias("thickness"),
        units.box_to_mm(F.col("box"), scale).alias("box"),
        F.when(F.size("line") < 2, F.lit(0.0)).otherwise(paths.fold_angle(F.col("ey") - F.col("sy"), F.col("ex") - F.col("sx"))).alias("orientation_degrees"),
        "start_junction",
        "end_junction",
        F.col("area").alias("segment_area"),
    )
