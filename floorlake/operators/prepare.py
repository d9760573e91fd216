"""Sizes of detector inputs, object records, weight statistics and checkpoint names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorlake.functions import classify as c
from floorlake.functions import geometry as g
from floorlake.operators.masks import mask_summary
from floorlake.operators.suppress import top_k


def resize_plan(images: DataFrame, min_dim: int = 800, max_dim: int = 1600, min_scale: float = 0.0, mode: str = "square") -> DataFrame:
    """image_id, scale, out_width, out_height and the window (y1, x1, y2, x2) of the picture in the padded input.

    ``square`` pads to max_dim on both sides, ``pad64`` to multiples of 64, ``none`` changes nothing.
    A picture is scaled up to min_dim at its smaller side, never down but for max_dim in ``square``.
    """
    h, w = F.col("height"), F.col("width")
    if mode == "none":
        return images.select("image_id", F.lit(1.0).alias("scale"), w.cast("int").alias("out_width"), h.cast("int").alias("out_height"), F.lit(0).alias("y1"), F.lit(0).alias("x1"), h.cast("int").alias("y2"), w.cast("int").alias("x2"))
    up = F.greatest(F.lit(1.0), F.lit(float(min_dim)) / F.least(h, w), F.lit(float(min_scale)))
    longest = F.greatest(h, w)
    scale = F.when(F.bround(longest * up, 0) > max_dim, F.lit(float(max_dim)) / longest).otherwise(up) if mode == "square" else up
    d = images.withColumn("scale", scale)
    d = d.withColumns({"h": F.bround(h * F.col("scale"), 0).cast("int"), "w": F.bround(w * F.col("scale"), 0).cast("int")})
    padded = (lambda x: F.lit(max_dim)) if mode == "square" else (lambda x: (F.ceil(x / 64) * 64).cast("int"))
    top, left = F.floor((padded(F.col("h")) - F.col("h")) / 2).cast("int"), F.floor((padded(F.col("w")) - F.col("w")) / 2).cast("int")
    return d.select("image_id", "scale", padded(F.col("w")).alias("out_width"), padded(F.col("h")).alias("out_height"), top.alias("y1"), left.alias("x1"), (top + F.col("h")).alias("y2"), (left + F.col("w")).alias("x2"))


def to_original(boxes: DataFrame, plans: DataFrame) -> DataFrame:
    """Boxes of the padded input in pixels of the original picture; those without area there go."""
    d = boxes.join(plans.select("image_id", "scale", F.col("y1").alias("top"), F.col("x1").alias("left")), "image_id")
    back = {k: F.bround((F.col(k) - F.col("top" if k[0] == "y" else "left")) / F.col("scale"), 0) for k in ("y1", "x1", "y2", "x2")}
    return d.withColumns(back).drop("scale", "top", "left").filter(g.area(g.box()) > 0)


def object_records(dets: DataFrame, runs: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, det_id, type, confidence, box, dimensions, center, mask: a nested record a detection; mask is null without pixels."""
    b = g.box()
    m = mask_summary(runs, images).select("image_id", "det_id", F.struct("pixels", "total", "coverage_pct", "y1", "x1", "y2", "x2").alias("mask"))
    return dets.join(m, ["image_id", "det_id"], "left").select(
        "image_id",
        "det_id",
        c.class_name(F.col("class_id")).alias("type"),
        F.col("score").alias("confidence"),
        F.struct("x1", "y1", "x2", "y2").alias("box"),
        F.struct((b.x2 - b.x1).alias("width"), (b.y2 - b.y1).alias("height"), F.coalesce("mask.pixels", F.lit(0)).cast("double").alias("area")).alias("dimensions"),
        F.struct(g.center_x(b).alias("x"), g.center_y(b).alias("y")).alias("center"),
        "mask",
    )


def largest_masks(dets: DataFrame, areas: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` largest masks of each class of an image, ties by det_id."""
    return top_k(dets.join(areas.select("image_id", "det_id", "area"), ["image_id", "det_id"]), ["image_id", "class_id"], [F.col("area").desc(), F.col("det_id")], k)


def label(name: Column, confidence: Column) -> Column:
    return F.format_string("%s (%.2f)", name, confidence)


def first_name(name: Column) -> Column:
    """A label up to its first comma."""
    return F.split_part(name, F.lit(","), F.lit(1))


def weight_stats(weights: DataFrame) -> DataFrame:
    """tensor, low, high, spread, alert of weights (tensor, kind, is_bias, value): dead if all are equal (a convolution's bias may be), overflow beyond 1,000."""
    s = weights.groupBy("tensor").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_pop("value").alias("spread"), F.bool_and((F.col("kind") == "Conv2D") & F.col("is_bias")).alias("may_be_flat"))
    alerts = c.noted(((F.col("low") == F.col("high")) & ~F.col("may_be_flat"), "dead"), (F.greatest(F.abs("low"), F.abs("high")) > 1000, "overflow"))
    return s.select("tensor", "low", "high", "spread", F.array_join(alerts, " ").alias("alert"))


def checkpoint_parts(path: Column) -> Column:
    """Struct (started, epoch) from a path whose folder ends in a time like 20240131T0915 and whose file in _0007.h5; null fields otherwise."""
    time = F.regexp_extract(path, r"(\d{8}T\d{4})[/\\][^/\\]*$", 1)
    epoch = F.regexp_extract(path, r"_(\d{4})\.h5$", 1)
    return F.struct(F.try_to_timestamp(F.nullif(time, F.lit("")), F.lit("yyyyMMdd'T'HHmm")).alias("started"), F.nullif(epoch, F.lit("")).cast("int").alias("epoch"))


def in_region(regions: DataFrame, asked: DataFrame) -> DataFrame:
    """Text regions of a crop (x, y inside it) moved to their image: ``asked`` has the crop's image_id, crop_x1, crop_y1."""
    d = regions.join(asked.select("image_id", "crop_x1", "crop_y1"), "image_id")
    move = {k: F.col(k) + F.col("crop_x1" if k[0] == "x" else "crop_y1") for k in ("x1", "y1", "x2", "y2")}
    return d.withColumns(move).drop("crop_x1", "crop_y1")


def without_zero_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which not all of ``columns`` are 0."""
    some = F.lit(False)
    for c_ in columns:
        some = some | (F.col(c_) != 0)
    return df.filter(some)


def image_meta(image_id: Column, original: Column, shape: Column, window: Column, scale: Column, active: Column) -> Column:
    """One array of doubles: id, original [h, w, c], shape [h, w, c], window [y1, x1, y2, x2], scale, a flag a class."""
    return F.concat(*[x.cast("array<double>") for x in (F.array(image_id), original, shape, window, F.array(scale), active)])


def parsed_meta(meta: Column) -> Column:
    """The parts of :func:`image_meta` as a struct."""
    part = lambda at, n, kind: F.transform(F.slice(meta, at, n), lambda v: v.cast(kind))
    return F.struct(
        F.get(meta, F.lit(0)).cast("long").alias("image_id"),
        part(2, 3, "int").alias("original_image_shape"),
        part(5, 3, "int").alias("image_shape"),
        part(8, 4, "int").alias("window"),
        F.get(meta, F.lit(11)).alias("scale"),
        part(F.lit(13), F.greatest(F.lit(0), F.size(meta) - 12), "int").alias("active_class_ids"),
    )


def detection_json(dets: DataFrame, images: DataFrame, average_door: DataFrame) -> DataFrame:
    """image_id, ``legacy``: Width, Height, averageDoor and, in the order of det_id, classes and points. An image's detections are one row's arrays."""
    item = F.struct("det_id", c.class_name(F.col("class_id")).alias("name"), F.struct("x1", "y1", "x2", "y2").alias("point"))
    own = dets.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    d = images.join(own, "image_id", "left").join(average_door.select("image_id", "average_door"), "image_id", "left")
    items = F.coalesce("items", F.array().cast(own.schema["items"].dataType))
    legacy = F.struct(
        F.col("width").cast("long").alias("Width"),
        F.col("height").cast("long").alias("Height"),
        F.coalesce("average_door", F.lit(0.0)).alias("averageDoor"),
        F.transform(items, lambda x: F.struct(x["name"].alias("name"))).alias("classes"),
        F.transform(items, lambda x: x["point"]).alias("points"),
    )
    return d.select("image_id", legacy.alias("legacy"))


def stamped(df: DataFrame, name: str = "timestamp") -> DataFrame:
    """``df`` with the time of the query, in ISO form, the same in every row."""
    return df.withColumn(name, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def keep_ratio(images: DataFrame, longest: int) -> DataFrame:
    """image_id, scale, out_width, out_height: sides cut down, never up, so that the longer one is ``longest`` at most; parts of a pixel are dropped."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest("width", "height"))
    d = images.select("image_id", "width", "height", scale.alias("scale"))
    return d.select("image_id", "scale", (F.col("width") * F.col("scale")).cast("int").alias("out_width"), (F.col("height") * F.col("scale")).cast("int").alias("out_height"))
