"""Images in, detections out: files, admission, and any detector as a source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.schemas import DETECTIONS, MASK_RUNS, TEXT_REGIONS

# Sides of an image, in pixels, and the answer codes of its admission.
MIN_SIDE, MAX_SIDE = 100, 2048
BAD_REQUEST, UNAVAILABLE, ACCEPTED = 400, 503, 200


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content of the files under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def image_size(content: Column) -> Column:
    """Struct (width, height) from the head of a PNG file, null for other content."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def admitted(images: DataFrame, ready: bool = True) -> DataFrame:
    """Images (width, height, mm_per_px) with status, new_width, new_height, resize_factor, resized and scale.

    A side below MIN_SIDE, before or after, is refused. A larger side than MAX_SIDE shrinks to it,
    fractions of a pixel cut off, and the scale is multiplied by the factor. Without a detector
    (``ready`` false) all images wait. A null width or height is refused.
    """
    w, h = F.col("width"), F.col("height")
    factor = F.when(F.greatest(w, h) > MAX_SIDE, F.lit(float(MAX_SIDE)) / F.greatest(w, h)).otherwise(F.lit(1.0))
    d = images.withColumn("resize_factor", factor)
    size = lambda c: F.floor(F.col(c) * F.col("resize_factor") + 1e-9).cast("int")
    d = d.withColumns({"new_width": size("width"), "new_height": size("height")})
    fits = F.coalesce((F.least("width", "height") >= MIN_SIDE) & (F.least("new_width", "new_height") >= MIN_SIDE), F.lit(False))
    status = F.lit(UNAVAILABLE) if not ready else F.when(fits, ACCEPTED).otherwise(BAD_REQUEST)
    return d.withColumns({"status": status, "resized": F.col("resize_factor") < 1, "scale": F.coalesce("mm_per_px", F.lit(1.0)) * F.col("resize_factor")})


def is_office_plan(edges: DataFrame, limit: float = 7.0) -> DataFrame:
    """image_id, is_office of edge pixels (image_id, y, x) with the image's width and height: the larger mean number a row or column is below ``limit``."""
    n = edges.groupBy("image_id", "width", "height").agg(F.count(F.lit(1)).alias("n"))
    return n.select("image_id", (F.greatest(F.col("n") / F.col("width"), F.col("n") / F.col("height")) < limit).alias("is_office"))


Model = Callable[[bytes], pd.DataFrame]


def _applied(images: DataFrame, load: Callable[[], Model], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()  # once a task
        for b in batches:
            for image_id, content in zip(b["image_id"], b["content"], strict=True):
                yield model(content).assign(image_id=image_id)[[c.split()[0] for c in schema.split(", ")]]

    return images.select("image_id", "content").mapInPandas(run, schema)


def detect(images: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """Detections from a model that turns an image's bytes into rows of det_id, class_id, score and box."""
    return _applied(images, load, DETECTIONS)


def detect_masks(images: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """Mask runs from a model that turns an image's bytes into rows of det_id, class_id, y, x_start, x_end."""
    return _applied(images, load, MASK_RUNS)


def recognise(images: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """Text regions from a model that turns an image's bytes into rows of region_id, text, box, confidence and method."""
    return _applied(images, load, TEXT_REGIONS)


def registered(images: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, classes) of training sources with internal_id from 0 and the name ``source.id``; class 0 is the background of every source."""
    number = lambda c: (F.row_number().over(Window.partitionBy("source").orderBy(c)) - 1).cast("long")
    name = lambda c: F.concat_ws(".", "source", F.col(c).cast("string"))
    background = classes.select("source").distinct().select("source", F.lit(0).cast("long").alias("class_id"), F.lit("BG").alias("name"))
    every = background.unionByName(classes.select("source", F.col("class_id").cast("long").alias("class_id"), "name").filter("class_id <> 0"))
    return (
        images.withColumns({"internal_id": number("source_image_id"), "image_key": name("source_image_id")}),
        every.withColumns({"internal_id": number("class_id"), "class_key": name("class_id")}),
    )
