"""Pixels as rows (image_id, y, x, value): summed areas, window means, thresholds, tile-wise equalisation.

Windows run along one row or one column of a picture, so no group is larger than a side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.operators.masks import dilate_runs, except_runs
from floorlake.staging import broadcast_if_small


def _along(fixed: str, moving: str):  # noqa: ANN202
    return Window.partitionBy("image_id", fixed).orderBy(moving)


def _upto(order):  # noqa: ANN001, ANN202
    return order.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def summed_area(pixels: DataFrame, *values: str) -> DataFrame:
    """``pixels`` (image_id, y, x) with, for each of ``values``, the sum over all pixels up to that row and column as ``<value>_total``.

    Pictures are whole: each row has every column.
    """
    rows = pixels.select("image_id", "y", "x", *values, *[F.sum(v).over(_upto(_along("y", "x"))).alias(f"__{v}") for v in values])
    return rows.select("image_id", "y", "x", *values, *[F.sum(f"__{v}").over(_upto(_along("x", "y"))).alias(f"{v}_total") for v in values])


def box_means(table: DataFrame, boxes: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, box_id, pixels, total, mean of ``value`` in each box (y1, x1, y2, x2, far edges outside) from a table of :func:`summed_area`: four lookups a box.

    Boxes are cut to their picture (``images``: image_id, width, height); of an empty box the mean is null.
    """
    size = images.select("image_id", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))
    cut = lambda c, most: F.least(F.greatest(F.floor(c).cast("long"), F.lit(0)), F.col(most))
    d = boxes.join(broadcast_if_small(size), "image_id").select("image_id", "box_id", cut("y1", "h").alias("y1"), cut("x1", "w").alias("x1"), cut("y2", "h").alias("y2"), cut("x2", "w").alias("x2"))
    pixels = F.greatest(F.col("y2") - F.col("y1"), F.lit(0)) * F.greatest(F.col("x2") - F.col("x1"), F.lit(0))
    corner = lambda y, x, sign: F.struct((F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x"), F.lit(sign).alias("sign"))
    at = d.select("image_id", "box_id", pixels.alias("pixels"), F.inline(F.array(corner("y2", "x2", 1), corner("y1", "x2", -1), corner("y2", "x1", -1), corner("y1", "x1", 1))))
    # Spark takes exploded pixels for as small as what they come from and would broadcast them
    met = at.join(table.select("image_id", "y", "x", "value_total").hint("merge"), ["image_id", "y", "x"], "left")
    out = met.groupBy("image_id", "box_id", "pixels").agg(F.coalesce(F.sum(F.col("sign") * F.col("value_total")), F.lit(0)).alias("total"))
    return out.withColumn("total", F.when(F.col("pixels") > 0, F.col("total")).otherwise(0)).withColumn("mean", F.try_divide("total", "pixels"))


def _pass_sum(df: DataFrame, column: str, fixed: str, moving: str, half: int) -> DataFrame:
    """``column`` as the sum over ``half`` pixels on either side along ``moving``; beyond an edge its pixel repeats."""
    order, line = _along(fixed, moving), Window.partitionBy("image_id", fixed)
    d = df.withColumns({
        "__upto": F.sum(column).over(_upto(order)),
        "__pos": F.row_number().over(order) - 1,
        "__n": F.count(F.lit(1)).over(line),
        "__first": F.first(column).over(_upto(order)),
        "__last": F.last(column).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    d = d.withColumns({"__all": F.sum(column).over(line), "__ahead": F.lead("__upto", half).over(order), "__behind": F.lag("__upto", half + 1).over(order)})
    before, after = F.greatest(F.lit(0), half - F.col("__pos")), F.greatest(F.lit(0), F.col("__pos") + half - F.col("__n") + 1)
    total = F.coalesce("__ahead", "__all") - F.coalesce("__behind", F.lit(0)) + F.col("__first") * before + F.col("__last") * after
    return d.withColumn(column, total).select(df.columns)


def _pass_weighted(df: DataFrame, column: str, fixed: str, moving: str, weights: list[float]) -> DataFrame:
    order, half = _along(fixed, moving), len(weights) // 2
    first, last = F.first(column).over(_upto(order)), F.last(column).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = None
    for k, weight in enumerate(weights):
        d = k - half
        there = F.coalesce(F.lag(column, -d).over(order), first) if d < 0 else F.coalesce(F.lead(column, d).over(order), last)
        total = there * weight if total is None else total + there * weight
    return df.withColumn(column, total)


def window_sums(pixels: DataFrame, size: int = 11) -> DataFrame:
    """image_id, y, x, value, total: the sum over the ``size`` x ``size`` window around each pixel, an odd number; beyond an edge its pixels repeat.

    Two passes of running sums, along rows and along columns, so the work doesn't grow with the window.
    """
    d = pixels.select("image_id", "y", "x", "value", F.col("value").cast("long").alias("total"))
    return _pass_sum(_pass_sum(d, "total", "y", "x", size // 2), "total", "x", "y", size // 2)


def gaussian_weights(size: int = 11) -> list[float]:
    """Normalised weights of a window whose spread follows from its size."""
    spread = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * spread**2)) for k in range(size)]
    return [v / sum(raw) for v in raw]


def gaussian_means(pixels: DataFrame, size: int = 11) -> DataFrame:
    """image_id, y, x, value, mean: weighted means of the window around each pixel, along rows, then along columns; beyond an edge its pixels repeat."""
    d = pixels.select("image_id", "y", "x", "value", F.col("value").cast("double").alias("mean"))
    weights = gaussian_weights(size)
    return _pass_weighted(_pass_weighted(d, "mean", "y", "x", weights), "mean", "x", "y", weights)


def dark_pixels(pixels: DataFrame, size: int = 11, delta: int = 2, gaussian: bool = True) -> DataFrame:
    """The pixels that are darker, by ``delta`` or more, than the rounded mean around them: adaptive threshold, inverted."""
    if gaussian:
        d = gaussian_means(pixels, size)
    else:
        d = window_sums(pixels, size).withColumn("mean", F.col("total") / (size * size))
    return d.filter(F.col("value") <= F.bround("mean") - delta).select("image_id", "y", "x", "value")


def runs_of(pixels: DataFrame) -> DataFrame:
    """image_id, y, x_start, x_end of the rows' neighbouring pixels."""
    islands = pixels.select("image_id", "y", "x", (F.col("x") - F.row_number().over(_along("y", "x"))).alias("island"))
    return islands.groupBy("image_id", "y", "island").agg(F.min("x").alias("x_start"), (F.max("x") + 1).alias("x_end")).drop("island")


def _frame(images: DataFrame) -> DataFrame:
    rows = F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("y")
    return images.filter("width > 0 and height > 0").select("image_id", rows, F.lit(0).cast("long").alias("x_start"), F.col("width").cast("long").alias("x_end"))


def _shifted(runs: DataFrame, dy: int, dx: int) -> DataFrame:
    return runs.withColumns({"y": F.col("y") + dy, "x_start": F.col("x_start") + dx, "x_end": F.col("x_end") + dx})


def grown(runs: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """Each pixel takes the most of the ``size`` x ``size`` pixels that begin size // 2 above and left of it: of an even size masks grow one pixel more down and right."""
    even = 1 - size % 2
    # moved first, so that what a rectangle reaches is cut at the picture's edges once
    return dilate_runs(_shifted(runs, even, even), images, size, size)


def shrunk(runs: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """Each pixel takes the least of the same pixels as in :func:`grown`; what lies outside the picture doesn't count."""
    frame = _frame(images)
    return except_runs(frame, grown(except_runs(frame, runs), images, size))


def office_lines(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """The black runs of an office plan enhanced for detection: dark pixels, opened by 2 x 2, grown by 8 x 8, closed by 7 x 7; all else is white."""
    dark = runs_of(dark_pixels(pixels))
    opened = grown(shrunk(dark, images, 2), images, 2)
    thick = grown(opened, images, 8)
    return shrunk(grown(thick, images, 7), images, 7)


def _with_mirror(pixels: DataFrame, side: str, size: Column, whole: Column) -> DataFrame:
    """Pixels and, beyond the far edge of a picture's ``side`` up to ``whole``, those that mirror them about its last pixel."""
    mirror = 2 * (size - 1) - F.col(side)
    places = F.when((mirror >= size) & (mirror < whole), F.array(F.col(side), mirror)).otherwise(F.array(F.col(side)))
    return pixels.withColumn(side, F.explode(places))


def equalised(pixels: DataFrame, images: DataFrame, clip: float = 3.0, tiles: int = 8) -> DataFrame:
    """image_id, y, x, value: contrast-limited adaptive histogram equalisation of values 0 to 255.

    A picture is ``tiles`` x ``tiles`` tiles; where its sides don't divide it goes on, mirrored. Each tile's histogram
    is clipped at ``clip`` times an even one, what is cut off is spread over all values, and its running sums map
    values. A pixel's value is the bilinear mean of the maps of the four tiles around it.
    """
    size = images.select("image_id", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))
    odd = (F.col("w") % tiles != 0) | (F.col("h") % tiles != 0)
    ext = lambda c: F.when(odd, F.col(c) + tiles - F.col(c) % tiles).otherwise(F.col(c))
    size = size.withColumns({"tw": F.floor(ext("w") / tiles), "th": F.floor(ext("h") / tiles)})
    d = pixels.select("image_id", "y", "x", "value").join(broadcast_if_small(size), "image_id")
    every = _with_mirror(_with_mirror(d, "x", F.col("w"), F.col("tw") * tiles), "y", F.col("h"), F.col("th") * tiles)
    tile = [F.floor(F.col("y") / F.col("th")).alias("ty"), F.floor(F.col("x") / F.col("tw")).alias("tx")]
    counts = every.groupBy("image_id", *tile, (F.col("tw") * F.col("th")).alias("area"), "value").agg(F.count(F.lit(1)).alias("n"))
    limit = F.greatest(F.lit(1).cast("long"), F.floor(clip * F.col("area") / 256))
    order, whole = Window.partitionBy("image_id", "ty", "tx").orderBy("value"), Window.partitionBy("image_id", "ty", "tx")
    kept = F.sum(F.least(F.col("n"), limit)).over(_upto(order)).cast("int")
    steps = counts.select("image_id", "ty", "tx", "area", F.col("value").cast("int").alias("value"), kept.alias("kept"), F.coalesce(F.lead("value").over(order), F.lit(256)).cast("int").alias("next"), F.sum(F.greatest(F.col("n") - limit, F.lit(0))).over(whole).alias("cut"))
    held = steps.groupBy("image_id", "ty", "tx", "area", "cut").agg(F.array_sort(F.collect_list(F.struct("value", "next", "kept"))).alias("s"))
    # running sums stand still between the values of a tile, so all 256 need no rows
    first = F.array_repeat(F.lit(0), F.get("s", F.lit(0))["value"])
    upto = F.flatten(F.concat(F.array(first), F.transform("s", lambda e: F.array_repeat(e["kept"], e["next"] - e["value"]))))
    rest = F.col("cut") % 256
    one = F.struct(upto.alias("upto"), F.floor(F.col("cut") / 256).alias("even"), rest.alias("rest"), F.greatest(F.floor(256 / F.greatest(rest, F.lit(1))), F.lit(1)).alias("step"), (255.0 / F.col("area")).alias("scale"))
    maps = held.select("image_id", F.struct((F.col("ty") * tiles + F.col("tx")).cast("int").alias("tile"), one.alias("map")).alias("m")).groupBy("image_id").agg(F.map_from_entries(F.collect_list("m")).alias("maps"))
    near = lambda c, t: F.col(c) * (1.0 / F.col(t)) - 0.5
    # a picture's maps in one row, tiles x tiles x 256 numbers whatever its size, beside its pixels, which stay where they are
    met = d.withColumns({"fy": near("y", "th"), "fx": near("x", "tw"), "value": F.col("value").cast("int")}).join(maps.withColumnRenamed("image_id", "__image").hint("merge"), F.col("image_id") == F.col("__image"))

    def pair(f: str) -> list[tuple[Column, Column]]:
        low = F.floor(f)
        share = F.col(f) - low
        return [(F.greatest(low, F.lit(0)), 1 - share), (F.least(low + 1, F.lit(tiles - 1)), share)]

    def part(ty: Column, tx: Column, share: Column) -> Column:
        m, v = F.try_element_at("maps", (ty * tiles + tx).cast("int")), F.col("value")
        # what was cut off: the same for each value, and one more for every step-th until none is left
        more = m["even"] * (v + 1) + F.least(F.floor(v / m["step"]) + 1, m["rest"])
        to = F.least(F.bround((F.get(m["upto"], v) + more) * m["scale"]), F.lit(255.0))
        return F.coalesce(F.round(share * to * 1e6).cast("long"), F.lit(0).cast("long"))

    # summed in a whole number of parts, so that the order of the four doesn't matter
    total = sum((part(ty, tx, sy * sx) for ty, sy in pair("fy") for tx, sx in pair("fx")), F.lit(0).cast("long"))
    return met.select("image_id", "y", "x", F.bround(total / 1e6).cast("int").alias("value"))
