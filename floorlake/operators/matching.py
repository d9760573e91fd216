"""Templates found in pictures: normalised correlation in bands of lines, with places ruled out by coarse sums before their pixels are looked at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.operators.suppress import suppress_boxes
from floorlake.staging import broadcast_if_small, small_batches

#: A template is cut into so many blocks each way for the bound.
BLOCKS = 4
#: Room for rounding in the bound.
SLIP = 1e-6
#: Hits that stay of a template in a picture.
MOST_HITS = 200
THRESHOLD = 0.85
#: Lines of a picture in which the places of a band begin; a band goes on as far down as templates reach.
BAND = 64
#: Pixels that are looked at together.
CELLS = 1 << 20
PLACES = "image_id long, template_id long, y long, x long, h long, w long, energy double, window double, product double"


def _cuts(side: int, blocks: int) -> list[int]:
    n = min(side, blocks)
    return [side * k // n for k in range(n + 1)]


def template_sizes(templates: DataFrame) -> DataFrame:
    """h, w, ids, cells: the templates (template_id, y, x, value) of each size, their values line by line, one after the other."""
    value = F.struct("y", "x", F.col("value").cast("double").alias("v"))
    each = templates.groupBy("template_id").agg((F.max("y") + 1).cast("long").alias("h"), (F.max("x") + 1).cast("long").alias("w"), F.array_sort(F.collect_list(value))["v"].alias("cells"))
    sized = each.groupBy("h", "w").agg(F.array_sort(F.collect_list(F.struct("template_id", "cells"))).alias("t"))
    return sized.select("h", "w", F.col("t.template_id").alias("ids"), F.flatten("t.cells").alias("cells"))


def picture_bands(pixels: DataFrame, reach: DataFrame, height: int = BAND) -> DataFrame:
    """image_id, band, lines: the lines of values from ``height`` * band on, ``height`` and as many more as ``reach`` (one row, reach) says.

    Pictures are whole: each row has every column. Spark takes exploded pixels for as small as what
    they come from and would broadcast them.
    """
    lines = pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.col("value").cast("double").alias("v"))))["v"].alias("line"))
    bands = lines.select("image_id", F.floor(F.col("y") / height).alias("band")).distinct().crossJoin(F.broadcast(reach))
    within = (F.col("y") >= F.col("band") * height) & (F.col("y") < (F.col("band") + 1) * height + F.col("reach"))
    met = bands.join(lines.withColumnRenamed("image_id", "__image").hint("merge"), (F.col("image_id") == F.col("__image")) & within)
    return met.groupBy("image_id", "band").agg(F.array_sort(F.collect_list(F.struct("y", "line")))["line"].alias("lines"))


class _Size:
    """Templates of one size, less their means, and their blocks."""

    def __init__(self, h: int, w: int, ids: np.ndarray, cells: np.ndarray, blocks: int) -> None:
        self.h, self.w, self.ids = h, w, ids
        cells = cells.reshape(len(ids), h, w)
        self.own = cells - cells.mean((1, 2), keepdims=True)
        self.energy = (self.own * self.own).sum((1, 2))
        self.ys, self.xs = _cuts(h, blocks), _cuts(w, blocks)
        self.areas = np.outer(np.diff(self.ys), np.diff(self.xs)).ravel().astype(float)
        self.parts = np.add.reduceat(np.add.reduceat(self.own, self.ys[:-1], 1), self.xs[:-1], 2).reshape(len(ids), -1)
        self.rest = np.sqrt(np.maximum(self.energy - (self.parts * self.parts / self.areas).sum(1), 0.0))

    def places(self, picture: np.ndarray, threshold: float, height: int) -> Iterator[tuple[np.ndarray, ...]]:
        """template's number, y, x, window, product of the places that may match, of those that begin in the first ``height`` lines."""
        h, w = self.h, self.w
        down, right = min(height, len(picture) - h + 1), picture.shape[1] - w + 1
        if down < 1 or right < 1:
            return
        totals = np.zeros((2, len(picture) + 1, picture.shape[1] + 1))
        totals[:, 1:, 1:] = np.stack([picture, picture * picture]).cumsum(1).cumsum(2)

        def sums(table: np.ndarray, y1: int, y2: int, x1: int, x2: int) -> np.ndarray:
            at = lambda y, x: table[y : y + down, x : x + right]
            return (at(y2, x2) - at(y1, x2) - at(y2, x1) + at(y1, x1)).ravel()

        blocks = np.stack([sums(totals[0], a, b, c, d) for a, b in zip(self.ys, self.ys[1:]) for c, d in zip(self.xs, self.xs[1:])])
        average = blocks.sum(0) / (h * w)
        window = sums(totals[1], 0, h, 0, w) - average * average * (h * w)
        blocks -= self.areas[:, None] * average
        left = np.sqrt(np.maximum(window - (blocks * blocks / self.areas[:, None]).sum(0), 0.0))
        # the product of block means is known, that of the rests is at most the product of their lengths
        bound = (self.parts / self.areas) @ blocks + self.rest[:, None] * left
        able = (window > 1e-9) & (self.energy[:, None] > 1e-9)
        kind, place = np.nonzero(able & (bound >= (threshold - SLIP) * np.sqrt(self.energy[:, None] * np.maximum(window, 0.0))))
        y, x = np.divmod(place, right)
        around = np.lib.stride_tricks.sliding_window_view(picture, (h, w))
        many = max(1, CELLS // (h * w))
        for k in range(0, len(kind), many):
            t, a, b = kind[k : k + many], y[k : k + many], x[k : k + many]
            yield t, a, b, window[place[k : k + many]], np.einsum("kij,kij->k", around[a, b], self.own[t])


def possible_places(pixels: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, height: int = BAND) -> DataFrame:
    """image_id, template_id, y, x, h, w, energy, window, product of places whose correlation may reach ``threshold``.

    Both window and template are split into block means and what is left of them. The means'
    product is known from summed areas; the rests' is at most the product of their lengths. Places
    where both together stay below the threshold are dropped; no place that reaches it is.
    ``energy`` and ``window``: the template's and the window's energy about their means, ``product`` that of both.
    """
    small_batches(pixels.sparkSession)
    sizes = template_sizes(templates)
    bands = picture_bands(pixels, sizes.agg((F.max("h") - 1).alias("reach")), height)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], _Size] = {}
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                image, band, h, w = (column[c][r].as_py() for c in ("image_id", "band", "h", "w"))
                if (h, w) not in known:
                    known[h, w] = _Size(h, w, *(column[c][r].values.to_numpy(zero_copy_only=False) for c in ("ids", "cells")), blocks)
                size, lines = known[h, w], column["lines"][r].values
                for t, y, x, window, product in size.places(lines.flatten().to_numpy(zero_copy_only=False).reshape(len(lines), -1), threshold, height):
                    alike = [np.full(len(t), v) for v in (h, w)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (np.full(len(t), image), size.ids[t], y + band * height, x, *alike, size.energy[t], window, product)],
                        names=["image_id", "template_id", "y", "x", "h", "w", "energy", "window", "product"],
                    )

    return bands.crossJoin(broadcast_if_small(sizes)).mapInArrow(run, PLACES)


def template_hits(pixels: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, most: int = MOST_HITS, height: int = BAND) -> DataFrame:
    """image_id, template_id, y, x, h, w, score: places where the correlation of picture and template, both less their means, is ``threshold`` or more.

    Of more than ``most`` of a template in a picture the best stay, of equal ones the first. Flat windows and flat templates match nowhere.
    """
    scored = possible_places(pixels, templates, threshold, height=height).withColumn("score", F.col("product") / F.sqrt(F.col("energy") * F.col("window")))
    place = F.row_number().over(Window.partitionBy("image_id", "template_id").orderBy(F.desc(F.round("score", 9)), "y", "x"))
    return scored.filter(F.col("score") >= threshold).withColumn("__place", place).filter(F.col("__place") <= most).select("image_id", "template_id", "y", "x", "h", "w", "score")


def icon_boxes(hits: DataFrame, scale: Column | None = None, smallest: float = 10.0, largest: float = 150.0, threshold: float = 0.3) -> DataFrame:
    """image_id, det_id, class_id, score, y1, x1, y2, x2: hits of icons (with ``class_id``) as boxes of the whole picture, of sizes that icons have, less those that a better one of their class covers.

    ``scale`` is the picture's over its whole one's.
    """
    s = F.lit(1.0) if scale is None else scale
    box = {"y1": F.col("y") / s, "x1": F.col("x") / s, "y2": (F.col("y") + F.col("h")) / s, "x2": (F.col("x") + F.col("w")) / s}
    d = hits.withColumns(box).filter((F.col("x2") - F.col("x1")).between(smallest, largest) & (F.col("y2") - F.col("y1")).between(smallest, largest))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("class_id", "template_id", "y", "x"))
    return suppress_boxes(d.withColumn("det_id", number.cast("long")).select("image_id", "det_id", "class_id", "score", "y1", "x1", "y2", "x2"), threshold, extra_union=1e-6)
