"""Connected regions of masks, from runs: joined inside bands of rows, then across bands, eight neighbours connected.

A region is named by its first run in raster order, as ``y << 32 | x_start``. Work is in groups
bounded by a band's height, or by the fan of bands, times the width; an image may have any number of either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.operators.masks import union_runs
from floorlake.staging import broadcast_if_small, by_groups, group_starts, scratch, staged

#: Rows of a band, whose runs are joined in one group.
BAND = 64
#: Bands, or fans of bands, whose shared rows are joined in one group.
FAN = 16


def least_linked(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers the least one that links (u, v) lead to, in either direction."""
    least = np.arange(n)
    while len(u):
        a, b = least[u], least[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        # a set's least number moves to the least that any of its links has
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least != (further := least[least])).any():
            least = further
    return least


def touching(row: np.ndarray, above: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (upper, lower) of runs that touch, corners too. Runs are sorted by ``row``, then start, and apart in it; ``above``: a run's upper row, or -1."""
    if not len(row):
        return row, row
    left = int(starts.min())
    width = int(ends.max()) - left + 1
    first = np.searchsorted(row * width + (ends - left), above * width + (starts - left), "left")
    last = np.searchsorted(row * width + (starts - left), above * width + (ends - left), "right")
    n = np.where(above < 0, 0, last - first)
    lower = np.repeat(np.arange(len(row)), n)
    return np.repeat(first, n) + np.arange(len(lower)) - np.repeat(np.cumsum(n) - n, n), lower


def _name(y: Column, x: Column) -> Column:
    return F.shiftleft(y.cast("long"), 32) + x


def _band_names(d: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The runs of bands, each with the row below it, and the first run of their region in it."""
    y, starts, ends = d["y"], d["x_start"], d["x_end"]
    rows = group_starts(d, ["image_id", "band", "y"])
    row = np.repeat(np.arange(len(rows)), np.diff(np.append(rows, len(y))))
    beside = np.zeros(len(rows), bool)
    beside[1:] = (np.diff(y[rows]) == 1) & ~np.isin(rows[1:], group_starts(d, ["image_id", "band"]))
    first = least_linked(len(y), *touching(row, np.where(beside[row], row - 1, -1), starts, ends))
    return pa.RecordBatch.from_pydict({c: d[c] for c in ("image_id", "y", "x_start", "x_end", "band")} | {"name": ((y << 32) + starts)[first]})


def _joined(d: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Links (u, v) of fans as (old, new) of every name that isn't its set's least."""
    n = len(d["u"])
    starts = group_starts(d, ["image_id", "fan"])
    group = np.tile(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n))), 2)
    name, image = np.concatenate([d["u"], d["v"]]), np.tile(d["image_id"], 2)
    order = np.lexsort((name, group))
    at = {"group": group[order], "name": name[order]}
    new = group_starts(at, ["group", "name"])
    number = np.empty(2 * n, np.int64)
    number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, 2 * n)))
    old = at["name"][new]
    least = old[least_linked(len(new), number[:n], number[n:])]
    moved = old != least
    return pa.RecordBatch.from_pydict({"image_id": image[order][new][moved], "old": old[moved], "new": least[moved]})


def _renamed(df: DataFrame, moves: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``df`` with names as ``moves`` (image_id, old, new) has them."""
    for c in columns:
        m = moves.withColumnsRenamed({"image_id": "__image", "old": "__old", "new": "__new"})
        df = df.join(m, (F.col("image_id") == F.col("__image")) & (F.col(c) == F.col("__old")), "left").withColumn(c, F.coalesce("__new", c)).drop("__image", "__old", "__new")
    return df


def connected_runs(runs: DataFrame, band: int = BAND, fan: int = FAN) -> DataFrame:
    """image_id, y, x_start, x_end, region: the runs of each image's masks together, and the regions that they form.

    Bands share a row: a run there has a name in both, which links them. Links are joined fan by
    fan, ``fan`` bands at first, then ``fan`` fans and so on, with the names that each level found;
    the number of levels is the logarithm of an image's height. Rows may lie anywhere, below 0 too.
    """
    with scratch(runs.sparkSession):
        own = union_runs(runs)
        at = F.floor(F.col("y") / band).cast("long")
        # the first row of a band belongs to the one above too
        dealt = own.withColumn("band", F.explode(F.when(F.pmod(F.col("y"), F.lit(band)) == 0, F.array(at, at - 1)).otherwise(F.array(at))))
        schema = "image_id long, y long, x_start long, x_end long, band long, name long"
        named = staged(by_groups(dealt, ["image_id", "band"], ["y", "x_start"], lambda d: [_band_names(d)], schema), "bands", keep=True)
        lower = named.filter(F.pmod("y", F.lit(band)) == 0)
        same = ["image_id", "y", "x_start"]
        above = lower.filter(F.col("band") < at).select(*same, "band", F.col("name").alias("u"))
        below = lower.filter(F.col("band") == at).select(*same, F.col("name").alias("v"))
        links = staged(above.join(below, same).filter("u <> v").select("image_id", F.col("band").alias("border"), "u", "v"), "links")
        first, last = links.agg(F.min("border"), F.max("border")).first()
        found = named.filter(F.col("band") == at).select("image_id", "y", "x_start", "x_end", F.col("name").alias("region"))
        width, every = fan, None
        while first is not None:
            one = F.floor((F.col("border") - first) / width)
            # a fan's borders but its last lie inside it
            inside = F.pmod(F.col("border") - first + 1, F.lit(width)) != 0 if width <= last - first else F.lit(True)
            moves = by_groups(links.filter(inside).select("image_id", one.alias("fan"), "u", "v"), ["image_id", "fan"], [], lambda d: [_joined(d)], "image_id long, old long, new long")
            moves = staged(moves, "moves")
            # what moved before moves on; a name that has moved moves no more
            every = moves if every is None else _renamed(every, broadcast_if_small(moves), "new").union(moves)
            if width > last - first:
                break
            links = staged(_renamed(links.filter(~inside), broadcast_if_small(moves), "u", "v").filter("u <> v"), "links")
            width *= fan
        if every is not None:
            found = _renamed(found, broadcast_if_small(staged(every, "names", keep=True)), "region")
    return found


def region_sizes(connected: DataFrame) -> DataFrame:
    """image_id, region, pixels and box y1, x1, y2, x2 of each region, far edges outside."""
    return connected.groupBy("image_id", "region").agg(
        F.sum(F.col("x_end") - F.col("x_start")).alias("pixels"), F.min("y").alias("y1"), F.min("x_start").alias("x1"), (F.max("y") + 1).alias("y2"), F.max("x_end").alias("x2")
    )


def large_regions(connected: DataFrame, least: int) -> DataFrame:
    """The runs of regions with ``least`` pixels or more."""
    kept = region_sizes(connected).filter(F.col("pixels") >= least).select("image_id", "region")
    return connected.join(kept, ["image_id", "region"], "left_semi").select(connected.columns)


def largest_region(connected: DataFrame) -> DataFrame:
    """The runs of each image's region with most pixels, of equal ones the first in raster order."""
    best = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("pixels"), "region"))
    kept = region_sizes(connected).withColumn("place", best).filter("place = 1").select("image_id", "region")
    return connected.join(kept, ["image_id", "region"], "left_semi").select(connected.columns)


def strong_regions(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """The runs of the weak masks' regions that hold a pixel of a strong one: hysteresis with two thresholds."""
    connected = connected_runs(weak)
    a, b = connected.alias("a"), union_runs(strong).alias("b")
    meet = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.x_start") < F.col("b.x_end")) & (F.col("b.x_start") < F.col("a.x_end"))
    kept = a.join(b, meet).select("a.image_id", "a.region").distinct()
    return connected.join(kept, ["image_id", "region"], "left_semi").select(connected.columns)
