"""Decoded pixels as one array a picture: row by row, the channels of a pixel side by side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean of each channel, red, green, blue.
MEAN_PIXEL = (123.7, 116.8, 103.9)


def to_rgb(pixels: Column, channels: Column) -> Column:
    """Three channels: a grey picture's value for each, the first three of four; null for any other number."""
    grey = F.flatten(F.transform(pixels, lambda x: F.array(x, x, x)))
    cut = F.filter(pixels, lambda _, i: i % 4 < 3)
    return F.when(channels == 3, pixels).when(channels == 1, grey).when(channels == 4, cut)


def _moved(pixels: Column, mean: tuple[float, ...], sign: int) -> Column:
    means = F.array(*[F.lit(sign * m) for m in mean])
    return F.transform(pixels, lambda x, i: x + F.get(means, i % len(mean)))


def molded(pixels: Column, mean: tuple[float, ...] = MEAN_PIXEL) -> Column:
    """Pixels less the mean of their channel."""
    return _moved(pixels.cast("array<double>"), mean, -1)


def unmolded(pixels: Column, mean: tuple[float, ...] = MEAN_PIXEL) -> Column:
    """Back to whole values; fractions are cut off."""
    return F.transform(_moved(pixels, mean, 1), lambda x: F.round(x, 6).cast("int"))
