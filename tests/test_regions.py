"""Connected regions from runs against a plain flood fill."""

import random

import pytest

from floorlake import schemas
from floorlake.operators import regions


def runs_of(rows):
    """(image_id, y, x_start, x_end) as masks of one detection each."""
    return [(i, k, 1, y, a, b) for k, (i, y, a, b) in enumerate(rows)]


def flooded(pixels):
    """first pixel -> pixels of each region, eight neighbours connected."""
    left, out = set(pixels), {}
    for p in sorted(pixels):
        if p not in left:
            continue
        left.discard(p)
        todo, own = [p], {p}
        while todo:
            y, x = todo.pop()
            for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if q in left:
                    left.discard(q)
                    own.add(q)
                    todo.append(q)
        out[p] = own
    return out


def painted(rows):
    """region's first pixel -> pixels, by image."""
    out = {}
    for r in rows:
        p = (r["region"] >> 32, r["region"] - (r["region"] >> 32 << 32))
        out.setdefault(r["image_id"], {}).setdefault(p, set()).update((r["y"], x) for x in range(r["x_start"], r["x_end"]))
    return out


@pytest.mark.parametrize(("band", "fan"), [(64, 16), (1, 2), (3, 2), (2, 3)])
def test_regions_against_flood_fill(spark, band, fan):
    r = random.Random(band)
    pixels = {(i, y, x) for i, share in ((1, 0.3), (2, 0.45), (3, 0.7)) for y in range(-9, 24) for x in range(20) if r.random() < share}
    rows = runs_of([(i, y, x, x + 1) for i, y, x in pixels] + [(4, 7, 3, 3)])
    got = regions.connected_runs(spark.createDataFrame(rows, schemas.MASK_RUNS), band, fan)
    want = {i: flooded([(y, x) for j, y, x in pixels if j == i]) for i in (1, 2, 3)}
    assert painted(got.collect()) == want
    sizes = {(s["image_id"], s["region"] >> 32): 0 for s in regions.region_sizes(got).collect()}
    assert len(sizes) <= sum(map(len, want.values()))


def serpent(height, width):
    """One line that turns at every second row, from the top to the bottom: as long as a region gets."""
    rows = []
    for y in range(height):
        rows.append((1, y, 0, width) if y % 2 == 0 else (1, y, width - 1, width) if y % 4 == 1 else (1, y, 0, 1))
    return rows


def test_tall_pictures(spark):
    one = regions.connected_runs(spark.createDataFrame(runs_of(serpent(2048, 40)), schemas.MASK_RUNS), band=16, fan=4)
    assert [tuple(r) for r in one.select("region").distinct().collect()] == [(0,)]
    # two columns that meet in the last row only, and a third that doesn't
    rows = [(1, y, x, x + 1) for y in range(2048) for x in (0, 6, 20)] + [(1, 2048, 0, 7)]
    sizes = regions.region_sizes(regions.connected_runs(spark.createDataFrame(runs_of(rows), schemas.MASK_RUNS))).collect()
    assert sorted((r["region"], r["pixels"], r["y1"], r["x1"], r["y2"], r["x2"]) for r in sizes) == [(0, 4103, 0, 0, 2049, 7), (20, 2048, 0, 20, 2048, 21)]


def test_a_picture_of_100_000_runs(spark):
    # a comb: rows of single pixels, joined by every fourth column; 1,000 of them by the last row
    runs = spark.range(100_000).selectExpr("1L image_id", "id det_id", "1 class_id", "id div 1000 y", "id % 1000 * 4 x_start", "id % 1000 * 4 + 1 x_end")
    apart = regions.region_sizes(regions.connected_runs(runs)).collect()
    assert len(apart) == 1000 and {r["pixels"] for r in apart} == {100}
    row = spark.createDataFrame([(1, 1, 1, 100, 0, 4000)], schemas.MASK_RUNS)
    assert [r["pixels"] for r in regions.region_sizes(regions.connected_runs(runs.union(row))).collect()] == [104_000]


def test_largest_large_and_strong(spark):
    rows = [(1, 0, 0, 3), (1, 5, 0, 3), (1, 9, 9, 11), (2, 1, 1, 2), (3, 0, 0, 0)]
    c = regions.connected_runs(spark.createDataFrame(runs_of(rows), schemas.MASK_RUNS))
    show = lambda d: sorted((r["image_id"], r["y"], r["x_start"], r["x_end"]) for r in d.collect())
    assert show(regions.largest_region(c)) == [(1, 0, 0, 3), (2, 1, 1, 2)]  # of equal ones the first
    assert show(regions.large_regions(c, 2)) == [(1, 0, 0, 3), (1, 5, 0, 3), (1, 9, 9, 11)]
    assert show(regions.large_regions(c, 4)) == []
    strong = spark.createDataFrame(runs_of([(1, 5, 2, 6), (1, 9, 11, 12), (2, 1, 0, 9)]), schemas.MASK_RUNS)
    assert show(regions.strong_regions(spark.createDataFrame(runs_of(rows), schemas.MASK_RUNS), strong)) == [(1, 5, 0, 3), (2, 1, 1, 2)]
    assert regions.connected_runs(spark.createDataFrame([], schemas.MASK_RUNS)).count() == 0
