"""Pixel operators against plain loops."""

import math
import random

import pytest

from floorlake import picture_queries, queries, schemas  # noqa: F401  (registers its queries)
from floorlake.operators import pictures

PIXELS = "image_id long, y long, x long, value long"


def picture(seed, height, width, image_id=1):
    r = random.Random(seed)
    return {(image_id, y, x): r.choice([0, 40, 90, 200, 255, r.randint(0, 255)]) for y in range(height) for x in range(width)}


def frame(spark, *parts):
    return spark.createDataFrame([(*k, v) for p in parts for k, v in p.items()], PIXELS)


def images(spark, *sizes):
    return spark.createDataFrame([(i, float(w), float(h), 1.0) for i, h, w in sizes], schemas.IMAGES)


def held(p, i, y, x, h, w):
    return p[(i, min(max(y, 0), h - 1), min(max(x, 0), w - 1))]


@pytest.mark.parametrize(("height", "width"), [(1, 1), (3, 2), (9, 17), (14, 12)])
def test_window_sums_and_thresholds(spark, height, width):
    p = picture(3, height, width)
    d = frame(spark, p)
    got = {(r["image_id"], r["y"], r["x"]): r["total"] for r in pictures.window_sums(d, 11).collect()}
    want = {(i, y, x): sum(held(p, i, y + a, x + b, height, width) for a in range(-5, 6) for b in range(-5, 6)) for i, y, x in p}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.5 + 1e-5 for k in want)
    dark = {(r["image_id"], r["y"], r["x"]) for r in pictures.dark_pixels(d, gaussian=False).collect()}
    assert dark == {k for k, v in p.items() if v <= round(want[k] / 121) - 2}
    raw = [math.exp(-((k - 5) ** 2) / 8) for k in range(11)]
    g = [v / sum(raw) for v in raw]
    means = {(r["image_id"], r["y"], r["x"]): r["mean"] for r in pictures.gaussian_means(d).collect()}
    assert all(abs(means[i, y, x] - sum(g[a] * g[b] * held(p, i, y + a - 5, x + b - 5, height, width) for a in range(11) for b in range(11))) < 1e-9 for i, y, x in p)


def test_box_means(spark):
    p, q = picture(5, 7, 9), picture(6, 4, 4, 2)
    table = pictures.summed_area(frame(spark, p, q), "value")
    boxes = [(1, 1, 0.0, 0.0, 7.0, 9.0), (1, 2, 2.9, 3.0, 5.0, 4.0), (1, 3, -5.0, -1.0, 50.0, 2.0), (1, 4, 3.0, 3.0, 3.0, 9.0), (2, 5, 1.0, 1.0, 3.0, 3.0), (1, 6, 8.0, 1.0, 9.0, 3.0)]
    d = spark.createDataFrame(boxes, "image_id long, box_id long, y1 double, x1 double, y2 double, x2 double")
    got = {r["box_id"]: (r["pixels"], r["total"], r["mean"]) for r in pictures.box_means(table, d, images(spark, (1, 7, 9), (2, 4, 4))).collect()}
    for i, b, y1, x1, y2, x2 in boxes:
        own = [v for (j, y, x), v in (p if i == 1 else q).items() if j == i and math.floor(y1) <= y < y2 and math.floor(x1) <= x < x2]
        assert got[b] == (len(own), sum(own), sum(own) / len(own) if own else None), b


def taken(mask, size, h, w, most):
    """Each pixel takes the most, or least, of the pixels from size // 2 before it on."""
    out = set()
    for y in range(h):
        for x in range(w):
            near = [(y + a, x + b) in mask for a in range(-(size // 2), size - size // 2) for b in range(-(size // 2), size - size // 2) if 0 <= y + a < h and 0 <= x + b < w]
            if (any if most else all)(near):
                out.add((y, x))
    return out


def painted(d):
    return {(r["y"], x) for r in d.collect() for x in range(r["x_start"], r["x_end"])}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8])
def test_grown_and_shrunk(spark, size):
    h, w = 13, 17
    mask = {(y, x) for (_, y, x), v in picture(size, h, w).items() if v < 100}
    runs = pictures.runs_of(spark.createDataFrame([(1, y, x, 0) for y, x in mask], PIXELS))
    assert painted(runs) == mask
    sized = images(spark, (1, h, w))
    assert painted(pictures.grown(runs, sized, size)) == taken(mask, size, h, w, True)
    assert painted(pictures.shrunk(runs, sized, size)) == taken(mask, size, h, w, False)


def test_office_lines(spark):
    h, w = 30, 34
    p = {k: 250 - (150 if 10 <= k[1] < 13 else 0) - v // 20 for k, v in picture(1, h, w).items()}
    dark = {(r["y"], r["x"]) for r in pictures.dark_pixels(frame(spark, p)).collect()}
    want = taken(taken(dark, 2, h, w, False), 2, h, w, True)
    want = taken(taken(taken(want, 8, h, w, True), 7, h, w, True), 7, h, w, False)
    assert want and painted(pictures.office_lines(frame(spark, p), images(spark, (1, h, w)))) == want


def plain_equalised(p, h, w, clip, tiles):
    H, W = (h, w) if h % tiles == 0 and w % tiles == 0 else (h + tiles - h % tiles, w + tiles - w % tiles)
    th, tw = H // tiles, W // tiles
    at = lambda y, x: p[1, y if y < h else 2 * (h - 1) - y, x if x < w else 2 * (w - 1) - x]
    maps = {}
    for ty in range(tiles):
        for tx in range(tiles):
            bins = [0] * 256
            for y in range(ty * th, ty * th + th):
                for x in range(tx * tw, tx * tw + tw):
                    bins[at(y, x)] += 1
            limit = max(int(clip * th * tw / 256), 1)
            cut = sum(max(n - limit, 0) for n in bins)
            bins = [min(n, limit) + cut // 256 for n in bins]
            left = cut % 256
            v, step = 0, max(256 // left, 1) if left else 1
            while v < 256 and left > 0:
                bins[v] += 1
                v, left = v + step, left - 1
            total, maps[ty, tx] = 0, []
            for n in bins:
                total += n
                maps[ty, tx].append(min(round(total * (255 / (th * tw))), 255))
    out = {}
    for (_, y, x), v in p.items():
        fy, fx = y / th - 0.5, x / tw - 0.5
        y0, x0 = math.floor(fy), math.floor(fx)
        a, b = fy - y0, fx - x0
        y1, y2, x1, x2 = max(y0, 0), min(y0 + 1, tiles - 1), max(x0, 0), min(x0 + 1, tiles - 1)
        out[1, y, x] = (maps[y1, x1][v] * (1 - b) + maps[y1, x2][v] * b) * (1 - a) + (maps[y2, x1][v] * (1 - b) + maps[y2, x2][v] * b) * a
    return out


@pytest.mark.parametrize(("height", "width"), [(16, 16), (19, 24), (30, 21)])
def test_equalised(spark, height, width):
    p = picture(9, height, width)
    want = plain_equalised(p, height, width, 3.0, 4)
    got = {(r["image_id"], r["y"], r["x"]): r["value"] for r in pictures.equalised(frame(spark, p), images(spark, (1, height, width)), tiles=4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.5 + 1e-5 for k in want)
    assert pictures.equalised(frame(spark, p).limit(0), images(spark, (1, height, width))).count() == 0


def test_equalising_shuffles_no_pixels_and_makes_no_rows_of_maps(spark, tmp_path):
    rows = [(e, e % 3, "view") for e in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    text = queries.QUERIES["equalised_pixels"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    # boxes and images are shuffled, by image; the only explodes are those that make pixels and mirror them
    assert not [line for line in text if "Exchange hashpartitioning" in line and (" y#" in line or " value#" in line)]
    assert not [line for line in text if "posexplode" in line]


@pytest.mark.parametrize(("height", "width"), [(8, 8), (16, 9), (40, 11)])
def test_equalised_in_eight_tiles(spark, height, width):
    p = picture(4, height, width)
    want = plain_equalised(p, height, width, 3.0, 8)
    got = {(r["image_id"], r["y"], r["x"]): r["value"] for r in pictures.equalised(frame(spark, p), images(spark, (1, height, width))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.5 + 1e-5 for k in want)
