"""Wall segments of masks: regions come from :mod:`floorlake.operators.regions`; what one region needs, thinning, cutting and walking, is numpy here.

Regions are painted side by side on a :class:`Sheet` and solved together. A sheet takes ``SHEET`` pixels, or as much memory as the box of one region that is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.operators.regions import connected_runs, large_regions, least_linked, touching
from floorlake.staging import by_groups, group_starts

NEIGHBOURS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
MIN_COMPONENT, MIN_REGION, MIN_PIECE, MIN_SEGMENT = 50, 20, 3, 5
#: Pixels of a sheet on which regions are solved together.
SHEET = 1 << 18


class Sheet:
    """Masks painted side by side, ``pad`` empty pixels around each: what reaches no farther than that, or only to the nearest pixel outside a mask, is the same as on its own.

    ``full`` are the pixels, ``owner`` a pixel's mask, number k of ``marks``; ``boxes`` hold a mask's (top, left, bottom, right) on the sheet with its padding, ``moved`` what to add to go back to its own rows and columns.
    """

    def __init__(self, marks: np.ndarray, sizes: np.ndarray, corners: np.ndarray) -> None:
        order = np.argsort(-sizes[:, 0], kind="stable")
        width = max(int(sizes[:, 1].max()), int(sizes.prod(axis=1).sum() ** 0.5) + 1)
        top = left = below = 0
        self.marks, self.boxes = marks, np.zeros((len(marks), 4), np.int64)
        for k in order.tolist():
            h, w = sizes[k].tolist()
            if left + w > width:
                top, left = below, 0
            self.boxes[k] = top, left, top + h, left + w
            left, below = left + w, max(below, top + h)
        self.full, self.owner = np.zeros((below, width), bool), np.zeros((below, width), np.int32)
        for k, (t, l, b, r) in enumerate(self.boxes.tolist()):
            self.owner[t:b, l:r] = k
        self.moved = corners - self.boxes[:, :2]

    def own(self, pixels: np.ndarray, k: int) -> np.ndarray:
        t, l, b, r = self.boxes[k].tolist()
        return pixels[t:b, l:r]


def sheets(d: dict[str, np.ndarray], keys: list[str], pad: int) -> Iterator[tuple[Sheet, np.ndarray]]:
    """Sheets of the masks of sorted runs, one mask a group of ``keys``, with the place of each mask's first run; masks without pixels are on none."""
    starts = group_starts(d, keys)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(d["y"]))))
    some = d["x_end"] > d["x_start"]
    y, a, b, group = d["y"][some], d["x_start"][some], d["x_end"][some], group[some]
    if not len(y):
        return
    first = group_starts({"g": group}, ["g"])
    last = np.append(first[1:], len(y)) - 1
    top, bottom, left, right = y[first], np.maximum.reduceat(y, first) + 1, np.minimum.reduceat(a, first), np.maximum.reduceat(b, first)
    sizes = np.stack([bottom - top, right - left], 1) + 2 * pad
    page, filled = np.zeros(len(first), np.int64), 0
    for k, area in enumerate(sizes.prod(axis=1).tolist()):
        filled += area
        new = k and filled > SHEET
        page[k] = page[k - 1] + new if k else 0
        filled = area if new else filled
    for cut in np.split(np.arange(len(first)), np.flatnonzero(np.diff(page)) + 1):
        sheet = Sheet(cut, sizes[cut], np.stack([top[cut], left[cut]], 1) - pad)
        i, j = int(first[cut[0]]), int(last[cut[-1]]) + 1
        which = np.repeat(np.arange(len(cut)), last[cut] - first[cut] + 1)
        rows = y[i:j] - sheet.moved[which, 0]
        for r, p, q in zip(rows.tolist(), (a[i:j] - sheet.moved[which, 1]).tolist(), (b[i:j] - sheet.moved[which, 1]).tolist()):
            sheet.full[r, p:q] = True
        yield sheet, starts[group[first[cut]]]


def shifted(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """out[y, x] = mask[y + dy, x + dx], False beyond the edge."""
    out = np.zeros_like(mask)
    h, w = mask.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = mask[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 in raster order of first pixels, eight neighbours connected: touching runs of neighbouring rows are united."""
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]
    first = least_linked(len(rows), *touching(rows, rows - 1, starts, ends))
    label = np.zeros(mask.shape, np.int64)
    label[mask] = np.repeat(np.unique(first, return_inverse=True)[1] + 1, ends - starts)
    return label


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    label = components(mask)
    return (np.bincount(label.ravel()) >= least)[label] & mask


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The component with most pixels, of equal ones the first; an empty mask as it is."""
    size = np.bincount(components(mask).ravel())
    size[0] = 0
    return (components(mask) == size.argmax()) if size.any() else mask


def _disk(mask: np.ndarray, radius: int, grow: bool) -> np.ndarray:
    seen = mask if grow else ~mask
    out, (h, w) = seen.copy(), mask.shape
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if 0 < dy * dy + dx * dx <= radius * radius:
                out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] |= seen[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out if grow else ~out


def improved(mask: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """Closed by a disk of radius 2 and opened by one of 1; a mask itself if that loses a fifth of it. ``owner``: which mask a pixel is of, where there are several."""
    closed = _disk(_disk(mask, 2, True), 2, False)
    opened = _disk(_disk(closed, 1, False), 1, True)
    if owner is None:
        return opened if opened.sum() >= 0.8 * mask.sum() else mask
    n = int(owner.max()) + 1
    enough = np.bincount(owner[opened], minlength=n) >= 0.8 * np.bincount(owner[mask], minlength=n)
    return np.where(enough[owner], opened, mask)


def distances(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest one outside the mask, exact: columns first, then rows.

    Along a row only neighbours nearer than the largest distance so far can lower one, so the work
    is the mask's area times its walls' half thickness.
    """
    up = np.where(mask, np.inf, 0.0)
    for rows in (range(1, len(up)), range(len(up) - 2, -1, -1)):
        for y in rows:
            beside = y - 1 if rows.step == 1 else y + 1
            up[y] = np.minimum(up[y], up[beside] + 1)
    squares = up**2
    best = squares.copy()
    for d in range(1, up.shape[1]):
        if d * d >= best.max(initial=0):
            break
        best[:, d:] = np.minimum(best[:, d:], squares[:, :-d] + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], squares[:, d:] + d * d)
    return np.sqrt(best)


def depths(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """:func:`distances` at the flat places ``at`` of pixels of a mask whose edge rows and columns are empty."""
    h, w = mask.shape
    y = np.arange(h, dtype=np.int64)[:, None]
    above = y - np.maximum.accumulate(np.where(mask, -1, y), axis=0)
    below = np.minimum.accumulate(np.where(mask, h, y)[::-1], axis=0)[::-1] - y
    squares = (np.minimum(above, below) ** 2).ravel()
    best, left = squares[at], np.arange(len(at))
    d = 1
    while len(left := left[best[left] > d * d]):
        # a row's ends are empty, so none looks beyond them
        best[left] = np.minimum(best[left], np.minimum(squares[np.maximum(at[left] - d, 0)], squares[np.minimum(at[left] + d, len(squares) - 1)]) + d * d)
        d += 1
    return np.sqrt(best)


def _thinned_codes(turn: int) -> np.ndarray:
    """Of each set of eight neighbours (bit k: the k-th of ``NEIGHBOURS``) whether the pixel amid goes."""
    p = (np.arange(256)[None, :] >> np.arange(8)[:, None] & 1).astype(bool)
    n, rises = p.sum(axis=0), sum((~p[k] & p[(k + 1) % 8]).astype(np.int8) for k in range(8))
    a, b = ((p[0], p[2], p[4]), (p[2], p[4], p[6])) if turn == 0 else ((p[0], p[2], p[6]), (p[0], p[4], p[6]))
    return (n >= 2) & (n <= 6) & (rises == 1) & ~(a[0] & a[1] & a[2]) & ~(b[0] & b[1] & b[2])


THINNED = [_thinned_codes(turn) for turn in (0, 1)]
BITS = np.array([bin(code).count("1") for code in range(256)])


def _codes(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The neighbours of flat places as bits, of pixels (0 or 1) of a sheet this wide."""
    out = flat[at + (NEIGHBOURS[0][0] * width + NEIGHBOURS[0][1])]
    for k, (dy, dx) in enumerate(NEIGHBOURS[1:], 1):
        out = out | flat[at + (dy * width + dx)] << k
    return out


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thinned to one pixel by the two-pass rule on the eight neighbours."""
    padded = np.pad(mask, 1).astype(np.uint8)
    flat, width = padded.ravel(), padded.shape[1]
    at = np.flatnonzero(flat)
    while True:
        before = len(at)
        for goes in THINNED:
            gone = goes[_codes(flat, at, width)]
            flat[at[gone]] = 0
            at = at[~gone]
        if len(at) == before:
            return padded[1:-1, 1:-1].astype(bool)


def _walk(degree: dict[int, int], width: int) -> list[int]:
    """:func:`walk` over flat places, with the number of neighbours of each; takes those it visits out of ``degree``."""
    steps = [dy * width + dx for dy, dx in NEIGHBOURS]
    at = min((p for p, n in degree.items() if n == 1), default=None)
    if at is None:
        at = min(degree, key=lambda p: (degree[p], p))
    out = [at]
    del degree[at]
    while further := [(degree[q], q) for step in steps if (q := at + step) in degree]:
        at = min(further)[1]
        out.append(at)
        del degree[at]
    return out


def walk(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Skeleton pixels in the order of a walk: from the first end to the unvisited neighbour with fewest neighbours, until there is none.

    The first end is the least (y, x) of the pixels with one neighbour, else of those with fewest.
    """
    if not points:
        return []
    left = min(x for _, x in points) - 1
    width = max(x for _, x in points) - left + 2
    places = {y * width + x - left: (y, x) for y, x in points}
    steps = [dy * width + dx for dy, dx in NEIGHBOURS]
    return [places[p] for p in _walk({p: sum(p + step in places for step in steps) for p in places}, width)]


def nearest_first(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Points ordered by always going to the nearest one left."""
    left, out = list(points[1:]), list(points[:1])
    while left:
        y, x = out[-1]
        k = min(range(len(left)), key=lambda i: (left[i][0] - y) ** 2 + (left[i][1] - x) ** 2)
        out.append(left.pop(k))
    return out


def nearest_inside(mask: np.ndarray, y: int, x: int, radius: int) -> tuple[int, int] | None:
    """The pixel itself, or the first one of the mask on the rings around it."""
    h, w = mask.shape
    for r in range(radius + 1):
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                if max(abs(dy), abs(dx)) == r and 0 <= y + dy < h and 0 <= x + dx < w and mask[y + dy, x + dx]:
                    return y + dy, x + dx
    return None


def _cross(mask: np.ndarray, grow: bool) -> np.ndarray:
    """Grown or shrunk by the four direct neighbours; what lies beyond the edge is empty."""
    sides = [mask, *(shifted(mask, dy, dx) for dy, dx in NEIGHBOURS[::2])]
    return np.logical_or.reduce(sides) if grow else np.logical_and.reduce(sides)


def branch_points(bones: np.ndarray, top: int = 0, left: int = 0, size: tuple[int, int] | None = None, grid: int = 5, reach: int = 2, border: int = 20, radius: float = 30.0, most: int = 20, cleaned: bool = True) -> list[tuple[int, int]]:
    """(y, x) of grid points of the image where the skeleton, opened by a cross, goes on in three directions or more at a distance.

    Opening leaves little of lines one pixel wide, so few crossings count; ``cleaned=False`` takes the
    skeleton as it is. Points come row by row; of near ones the first stays. Of more than ``most`` the best-filled
    stay, best first. ``bones`` starts at ``top``, ``left`` of an image of ``size`` (height,
    width); an unknown size has no lower or right border.
    """
    opened = _cross(_cross(bones, False), True) if cleaned else bones
    found: list[tuple[int, int]] = []
    ys, xs = np.nonzero(opened)
    ay, ax = ys + top, xs + left
    inner = (ay > border) & (ax > border) & (ay % grid == 0) & (ax % grid == 0)
    if size is not None:
        inner &= (ay < size[0] - border) & (ax < size[1] - border)
    if not inner.any():
        return found
    ys, xs, wide = ys[inner], xs[inner], max(3, reach)
    padded = np.pad(opened, wide)
    many = sum(padded[ys + wide + reach * dy, xs + wide + reach * dx].astype(np.int8) for dy, dx in NEIGHBOURS) >= 3
    for y, x in zip(ys[many].tolist(), xs[many].tolist(), strict=True):
        if all((y - a) ** 2 + (x - b) ** 2 >= radius**2 for a, b in found):
            found.append((y, x))
    near = lambda p: int(padded[p[0] + wide - 3 : p[0] + wide + 4, p[1] + wide - 3 : p[1] + wide + 4].sum())
    return found if len(found) <= most else sorted(found, key=lambda p: (near(p), p[1], p[0]), reverse=True)[:most]


def meeting_points(bones: np.ndarray, radius: float = 15.0) -> list[tuple[int, int]]:
    """(y, x), two pixels off the edge or more, around which the eight neighbours form three pieces or more; row by row, of near ones the first."""
    around = [shifted(bones, dy, dx) for dy, dx in NEIGHBOURS]
    # corners touch the sides beside them, and sides each other across a corner: pieces are the gaps of the ring, sides joined over an empty corner
    closed = [around[k] | (around[k - 1] & around[(k + 1) % 8]) if k % 2 else around[k] for k in range(8)]
    pieces = sum((closed[k] & ~closed[k - 1]).astype(np.int8) for k in range(8))
    found: list[tuple[int, int]] = []
    inner = np.zeros_like(bones)
    inner[2:-2, 2:-2] = True
    for y, x in zip(*(v.tolist() for v in np.nonzero(bones & inner & (pieces >= 3))), strict=True):
        if all((y - a) ** 2 + (x - b) ** 2 >= radius**2 for a, b in found):
            found.append((y, x))
    return found


def repaired(line: list[tuple[float, float]], mask: np.ndarray, snap: int = 3) -> list[tuple[float, float]]:
    """A line of (x, y) with the points outside the mask moved to its first pixel within ``snap`` rings, or left out."""
    h, w = mask.shape
    out: list[tuple[float, float]] = []
    for x, y in line:
        if 0 <= y < h and 0 <= x < w and mask[int(y), int(x)]:
            out.append((x, y))
        elif q := nearest_inside(mask, int(y), int(x), snap):
            out.append((float(q[1]), float(q[0])))
    return out


def validated(line: list[tuple[float, float]], mask: np.ndarray) -> list[tuple[float, float]]:
    """:func:`repaired`, or the line as it was if fewer than two points are left."""
    kept = repaired(line, mask) if len(line) > 1 else line
    return kept if len(kept) > 1 else line


POINT = "struct<x: double, y: double>"
SEGMENT = f"struct<line: array<{POINT}>, profile: array<double>, box: struct<x1: double, y1: double, x2: double, y2: double>, area: double>"


def _solved(sheet: Sheet, limits: list[tuple[int, int] | None], cleaned: bool) -> tuple[list[tuple[int, list[int], int, list[int]]], list[list[tuple[int, int]]]]:
    """Wall segments of a sheet as (mask, flat places in walking order, number of pixels, all flat places), a mask's one after the other, and each mask's junctions (y, x) in its own rows and columns.

    Masks are thinned, cut at their branch points and walked. ``limits``: each mask's image's (height, width), if known.
    """
    full, owner, width = sheet.full, sheet.owner, sheet.full.shape[1]
    enough = np.bincount(owner[full], minlength=len(sheet.marks)) >= MIN_REGION
    cut = drop_small(skeleton(improved(full, owner)) & full & enough[owner], MIN_PIECE)
    bones, joints = cut.copy(), []
    for k, (moved, limit) in enumerate(zip(sheet.moved.tolist(), limits, strict=True)):
        t, l, _, _ = sheet.boxes[k].tolist()
        top, left = moved[0] + t, moved[1] + l
        found = branch_points(sheet.own(bones, k), top, left, limit, cleaned=cleaned)
        for y, x in found:
            cut[t + y - 1 : t + y + 2, l + x - 1 : l + x + 2] = False
        joints.append([(y + top, x + left) for y, x in found])
    pieces, flat = components(cut).ravel(), cut.ravel().astype(np.uint8)
    at = np.flatnonzero(flat)
    at = at[np.lexsort((at, pieces[at]))]
    degree = BITS[_codes(flat, at, width)].tolist()
    of = owner.ravel()
    starts = np.append(np.flatnonzero(np.diff(pieces[at], prepend=0)), len(at)).tolist()
    at = at.tolist()
    segments = [(int(of[at[i]]), _walk(dict(zip(at[i:j], degree[i:j])), width), j - i, at[i:j]) for i, j in zip(starts, starts[1:]) if j - i > MIN_SEGMENT]
    return sorted(segments, key=lambda s: s[0]), joints


def _listed(values: pa.Array, counts: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values)


def _points(x: np.ndarray, y: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], ["x", "y"])


def _sheet_parts(sheet: Sheet, images: np.ndarray, regions: np.ndarray, limits: list[tuple[int, int] | None], cleaned: bool) -> pa.RecordBatch:
    """A sheet's regions as rows of :func:`wall_parts`."""
    segments, joints = _solved(sheet, limits, cleaned)
    width, count = sheet.full.shape[1], [len(line) for _, line, _, _ in segments]
    line = np.array([p for _, walked, _, _ in segments for p in walked], np.int64)
    of = np.array([k for k, _, _, _ in segments], np.int64)
    moved = sheet.moved[np.repeat(of, count)] if len(of) else np.zeros((0, 2), np.int64)
    deep = 2 * depths(sheet.full, line)
    # a line of one point has no profile
    long = [n if n > 1 else 0 for n in count]
    profile = deep[np.repeat(np.array(count, np.int64) > 1, count)] if count else deep
    every = np.array([p for _, _, _, pixels in segments for p in pixels], np.int64)
    area = [n for _, _, n, _ in segments]
    first = np.cumsum([0, *area])[:-1]
    back = sheet.moved[of] if len(of) else np.zeros((0, 2), np.int64)
    edge = lambda values, axis, f: (f.reduceat(values, first) + back[:, axis] if len(of) else np.zeros(0)).astype(float)
    box = {"x1": (every % width, 1, np.minimum), "y1": (every // width, 0, np.minimum), "x2": (every % width, 1, np.maximum), "y2": (every // width, 0, np.maximum)}
    parts = {
        "line": _listed(_points((line % width + moved[:, 1]).astype(float), (line // width + moved[:, 0]).astype(float)), count),
        "profile": _listed(pa.array(profile, pa.float64()), long),
        "box": pa.StructArray.from_arrays([pa.array(edge(*b), pa.float64()) for b in box.values()], list(box)),
        "area": pa.array(np.array(area, float), pa.float64()),
    }
    rows = pa.StructArray.from_arrays(list(parts.values()), list(parts))
    at = np.array([p for found in joints for p in found], float).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({
        "image_id": images,
        "region": regions,
        "segments": _listed(rows, np.bincount(of, minlength=len(regions)).tolist()),
        "joints": _listed(_points(at[:, 1], at[:, 0]), [len(found) for found in joints]),
    })


def wall_parts(runs: DataFrame, images: DataFrame | None = None, cleaned: bool = True) -> DataFrame:
    """image_id, region, segments, joints of each region of ``MIN_COMPONENT`` pixels or more of each image's mask.

    A segment is its line in walking order, twice the distance to the region's edge along it, its
    box and its number of pixels. Joints keep off the borders of ``images`` (image_id, width,
    height); without them there is no lower and right one. A pixel's nearest pixel outside its
    region lies outside all regions, so distances need the region alone.
    """
    found = large_regions(connected_runs(runs), MIN_COMPONENT)
    if images is None:
        sized = found.withColumns({"width": F.lit(None).cast("double"), "height": F.lit(None).cast("double")})
    else:
        sized = found.join(images.select("image_id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")), "image_id", "left")

    def solve(d: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for sheet, first in sheets(d, ["image_id", "region"], pad=4):
            sizes = zip(d["height"][first].astype(float).tolist(), d["width"][first].astype(float).tolist(), strict=True)
            limits = [None if np.isnan(h) or np.isnan(w) else (int(h), int(w)) for h, w in sizes]
            yield _sheet_parts(sheet, d["image_id"][first], d["region"][first], limits, cleaned)

    schema = f"image_id long, region long, segments array<{SEGMENT}>, joints array<{POINT}>"
    return by_groups(sized, ["image_id", "region"], ["y", "x_start"], solve, schema)


def _numbered(parts: DataFrame, items: str, name: str) -> DataFrame:
    """An image's ``items`` as rows, numbered from 1 as ``name`` in the order of their regions."""
    flat = parts.select("image_id", "region", F.posexplode(items).alias("pos", "item"))
    return flat.withColumn(name, F.row_number().over(Window.partitionBy("image_id").orderBy("region", "pos")))


def wall_rows(parts: DataFrame) -> DataFrame:
    """Every wall segment of :func:`wall_parts`, in pixels: image_id, wall_seq, line, ends sx, sy, ex, ey, thickness, box and area (its number of pixels)."""
    line, profile = F.col("item.line"), F.col("item.profile")
    mean = F.aggregate(profile, F.lit(0.0), lambda s, x: s + x) / F.size(profile)
    some = lambda c: F.when(F.size(profile) > 0, c).otherwise(0.0)
    thickness = F.struct(some(mean).alias("average"), some(F.array_min(profile)).alias("min"), some(F.array_max(profile)).alias("max"), profile.alias("profile"))
    end = lambda k, c: F.element_at(line, k)[c]
    return _numbered(parts, "segments", "wall_seq").select(
        "image_id", "wall_seq", line.alias("line"), end(1, "x").alias("sx"), end(1, "y").alias("sy"), end(-1, "x").alias("ex"), end(-1, "y").alias("ey"), thickness.alias("thickness"), "item.box", "item.area"
    )


def joint_rows(parts: DataFrame) -> DataFrame:
    """image_id, j_seq, x, y: the junctions of :func:`wall_parts`."""
    return _numbered(parts, "joints", "j_seq").select("image_id", "j_seq", "item.x", "item.y")


def wall_table(runs: DataFrame, cleaned: bool = True, images: DataFrame | None = None) -> DataFrame:
    """Every wall segment of each image's mask, as :func:`wall_rows`."""
    return wall_rows(wall_parts(runs, images, cleaned))


def wall_segments(runs: DataFrame, cleaned: bool = True, images: DataFrame | None = None) -> DataFrame:
    """image_id, wall_seq, pos, y, x: the ordered centerline points of every wall segment of each image's mask."""
    flat = wall_table(runs, cleaned, images).select("image_id", "wall_seq", F.posexplode("line").alias("pos", "p"))
    return flat.select("image_id", "wall_seq", "pos", F.col("p.y").cast("long").alias("y"), F.col("p.x").cast("long").alias("x"))


def raster_junctions(runs: DataFrame, cleaned: bool = True, images: DataFrame | None = None) -> DataFrame:
    """image_id, j_seq, x, y: junctions of each image's wall mask."""
    return joint_rows(wall_parts(runs, images, cleaned))


def wall_thickness(runs: DataFrame, cleaned: bool = True, images: DataFrame | None = None) -> DataFrame:
    """image_id, wall_seq, average, minimum, maximum, profile: twice the distance to the wall's edge along each centerline; zeros for one point."""
    t = F.col("thickness")
    profile: Column = F.when(F.size(t["profile"]) > 0, t["profile"]).otherwise(F.array(F.lit(0.0)))
    return wall_table(runs, cleaned, images).select("image_id", "wall_seq", t["average"].alias("average"), t["min"].alias("minimum"), t["max"].alias("maximum"), profile.alias("profile"))


def centered_line(mask: np.ndarray, reach: float = 15.0, least: int = 10, snap: int = 10) -> list[tuple[float, float]]:
    """(x, y) of a straight line along a wall: ridge pixels averaged, by their depth, at 3 to 20 places along its longer side, its height if both are equal.

    A point outside the wall moves to the first wall pixel within ``snap`` rings, or goes; masks
    of fewer than ``least`` pixels and lines of fewer than two points are empty.
    """
    if mask.sum() < least:
        return []
    ys, xs = np.nonzero(mask)
    return _ridge_line(mask, ys, xs, distances(mask)[ys, xs], reach, snap)


def _ridge_line(mask: np.ndarray, ys: np.ndarray, xs: np.ndarray, deep: np.ndarray, reach: float = 15.0, snap: int = 10) -> list[tuple[float, float]]:
    """:func:`centered_line` of a mask's pixels and their depths."""
    ridge = deep >= np.percentile(deep, 70)
    ys, xs, weight = ys[ridge], xs[ridge], deep[ridge]
    if len(ys) < 2:
        return []
    flat = np.ptp(xs) > np.ptp(ys)
    along, beside = (xs, ys) if flat else (ys, xs)
    places = np.linspace(along.min(), along.max(), min(max(3, int(np.ptp(along) / 10)), 20))
    centres: list[float] = []
    for at in places:
        near = np.abs(along - at) <= reach
        if near.any():
            some = weight[near]
            centres.append(float((beside[near] * some).sum() / some.sum()))
        else:
            centres.append(centres[-1] if centres else float(beside.mean()))
    out: list[tuple[float, float]] = []
    for at, across in zip(places.tolist(), centres, strict=True):
        x, y = (at, across) if flat else (across, at)
        if mask[int(y), int(x)]:
            out.append((x, y))
        elif q := nearest_inside(mask, int(y), int(x), snap):
            out.append((float(q[1]), float(q[0])))
    return out if len(out) > 1 else []


def inner_line(points: list[tuple[int, int]], mask: np.ndarray, least: int = 2) -> list[tuple[float, float]]:
    """(x, y) of a wall piece's centerline: the centered line of its mask, else its own pixels in walking order, repaired and, from five on, smoothed by threes."""
    if len(points) < 2:
        return []
    line = centered_line(mask)
    if len(line) >= least:
        return line
    ordered = [(float(x), float(y)) for y, x in walk(points)]
    kept = repaired(ordered, mask) if len(ordered) >= least else []
    if len(kept) > 4:
        kept = [tuple(float(v) for v in np.mean(kept[max(0, i - 1) : i + 2], axis=0)) for i in range(len(kept))]
    return kept if len(kept) >= least else []


def centered_lines(runs: DataFrame, least: int = 10) -> DataFrame:
    """image_id, det_id, pos, x, y: the centered line of each wall mask."""

    def solve(d: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for sheet, first in sheets(d, ["image_id", "det_id"], pad=2):
            width, at = sheet.full.shape[1], np.flatnonzero(sheet.full)
            of = sheet.owner.ravel()[at]
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            deep, ends = depths(sheet.full, at), np.searchsorted(of, np.arange(len(first) + 1)).tolist()
            lines = []
            for k, (i, j) in enumerate(zip(ends, ends[1:])):
                t, l, _, _ = sheet.boxes[k].tolist()
                lines.append(_ridge_line(sheet.own(sheet.full, k), at[i:j] // width - t, at[i:j] % width - l, deep[i:j]) if j - i >= least else [])
            count = [len(line) for line in lines]
            places = np.array([p for line in lines for p in line], float).reshape(-1, 2)
            back = np.repeat(sheet.moved + sheet.boxes[:, :2], count, axis=0)
            yield pa.RecordBatch.from_pydict({
                "image_id": np.repeat(d["image_id"][first], count),
                "det_id": np.repeat(d["det_id"][first], count),
                "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in count]),
                "x": places[:, 0] + back[:, 1],
                "y": places[:, 1] + back[:, 0],
            })

    return by_groups(runs.select("image_id", "det_id", "y", "x_start", "x_end"), ["image_id", "det_id"], ["y", "x_start"], solve, "image_id long, det_id long, pos int, x double, y double")
