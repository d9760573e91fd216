"""Icons found by key points: nearest binary descriptors both ways by shared bands of bits, and a projective map of most agreeing matches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorlake.staging import by_groups, group_starts, scratch, staged

#: A descriptor of 256 bits is an array of so many words of WORD_BITS bits.
WORDS, WORD_BITS = 16, 16
#: Bits in which matches differ at most.
MOST_BITS = 31
#: Probes (a template's word with up to so many bits changed) of templates that are sent to all tasks at most.
MOST_PROBES = 1 << 18
#: Pairs of points that are compared at a time in a task, or one point's.
PAIRS_AT_ONCE = 1 << 18
#: Columns of four words each.
QUARTERS = ["q0", "q1", "q2", "q3"]
MATCH_SCHEMA = "image_id long, template_id long, t_id long, p_id long, distance int, tx double, ty double, px double, py double"
MATCHED = [c.split()[0] for c in MATCH_SCHEMA.split(", ")]
#: Matches looked at of a template in a picture, best first, and the fewest of them; agreeing ones
#: at least, as a number and a share; pixels by which an agreeing match is off at most; sides of an icon's box.
MOST_MATCHES, LEAST_MATCHES = 50, 15
LEAST_INLIERS, LEAST_SHARE = 5, 0.25
REACH = 5.0
LEAST_SIDE, MOST_SIDE = 10.0, 200.0
HYPOTHESES = 500
#: A hypothesis is drawn by squares of multiples of DRAW modulo a prime.
DRAW, PRIME = 48271, 2147483647


def words_of(descriptor: Column) -> Column:
    """The words of a binary descriptor of 32 bytes."""
    digits = F.hex(descriptor)
    return F.array(*[F.conv(F.substring(digits, 4 * k + 1, 4), 16, 10).cast("int") for k in range(WORDS)])


def bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two arrays of words differ."""
    return reduce(lambda s, t: s + t, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(WORDS)])


def _flips(radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(WORD_BITS), n)]


def descriptor_matches(points: DataFrame, templates: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """image_id, template_id, t_id, p_id, distance, tx, ty, px, py: key points of a template and a picture that are each other's nearest, at most ``most`` bits apart.

    ``points`` (image_id, p_id, x, y, words), ``templates`` (template_id, t_id, x, y, words). Of equally near ones the
    smallest id is the nearest. Points are dealt by image, and each is compared with all templates' in its task, where these are
    few enough to be sent there; others meet by shared words. Null descriptors match nothing.
    """
    flips = _flips(most // WORDS)
    fields = [F.col(c).cast("long").alias(c) for c in ("template_id", "t_id")] + [F.col(c).cast("double").alias(f"t{c}") for c in "xy"]
    known = templates.dropna(subset=["template_id", "t_id"]).select(*fields, *_quarters()).orderBy("template_id", "t_id")
    few = known.limit(MOST_PROBES // (WORDS * len(flips)) + 1).toArrow()
    if few.num_rows * WORDS * len(flips) > MOST_PROBES:
        return _joined_matches(points, templates, most, flips)
    own = _described({c: few.column(c).to_numpy() for c in few.column_names})
    bits = np.stack([own[q] for q in QUARTERS], 1).view(np.uint64)
    # templates in their order, so that the order of their points is that of ids
    kind = np.cumsum(np.diff(own["template_id"], prepend=own["template_id"][:1]) != 0)

    def solve(d: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        d = _described(d)
        image = np.cumsum(np.diff(d["image_id"], prepend=d["image_id"][:1]) != 0)
        seen = np.stack([d[q] for q in QUARTERS], 1).view(np.uint64)
        step = max(PAIRS_AT_ONCE // max(len(bits), 1), 1)
        near = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int32))]
        for at in range(0, len(seen), step):
            some = seen[at : at + step, None, :] ^ bits[None, :, :]
            apart = np.bitwise_count(some).sum(2, dtype=np.int32)
            i, k = np.nonzero(apart <= most)
            near.append((i + at, k, apart[i, k]))
        p, q, apart = (np.concatenate(x) for x in zip(*near))
        # points come in the order of their ids
        nearest = _first_of(image[p] * len(bits) + q, apart, p) & _first_of(p * (len(bits) + 1) + kind[q], apart, q)
        p, q, apart = p[nearest], q[nearest], apart[nearest]
        columns = [d["image_id"][p], own["template_id"][q], own["t_id"][q], d["p_id"][p], apart, own["tx"][q], own["ty"][q], d["px"][p], d["py"][p]]
        yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in columns], names=MATCHED)

    named = [F.col(c).cast("long").alias(c) for c in ("image_id", "p_id")] + [F.col(c).cast("double").alias(f"p{c}") for c in "xy"]
    return by_groups(points.dropna(subset=["image_id", "p_id"]).select(*named, *_quarters()), ["image_id"], ["p_id"], solve, MATCH_SCHEMA)


def _quarters() -> list[Column]:
    """The words of a descriptor as QUARTERS, four long numbers, and whether it has them; a filter on these would work out the words once more a quarter."""
    four = lambda q: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.col("words")[4 * q + k].cast("long"), WORD_BITS * k) for k in range(4)])
    whole = reduce(lambda a, b: a & b, [four(q).isNotNull() for q in range(4)])
    return [*[F.coalesce(four(q), F.lit(0).cast("long")).alias(name) for q, name in enumerate(QUARTERS)], whole.cast("int").alias("whole")]


def _described(d: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {c: v[d["whole"] == 1] for c, v in d.items()}


def _first_of(key: np.ndarray, apart: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Whether each pair is the nearest one of its key, of equally near ones the first by ``then``."""
    order = np.lexsort((then, apart, key))
    out = np.zeros(len(key), bool)
    out[order[np.diff(key[order], prepend=-1) != 0]] = True
    return out


def _joined_matches(points: DataFrame, templates: DataFrame, most: int, flips: list[int]) -> DataFrame:
    """:func:`descriptor_matches` by a join of words, for many templates.

    Descriptors ``most`` bits apart have a word that differs in no more than ``most`` // 16
    bits, so only points that share a word, so changed, with a template's are compared; none within ``most`` is missed.
    """
    named = lambda k: [F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"), F.col("words").alias(f"{k}_words"), F.posexplode("words").alias("band", "word")]
    changed = F.explode(F.transform(F.array(*[F.lit(m) for m in flips]), lambda m: F.col("word").bitwiseXOR(m)))
    probes = templates.select("template_id", "t_id", *named("t")).withColumn("word", changed)
    met = points.select("image_id", "p_id", *named("p")).join(probes, ["band", "word"])
    keys = ["image_id", "template_id"]
    with scratch(points.sparkSession):
        found = met.withColumn("distance", bits_apart(F.col("t_words"), F.col("p_words"))).filter(F.col("distance") <= most)
        near = staged(found.select(*keys, "t_id", "p_id", "distance", "tx", "ty", "px", "py").distinct(), "near", keep=True)
    nearest = near.groupBy(*keys, "t_id").agg(F.min(F.struct("distance", "p_id", "tx", "ty", "px", "py")).alias("m"))
    back = near.groupBy(*keys, "p_id").agg(F.min(F.struct("distance", "t_id")).alias("b")).select(*keys, "p_id", "b.t_id")
    return nearest.select(*keys, "t_id", "m.*").join(back, [*keys, "t_id", "p_id"]).select(*MATCHED)


Point = tuple[np.ndarray, np.ndarray]


def _turns(m: list[Point]) -> list[np.ndarray]:
    """Twice the areas of a point's triangles of three others, negative if they turn the other way."""

    def turn(a: Point, b: Point, c: Point) -> np.ndarray:
        return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])

    return [turn(m[3], m[1], m[2]), turn(m[0], m[3], m[2]), turn(m[0], m[1], m[3]), turn(m[0], m[1], m[2])]


def _projection(m: list[Point], ends: list[Point], t: list[np.ndarray], p: list[np.ndarray]) -> list[np.ndarray]:
    """The nine entries of the maps that take four template points to four picture points, row by row, to a factor."""
    weights = [p[k] / t[k] for k in range(3)]
    lines = []
    for k in range(3):
        a, b = m[(k + 1) % 3], m[(k + 2) % 3]
        lines.append((a[1] - b[1], b[0] - a[0], a[0] * b[1] - b[0] * a[1]))
    tops = [(*ends[k], 1.0) for k in range(3)]
    return [tops[0][r] * weights[0] * lines[0][c] + tops[1][r] * weights[1] * lines[1][c] + tops[2][r] * weights[2] * lines[2][c] for r in range(3) for c in range(3)]


def _draws(hypotheses: int) -> np.ndarray:
    """Four numbers of each hypothesis; those of matches are what is left of them by the matches."""
    x = np.arange(4 * hypotheses).reshape(-1, 4) * DRAW
    x = (x + DRAW) % PRIME
    return x * x % PRIME // 64


def _best_maps(lists: list[np.ndarray], hypotheses: int) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of matches (tx, ty, px, py, a row each): the most that agree with a hypothesis, and its map."""
    n = np.array([x.shape[1] for x in lists])
    matches = np.full((4, len(lists), n.max()), np.nan)
    for k, x in enumerate(lists):
        matches[:, k, : n[k]] = x
    chosen = _draws(hypotheses)[None, :, :] % n[:, None, None]
    tx, ty, px, py = np.take_along_axis(matches[:, :, None, :], chosen[None], axis=3)
    with np.errstate(all="ignore"):
        m, ends = ([(x[:, :, k], y[:, :, k]) for k in range(4)] for x, y in ((tx, ty), (px, py)))
        t, p = _turns(m), _turns(ends)
        sound = np.logical_and.reduce([np.abs(x) >= 1 for x in (*t, *p)] + [np.sign(t[k] * p[k]) == np.sign(t[3] * p[3]) for k in range(3)])
        h = _projection(m, ends, t, p)
        score, error = np.zeros(sound.shape, int), np.zeros(sound.shape)
        # a match after another, as sums depend on their order
        for x, y, to_x, to_y in np.moveaxis(matches, 2, 0)[:, :, :, None]:
            row = [h[3 * r] * x + h[3 * r + 1] * y + h[3 * r + 2] for r in range(3)]
            over = np.where(np.abs(row[2]) > 1e-9, row[2], np.nan)
            off_x, off_y = row[0] / over - to_x, row[1] / over - to_y
            off = off_x * off_x + off_y * off_y
            agrees = off <= REACH * REACH
            score += agrees
            error += np.where(agrees, off, 0.0)
    score = np.where(sound, score, -1)
    most = score.max(axis=1)
    best = np.where(score == most[:, None], np.floor(error * 1000 + 0.5), np.inf).argmin(axis=1)
    return most, np.stack([np.take_along_axis(x, best[:, None], axis=1)[:, 0] for x in h], axis=1)


def _mapped(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Where ``h`` takes a point; null at infinity."""
    row = lambda r: h[3 * r] * x + h[3 * r + 1] * y + h[3 * r + 2]
    over = F.when(F.abs(row(2)) > 1e-9, row(2))
    return row(0) / over, row(1) / over


def icons_by_descriptors(points: DataFrame, templates: DataFrame, kinds: DataFrame, most: int = MOST_BITS, hypotheses: int = HYPOTHESES) -> DataFrame:
    """image_id, template_id, class_id, n_matches, score, y1, x1, y2, x2: templates (``kinds``: template_id, class_id, h, w) that a picture shows; score is the number of agreeing matches.

    A hypothesis is the projective map of four of the best matches, drawn by a fixed rule, so a rerun draws the same;
    those with three points nearly in a line, or that mirror some of them, are none. The one with most matches within
    ``REACH`` pixels wins, of equal ones that with the least error. Its map isn't fitted again to the agreeing matches.
    """
    keys = ["image_id", "template_id"]

    def solve(d: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts = group_starts(d, keys)
        sizes = np.minimum(np.diff([*starts, len(d["image_id"])]), MOST_MATCHES)
        groups = np.flatnonzero(sizes >= LEAST_MATCHES)
        # lists of one length and after another are tried together
        groups = groups[np.argsort(sizes[groups], kind="stable")]
        step = max(PAIRS_AT_ONCE // (16 * hypotheses), 1)
        for at in range(0, len(groups), step):
            some = groups[at : at + step]
            lists = [np.stack([d[c][starts[g] : starts[g] + sizes[g]] for c in ("tx", "ty", "px", "py")]) for g in some]
            score, maps = _best_maps(lists, hypotheses)
            kept = (score >= LEAST_INLIERS) & (score >= LEAST_SHARE * sizes[some])
            own = starts[some[kept]]
            map_ = pa.ListArray.from_arrays(pa.array(np.arange(0, 9 * len(own) + 1, 9), pa.int32()), pa.array(maps[kept].ravel()))
            columns = [pa.array(d[k][own]) for k in keys] + [pa.array(sizes[some[kept]], pa.int32()), pa.array(score[kept], pa.int32()), map_]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n_matches", "score", "map"])

    matches = descriptor_matches(points, templates, most)
    doubles = {c: F.col(c).cast("double") for c in ("tx", "ty", "px", "py")}
    d = lambda c: F.col(c).cast("double").alias(c)
    chosen = by_groups(matches.withColumns(doubles), keys, ["distance", "t_id"], solve, "image_id long, template_id long, n_matches int, score int, map array<double>")
    shown = chosen.join(kinds.select("template_id", "class_id", d("h"), d("w")), "template_id")
    corners = [_mapped(F.col("map"), x, y) for x in (F.lit(0.0), F.col("w")) for y in (F.lit(0.0), F.col("h"))]
    box = {"y1": F.least(*[c[1] for c in corners]), "x1": F.least(*[c[0] for c in corners]), "y2": F.greatest(*[c[1] for c in corners]), "x2": F.greatest(*[c[0] for c in corners])}
    boxes = shown.select(*keys, "class_id", "n_matches", F.col("score").cast("double").alias("score"), *[v.alias(k) for k, v in box.items()])
    return boxes.filter((F.col("x2") - F.col("x1")).between(LEAST_SIDE, MOST_SIDE) & (F.col("y2") - F.col("y1")).between(LEAST_SIDE, MOST_SIDE))
