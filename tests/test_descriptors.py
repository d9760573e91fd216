"""Descriptor matches against every pair, and icons planted at known places."""

import random

import pytest
from pyspark.sql import functions as F

from floorlake import picture_queries
from floorlake.adapters import Views
from floorlake.operators import descriptors

POINTS = "image_id long, p_id long, x double, y double, words array<int>"
TEMPLATES = "template_id long, t_id long, x double, y double, words array<int>"
KINDS = "template_id long, class_id int, h long, w long"


def words(r):
    return [r.randrange(1 << 16) for _ in range(16)]


def changed(r, w, n):
    out = list(w)
    for b in r.sample(range(256), n):
        out[b // 16] ^= 1 << b % 16
    return out


def apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))


def plain_matches(points, templates, most):
    out = set()
    for i in {p[0] for p in points}:
        for t in {q[0] for q in templates}:
            ps, ts = [p for p in points if p[0] == i], [q for q in templates if q[0] == t]
            to = {q[1]: min((apart(q[4], p[4]), p[1]) for p in ps) for q in ts}
            back = {p[1]: min((apart(q[4], p[4]), q[1]) for q in ts) for p in ps}
            out |= {(i, t, k, p, d) for k, (d, p) in to.items() if back[p][1] == k and d <= most}
    return out


@pytest.mark.parametrize("most", [15, 31, 40])
def test_matches_against_every_pair(spark, most):
    r = random.Random(most)
    templates = [(t, k, 0.0, 0.0, words(r)) for t in range(3) for k in range(12)]
    templates += [(2, 12, 0.0, 0.0, templates[30][4]), (3, 0, 0.0, 0.0, [0] * 16)]
    points = [(i, k, 0.0, 0.0, changed(r, r.choice(templates)[4], r.choice([0, 3, 15, 16, 30, 31, 32, 40, 41]))) for i in range(3) for k in range(60)]
    points += [(1, 70 + k, 0.0, 0.0, points[65][4]) for k in range(3)] + [(0, 99, 0.0, 0.0, words(r))]
    p, t = spark.createDataFrame([*points, (1, 100, 0.0, 0.0, None)], POINTS), spark.createDataFrame([*templates, (4, 0, 0.0, 0.0, None)], TEMPLATES)
    got = descriptors.descriptor_matches(p, t, most).collect()
    want = plain_matches(points, templates, most)
    assert len(got) == len(want) > 20 and {tuple(x)[:5] for x in got} == want
    assert descriptors.descriptor_matches(p.limit(0), t).count() == descriptors.descriptor_matches(p, t.limit(0)).count() == 0


def test_matches_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(descriptors, "MOST_PROBES", 0)
    r = random.Random(3)
    templates = [(1, k, 0.0, 0.0, words(r)) for k in range(8)]
    points = [(1, k, 0.0, 0.0, changed(r, templates[k % 8][4], k)) for k in range(20)]
    got = descriptors.descriptor_matches(spark.createDataFrame(points, POINTS), spark.createDataFrame(templates, TEMPLATES)).collect()
    assert {tuple(x)[:5] for x in got} == plain_matches(points, templates, 31)


def projected(x, y):
    s = 1 + 0.0006 * x - 0.0004 * y
    return (120 + 1.3 * x - 0.4 * y) / s, (80 + 0.35 * x + 1.2 * y) / s


def planted(r, image, template, agreeing, away):
    """Picture points of a template's, ``agreeing`` of them where the map takes them, ``away`` of them anywhere."""
    out = []
    for k, q in enumerate(template[: agreeing + away]):
        x, y = projected(q[2], q[3]) if k < agreeing else (r.uniform(0, 900), r.uniform(0, 900))
        out.append((image, k, x + r.uniform(-0.2, 0.2), y + r.uniform(-0.2, 0.2), changed(r, q[4], r.randint(0, 9))))
    return out + [(image, 1000 + k, r.uniform(0, 900), r.uniform(0, 900), words(r)) for k in range(20)]


def test_icons_at_known_places(spark):
    r = random.Random(7)
    template = [(1, k, r.uniform(0, 60), r.uniform(0, 50), words(r)) for k in range(40)]
    # 1: most agree; 2: a third are elsewhere; 3: too few matches; 4: none agree
    points = planted(r, 1, template, 40, 0) + planted(r, 2, template, 26, 14) + planted(r, 3, template, 14, 0) + planted(r, 4, template, 0, 40)
    other = [(2, k, *q[2:4], words(r)) for k, q in enumerate(template)]
    p, t = spark.createDataFrame(points, POINTS), spark.createDataFrame(template + other, TEMPLATES)
    got = descriptors.icons_by_descriptors(p, t, spark.createDataFrame([(1, 4, 50, 60), (2, 5, 50, 60)], KINDS)).orderBy("image_id").collect()
    assert [(x["image_id"], x["template_id"], x["class_id"], x["n_matches"], x["score"] >= n) for x, n in zip(got, (40, 26), strict=True)] == [(1, 1, 4, 40, True), (2, 1, 4, 40, True)]
    ends = [projected(x, y) for x in (0, 60) for y in (0, 50)]
    want = [min(e[1] for e in ends), min(e[0] for e in ends), max(e[1] for e in ends), max(e[0] for e in ends)]
    for x in got:
        assert all(abs(x[c] - w) < 3 for c, w in zip(("y1", "x1", "y2", "x2"), want, strict=True)), (x, want)
    huge = spark.createDataFrame([(1, 4, 500, 600)], KINDS)
    assert descriptors.icons_by_descriptors(p, t, huge).count() == 0


def test_words_of_bytes(spark):
    r = random.Random(1)
    w = words(r)
    raw = bytearray(b"".join(x.to_bytes(2, "big") for x in w))
    assert spark.createDataFrame([(raw,)], "d binary").select(descriptors.words_of(F.col("d")).alias("w")).first()["w"] == w


def test_words_of_points_with_large_numbers(spark, tmp_path):
    # the square of such a point's number is beyond a long
    found = [10**9 + k for k in range(43)]
    rows = [(e, 1, "view") for e in found]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["p_id"]: r["words"] for r in picture_queries.picture_points(Views(spark, str(tmp_path))).collect()}
    for e in found:
        shown = e * 7919 % 43
        t, i = (shown // 20, shown % 20) if shown < 40 else (9, e)
        off = [1 if e % 13 == 0 else 3 if e % 17 == 0 else 1 << e % 16 if (e + b) % 7 == 0 else 0 for b in range(16)]
        assert got[e] == [(i * 40503 + b * 30011 + t * 9973 + 17) ** 2 % 65521 ^ off[b] for b in range(16)]
