"""Key points are compared and maps tried many at a time in tasks: the same as one after another, with no table in between."""

import math
import random

import numpy as np

from floorlake.operators import descriptors

POINTS = "image_id long, p_id long, x double, y double, words array<int>"
TEMPLATES = "template_id long, t_id long, x double, y double, words array<int>"


def drawn(seed=4):
    r = random.Random(seed)
    words = lambda: [r.randrange(1 << 16) for _ in range(16)]
    templates = [(t, k, r.uniform(0, 60), r.uniform(0, 60), words()) for t in (3, 1) for k in range(20)]
    points = []
    for i in range(9):
        for k in range(60):
            _, _, x, y, w = r.choice(templates)
            w = [v ^ (1 << r.randrange(16)) if r.random() < 0.9 else v for v in w]
            points.append((i, k, 2 * x + r.random(), 2 * y + 5 * (k % 4 == 0), w))
    return points, templates


def test_the_join_and_the_tasks_find_the_same(spark, monkeypatch):
    points, templates = drawn()
    d = spark.createDataFrame([*points, (None, 1, 0.0, 0.0, points[0][4]), (2, None, 0.0, 0.0, points[0][4])], POINTS)
    t = spark.createDataFrame([*templates, (None, 7, 0.0, 0.0, points[0][4])], TEMPLATES)
    found = lambda: sorted(map(tuple, descriptors.descriptor_matches(d, t).collect()))
    got = found()
    monkeypatch.setattr(descriptors, "MOST_PROBES", 0)
    assert [x for x in found() if x[3] is not None] == got and len(got) > 100


def test_matches_are_dealt_once_and_not_staged(spark, monkeypatch):
    points, templates = drawn()
    monkeypatch.setattr(descriptors, "staged", None)
    d, t = spark.createDataFrame(points, POINTS), spark.createDataFrame(templates, TEMPLATES)
    plan = descriptors.descriptor_matches(d, t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    kinds = spark.createDataFrame([(1, 4, 50, 60), (3, 5, 50, 60)], "template_id long, class_id int, h long, w long")
    plan = descriptors.icons_by_descriptors(d, t, kinds)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("REPARTITION_BY_NUM") == 2


def plain_best(matches, hypotheses):
    """The best of hypotheses, one after another."""
    best = (-1, 0.0, 0, None)
    for h in range(hypotheses):
        four = [matches[(x * x % descriptors.PRIME // 64) % len(matches)] for x in ((4 * h + k + 1) * descriptors.DRAW % descriptors.PRIME for k in range(4))]
        turn = lambda a, b, c, s: (b[s] - a[s]) * (c[s + 1] - a[s + 1]) - (c[s] - a[s]) * (b[s + 1] - a[s + 1])
        t, p = ([turn(four[a], four[b], four[c], s) for a, b, c in ((3, 1, 2), (0, 3, 2), (0, 1, 3), (0, 1, 2))] for s in (0, 2))
        if min(map(abs, t + p)) < 1 or any(math.copysign(1, t[k] * p[k]) != math.copysign(1, t[3] * p[3]) for k in range(3)):
            continue
        lines = [(a[1] - b[1], b[0] - a[0], a[0] * b[1] - b[0] * a[1]) for a, b in ((four[1], four[2]), (four[2], four[0]), (four[0], four[1]))]
        m = [sum((four[k][2], four[k][3], 1.0)[r] * (p[k] / t[k]) * lines[k][c] for k in range(3)) for r in range(3) for c in range(3)]
        errors = []
        for x, y, px, py in matches:
            row = [m[3 * r] * x + m[3 * r + 1] * y + m[3 * r + 2] for r in range(3)]
            if abs(row[2]) > 1e-9:
                errors.append((row[0] / row[2] - px) ** 2 + (row[1] / row[2] - py) ** 2)
        errors = [e for e in errors if e <= 25]
        best = max(best, (len(errors), -round(sum(errors), 3), -h, m), key=lambda b: b[:3])
    return best[0], best[3]


def test_maps_tried_together_are_those_tried_one_by_one():
    r = random.Random(6)
    lists = []
    for n in (15, 22, 50, 16):
        spots = [(r.uniform(0, 60), r.uniform(0, 60)) for _ in range(n)]
        lists.append([(x, y, 100 + 1.4 * x - 0.3 * y + r.uniform(-2, 2), 50 + 0.2 * x + 1.3 * y + r.uniform(-2, 2)) for x, y in spots])
    lists.append([(float(k), 2.0 * k, float(k), 2.0 * k) for k in range(15)])
    score, maps = descriptors._best_maps([np.array(x).T for x in lists], 200)
    for k, x in enumerate(lists):
        want, m = plain_best(x, 200)
        assert score[k] == want and (m is None or np.allclose(maps[k], m, rtol=1e-12))
    assert score[:4].min() > 10 and score[4] == -1
