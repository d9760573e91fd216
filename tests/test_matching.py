"""Template hits against correlation at every place."""

import random

from pyspark.sql import functions as F

from floorlake import picture_queries, queries  # noqa: F401  (registers its queries)
from floorlake.operators import matching

PIXELS = "image_id long, y long, x long, value long"
TEMPLATES = "template_id long, y long, x long, value long"


def plain_hits(pictures, templates, threshold, most):
    out = []
    for i, (h, w, p) in pictures.items():
        for t, (th, tw, q) in templates.items():
            own, mean = [], sum(q.values()) / len(q)
            energy = sum((v - mean) ** 2 for v in q.values())
            for y in range(h - th + 1):
                for x in range(w - tw + 1):
                    near = {(a, b): p[y + a, x + b] for a in range(th) for b in range(tw)}
                    m = sum(near.values()) / len(near)
                    left = sum((v - m) ** 2 for v in near.values())
                    if energy > 1e-9 and left > 1e-9:
                        score = sum((q[k] - mean) * (near[k] - m) for k in q) / (energy * left) ** 0.5
                        if score >= threshold:
                            own.append((-round(score, 9), y, x))
            out += [(i, t, y, x, th, tw, round(-s, 6)) for s, y, x in sorted(own)[:most]]
    return sorted(out)


def grid(r, h, w, values):
    return h, w, {(y, x): r.choice(values) for y in range(h) for x in range(w)}


def tables(spark, pictures, templates):
    p = spark.createDataFrame([(i, y, x, v) for i, (_, _, d) in pictures.items() for (y, x), v in d.items()], PIXELS)
    t = spark.createDataFrame([(i, y, x, v) for i, (_, _, d) in templates.items() for (y, x), v in d.items()], TEMPLATES)
    return p, t


def test_hits_against_every_place(spark):
    r = random.Random(2)
    pictures = {1: grid(r, 11, 13, [0, 10, 250]), 2: grid(r, 4, 9, [30, 31]), 3: (5, 5, {(y, x): 7 for y in range(5) for x in range(5)}), 4: grid(r, 12, 12, [0, 0, 0, 9])}
    templates = {1: grid(r, 3, 4, [0, 255]), 2: grid(r, 1, 1, [5]), 3: grid(r, 1, 3, [0, 9]), 4: grid(r, 6, 5, [0, 80, 90]), 5: grid(r, 20, 2, [0, 1]), 6: grid(r, 2, 2, [0, 200]), 7: grid(r, 3, 4, [1, 2, 3]), 8: (2, 3, {(y, x): 4 for y in range(2) for x in range(3)})}
    for k, (y, x) in {9: (2, 3), 10: (5, 6)}.items():  # cut out of a picture, so that they are found
        templates[k] = (6, 5, {(a, b): pictures[1][2][y + a, x + b] for a in range(6) for b in range(5)})
    p, t = tables(spark, pictures, templates)
    for threshold, most in ((0.85, 200), (0.3, 3)):
        got = sorted(tuple(x) for x in matching.template_hits(p, t, threshold, most).withColumn("score", F.round("score", 6)).collect())
        want = plain_hits(pictures, templates, threshold, most)
        assert [g[:6] for g in got] == [w[:6] for w in want] and all(abs(g[6] - w[6]) < 2e-6 for g, w in zip(got, want, strict=True)), threshold
        assert {9, 10} <= {g[1] for g in got}


def test_bound_drops_most_places_but_no_hit(spark):
    r = random.Random(4)
    smooth = {(y, x): min(255, 8 * x + 3 * y + r.randint(0, 4)) for y in range(40) for x in range(40)}
    mark = {(y, x): 20 if (y < 4) == (x < 4) else 220 for y in range(8) for x in range(8)}
    smooth.update({(y + 11, x + 17): v for (y, x), v in mark.items()})
    p, t = tables(spark, {1: (40, 40, smooth)}, {1: (8, 8, mark)})
    places = matching.possible_places(p, t).collect()
    assert (11, 17) in {(r["y"], r["x"]) for r in places} and len(places) < 0.05 * 33 * 33
    assert [(r["y"], r["x"]) for r in matching.template_hits(p, t).orderBy(F.desc("score")).collect()][0] == (11, 17)


def test_no_templates_or_pictures(spark):
    p, t = tables(spark, {1: grid(random.Random(1), 3, 3, [1, 2])}, {1: grid(random.Random(1), 2, 2, [1, 2])})
    assert matching.template_hits(p, t.limit(0)).count() == 0 and matching.template_hits(p.limit(0), t).count() == 0


def test_icon_boxes(spark):
    hits = [(1, 1, 4, 10, 20, 30, 0.9, 4), (1, 2, 5, 11, 20, 30, 0.95, 4), (1, 3, 5, 11, 20, 30, 0.86, 5), (1, 1, 100, 100, 20, 30, 0.88, 4), (1, 4, 0, 0, 4, 30, 0.99, 4), (1, 5, 0, 0, 90, 30, 0.99, 4)]
    d = spark.createDataFrame(hits, "image_id long, template_id long, y long, x long, h long, w long, score double, class_id int")
    got = matching.icon_boxes(d, F.lit(0.5)).collect()
    assert sorted((r["class_id"], r["score"], r["y1"], r["x1"], r["y2"], r["x2"]) for r in got) == [(4, 0.88, 200.0, 200.0, 240.0, 260.0), (4, 0.95, 10.0, 22.0, 50.0, 82.0), (5, 0.86, 10.0, 22.0, 50.0, 82.0)]


def test_a_picture_of_several_bands(spark):
    r = random.Random(7)
    pictures = {1: grid(r, 23, 9, [0, 10, 250]), 2: grid(r, 10, 7, [0, 3, 9])}
    templates = {k: (h, 3, {(a, b): pictures[1][2][y + a, x + b] for a in range(h) for b in range(3)}) for k, h, y, x in ((1, 3, 4, 2), (2, 8, 1, 5), (3, 12, 11, 0), (4, 3, 20, 6))}
    p, t = tables(spark, pictures, templates)
    got = sorted(tuple(x) for x in matching.template_hits(p, t, 0.5, height=5).withColumn("score", F.round("score", 6)).collect())
    want = plain_hits(pictures, templates, 0.5, 200)
    assert [g[:6] for g in got] == [w[:6] for w in want] and {1, 2, 3, 4} <= {g[1] for g in got if g[6] > 0.999}


def test_pixels_are_shuffled_by_no_window_and_nothing_runs_before(spark, tmp_path):
    rows = [(e, e % 3, ("view", "signup", "purchase")[e % 3]) for e in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan of template_hits", "")
    found = queries.QUERIES["template_hits"](spark, str(tmp_path))
    text = found._jdf.queryExecution().executedPlan().toString()
    jobs = tracker.getJobIdsForGroup("plan of template_hits")
    spark.sparkContext.setJobGroup("", "")
    # a job each that reads the schema of events aside, only the running of the result is work
    assert len(jobs) <= 1 and len(text) < 40000
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning" in line and " y#" in line]
