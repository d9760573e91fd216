"""Small groups share a call of Python, and what took the place of a call a group gives the same rows."""

import numpy as np
import pyarrow as pa

from floorlake import staging
from floorlake.operators import raster, regions, texts


def test_groups_are_whole_and_share_calls(spark):
    rows = [(g, k) for g in range(40) for k in range(1 + (g * 7) % 5 + 30 * (g == 11))]
    d = spark.createDataFrame(rows, "g long, k long")

    def solve(c):
        n = len(staging.group_starts(c, ["g"]))
        first = staging.group_starts(c, ["g"])
        assert (np.diff(c["g"]) >= 0).all()
        yield pa.RecordBatch.from_pydict({"g": c["g"][first], "n": np.diff(np.append(first, len(c["g"]))), "groups": np.full(n, n)})

    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = {g: sum(r[0] == g for r in rows) for g in range(40)}
    try:
        for batch in ("7", "10000"):
            spark.conf.set(key, batch)
            got = staging.by_groups(d, ["g"], ["k"], solve, "g long, n long, groups long").collect()
            assert {r["g"]: r["n"] for r in got} == sizes and len(got) == 40
            assert max(r["groups"] for r in got) > 1
    finally:
        spark.conf.set(key, before)


def test_bands_of_many_images_are_named_in_one_call():
    runs = [(1, 0, 0, 0, 3), (1, 0, 1, 3, 5), (1, 0, 1, 7, 8), (1, 1, 2, 0, 9), (2, 0, 1, -4, 0), (2, 0, 2, 0, 2), (2, 0, 4, 0, 2)]
    d = dict(zip(("image_id", "band", "y", "x_start", "x_end"), (np.array(c) for c in zip(*runs))))
    name = lambda y, x: (y << 32) + x
    assert regions._band_names(d).column("name").to_pylist() == [name(0, 0), name(0, 0), name(1, 7), name(2, 0), name(1, -4), name(1, -4), name(4, 0)]


def test_least_linked_of_many_sets():
    draw = np.random.default_rng(3)
    for n, m in ((1, 0), (40, 25), (400, 300), (300, 900)):
        u, v = draw.integers(0, n, m), draw.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist()):
                want[a] = want[b] = min(want[a], want[b])
        assert regions.least_linked(n, u, v).tolist() == want
    assert (regions.least_linked(5000, np.arange(4999), np.arange(1, 5000)) == 0).all()


def test_groups_stay_whole_after_a_join_on_their_keys(spark):
    d = spark.createDataFrame([(g, k) for g in range(40) for k in range(5)], "g long, k long").hint("merge")
    joined = d.join(spark.createDataFrame([(g,) for g in range(40)], "g long"), "g", "left_semi")
    got = staging.by_groups(joined, ["g"], ["k"], lambda c: [], "g long")
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_regions_on_one_sheet_are_solved_as_alone():
    draw, runs = np.random.default_rng(5), []
    for g in range(30):
        m = np.zeros((70, 70), bool)
        for _ in range(4):
            y, x, h = draw.integers(5, 40, 3) + (0, 0, 10)
            m[y : y + 9, x : min(x + h, 65)] = True
            m[x : min(x + h, 65), y : y + 7] = True
        m = raster.largest_component(m)
        for y in range(70):
            edges = np.flatnonzero(np.diff(np.pad(m[y], 1).astype(np.int8)))
            runs += [(g // 7, g, y + 200 * (g % 3), a - 30, b - 30) for a, b in zip(edges[::2], edges[1::2])]
    d = dict(zip(("image_id", "region", "y", "x_start", "x_end"), (np.array(c) for c in zip(*runs))))

    def solved(d, cleaned):
        out, seen = [], 0
        for sheet, first in raster.sheets(d, ["image_id", "region"], 4):
            out += raster._sheet_parts(sheet, d["image_id"][first], d["region"][first], [(600, 600)] * len(first), cleaned).to_pylist()
            seen = max(seen, len(first))
            at = np.flatnonzero(sheet.full)
            for k in range(len(first)):
                alone = sheet.own(sheet.full, k)
                assert (raster.depths(sheet.full, at[sheet.owner.ravel()[at] == k]) == raster.distances(alone)[alone]).all()
        return out, seen

    for cleaned in (True, False):
        got, together = solved(d, cleaned)
        alone = [solved({c: v[d["region"] == g] for c, v in d.items()}, cleaned)[0][0] for g in range(30)]
        assert got == alone and together > 1 and any(len(r["segments"]) > 1 for r in got)


def test_texts_of_many_images_share_calls_and_none_is_lost(spark):
    draw = np.random.default_rng(8)
    words = ["formal", "dining", "room", "bath", "master", "Bedroom", "Bedrom", "x", None, "@@"]
    rows = [(g, k, words[draw.integers(10)], float(x), float(y), float(x + 9), float(y + 5), float(draw.integers(100)) / 100, None) for g in range(12) for k, (x, y) in enumerate(draw.integers(0, 160, (1 + 40 * g, 2)))]
    d = spark.createDataFrame(rows, texts.SCHEMA)

    def plain(rows, near, like):
        used, groups = set(), []
        for i in range(len(rows)):
            if i not in used and like(rows[i], rows[i]) is not None:
                groups.append([i, *(j for j in range(i + 1, len(rows)) if j not in used and near(rows[i], rows[j]) and like(rows[i], rows[j]))])
                used |= set(groups[-1])
        return groups

    centre = lambda r: ((r[3] + r[5]) / 2, (r[4] + r[6]) / 2)
    apart = lambda a, b: (abs(centre(a)[0] - centre(b)[0]), abs(centre(a)[1] - centre(b)[1]))
    text = lambda r: (r[2] or "").strip().lower()
    joins = lambda a, b: len(text(a)) > 1 and len(text(b)) > 1 and texts._joins(text(a), text(b))
    same = lambda a, b: texts._same_label(text(a), text(b)) if len(text(a)) > 1 and text(a).isalnum() else None
    merged, clustered = [], []
    for g in range(12):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[4], r[3], r[1]))
        merged += [(g, own[p[0]][1], len(p)) for p in plain(own, lambda a, b: apart(a, b)[0] < 150 and apart(a, b)[1] < 30, joins)]
        own = sorted(own, key=lambda r: r[1])
        parts = plain(own, lambda a, b: sum(v * v for v in apart(a, b)) < 900, same)
        clustered += [(g, own[max(p, key=lambda k: (own[k][7], len(own[k][2] or "")))][1]) for p in parts]
    got = [(r["image_id"], r["region_id"], len(r["text"].split()) if "+" in (r["method"] or "") or " " in (r["text"] or "") else 1) for r in texts.merge_regions(d).collect()]
    assert sorted(got) == sorted(merged) and any(n > 2 for *_, n in merged)
    assert sorted((r["image_id"], r["region_id"]) for r in texts.cluster_regions(d).collect()) == sorted(clustered)
    for f in (texts.merge_regions, texts.cluster_regions):
        assert "FlatMapGroupsInPandas" not in f(d)._jdf.queryExecution().executedPlan().toString()


def test_rows_without_an_image_are_one_group(spark):
    rows = [(g, k, t, 9.0 * k, 5.0, 9.0 * k + 8, 9.0, 0.5, "original") for g in (1, None) for k, t in enumerate(("dining", "room", "Kitchen"))]
    d = spark.createDataFrame(rows, texts.SCHEMA)
    got = {(r["image_id"], r["region_id"], r["text"]) for r in texts.merge_regions(d).collect()}
    assert got == {(g, k, t) for g in (1, None) for k, t in ((0, "dining room"), (2, "Kitchen"))}
    runs = spark.createDataFrame([(g, y, 0, 5) for g in (1, None) for y in (3, 4, 9)], "image_id long, y long, x_start long, x_end long")
    named = {(r["image_id"], r["y"], r["region"]) for r in regions.connected_runs(runs).collect()}
    assert named == {(g, y, first << 32) for g in (1, None) for y, first in ((3, 3), (4, 3), (9, 9))}
