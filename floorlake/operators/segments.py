"""Wall lines split where windows lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorlake.functions import geometry as g
from floorlake.operators.pairs import first_windows

#: Hits nearer than this are one; a part ends this far from the window; shorter parts go.
SAME_HIT = 1.0
CLOSE = 2.0


def split_parts(s: g.Segment, b: g.Box) -> Column:
    """Array of structs (x1, y1, x2, y2): what is left of a segment outside a box, from its start.

    A segment that meets no edge stays if it is outside and goes if it is inside; one hit leaves
    the part on the outer end's side; two leave a part on both sides, each if longer than CLOSE.
    """
    hits = F.filter(F.array(*[g.crossing_point(s, e) for e in g.edges(b)]), lambda p: p.isNotNull())
    from_start = lambda p: g.distance(s.x1, s.y1, p["x"], p["y"])
    along = F.array_sort(F.transform(hits, lambda p: F.struct(from_start(p).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))
    part = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    def parts(a: Column) -> Column:
        first, last = F.get(a, F.lit(0)), F.get(a, F.size(a) - 1)
        two = F.size(a).between(2, 4) & (last["d"] - first["d"] > SAME_HIT)
        starts_in, ends_in = g.inside(s.x1, s.y1, b), g.inside(s.x2, s.y2, b)
        head = part(s.x1, s.y1, first["x"], first["y"])
        tail = part(last["x"], last["y"], s.x2, s.y2)
        whole = part(s.x1, s.y1, s.x2, s.y2)
        outer = F.when(starts_in & ~ends_in, F.array(tail)).when(ends_in & ~starts_in, F.array(head)).when(~starts_in & ~ends_in, F.array(whole))
        chosen = F.when(F.size(a) == 0, F.when(starts_in & ends_in, F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).otherwise(F.array(whole)))
        chosen = chosen.when(two, F.array(head, tail)).otherwise(F.coalesce(outer, F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")))
        return F.filter(chosen, lambda p: g.distance(p["x1"], p["y1"], p["x2"], p["y2"]) > CLOSE)

    return F.get(F.transform(F.array(along), parts), F.lit(0))


def split_around_windows(segments: DataFrame, windows: DataFrame, margin: float = 6.0) -> DataFrame:
    """image_id, seg_id, part, x1, y1, x2, y2: each segment less the first window in order that it meets."""
    met = first_windows(segments, windows, margin).select("image_id", "seg_id", *[F.col(c).alias(f"w_{c}") for c in ("y1", "x1", "y2", "x2")])
    d = segments.join(met, ["image_id", "seg_id"], "left")
    s = g.Segment(*map(F.col, ("x1", "y1", "x2", "y2")))
    whole = F.array(F.struct("x1", "y1", "x2", "y2"))
    parts = F.when(F.col("w_y1").isNull(), whole).otherwise(split_parts(s, g.box("w_")))
    return d.select("image_id", "seg_id", F.posexplode(parts).alias("part", "p")).select("image_id", "seg_id", F.col("part").cast("long").alias("part"), "p.*")
