"""Named queries over the test tables' views, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorlake.adapters import SQL_VIEWS, Views
from floorlake.functions import classify as c
from floorlake.functions import geometry as g
from floorlake.functions import text as t
from floorlake.functions import units
from floorlake.operators import evaluate, masks, metrics, pairs, paths, prepare, raster, segments, selection, suppress, texts
from floorlake.plans import reports
from floorlake.sources import images, outputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True, recursive: bool = False) -> Callable:
    """Registers a function of the views under its name, with SQL over the same views."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            body = sql.strip()
            joint = ",\n" if body.startswith("+") else "\n"
            head = f"WITH {'RECURSIVE ' if recursive else ''}{SQL_VIEWS}{joint}" if views else ""
            ORACLE_SQL[f.__name__] = head + body.removeprefix("+")
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def joined(x: str) -> Column:
    return F.array_join(F.col(x).cast("array<string>"), "|")


def size() -> tuple[Column, Column]:
    b = g.box()
    return b.x2 - b.x1, b.y2 - b.y1


IOU = """CASE WHEN least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1) AND least({a}.y2, {b}.y2) > greatest({a}.y1, {b}.y1) THEN
  ((least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))
  / (({a}.y2 - {a}.y1) * ({a}.x2 - {a}.x1) + ({b}.y2 - {b}.y1) * ({b}.x2 - {b}.x1) - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))
  ELSE 0::DOUBLE END"""
AB = IOU.format(a="a", b="b")
DOORS = "FROM detections WHERE class_id = 3"
WINDOWS = "FROM detections WHERE class_id = 2"


def notes_sql(*notes: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} THEN '{v}' END" for k, v in notes) + "], lambda x: x IS NOT NULL), '|')"


@query("SELECT image_id, det_id, CASE class_id WHEN 1 THEN 'wall' WHEN 2 THEN 'window' WHEN 3 THEN 'door' ELSE 'unknown' END AS name FROM detections")
def class_names(v: Views) -> DataFrame:
    return v.detections.select("image_id", "det_id", c.class_name(F.col("class_id")).alias("name"))


@query("SELECT det_id, (y2 - y1) * (x2 - x1) AS area, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y, x2 - x1 AS width, y2 - y1 AS height FROM detections")
def box_geometry(v: Views) -> DataFrame:
    b, (w, h) = g.box(), size()
    return v.detections.select("det_id", g.area(b).alias("area"), g.center_x(b).alias("center_x"), g.center_y(b).alias("center_y"), w.alias("width"), h.alias("height"))


@query("SELECT det_id, x1 * mm_per_px AS x1_mm, y1 * mm_per_px AS y1_mm, (x2 - x1) * mm_per_px AS width_mm FROM detections JOIN images USING (image_id)")
def px_to_mm(v: Views) -> DataFrame:
    s = F.col("mm_per_px")
    return v.detections.join(v.images, "image_id").select("det_id", (F.col("x1") * s).alias("x1_mm"), (F.col("y1") * s).alias("y1_mm"), (size()[0] * s).alias("width_mm"))


@query("SELECT image_id, det_id, CASE WHEN score > 0.8::DOUBLE THEN 'high' WHEN score > 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM detections")
def confidence_bands(v: Views) -> DataFrame:
    return v.detections.select("image_id", "det_id", c.confidence_band(F.col("score")).alias("band"))


@query(f"""SELECT det_id, CASE WHEN a < 2000 THEN 'small' WHEN a < 6000 THEN 'standard' WHEN a < 10000 THEN 'large' ELSE 'oversized' END AS size_category,
  CASE WHEN w > 80 THEN 'ADA_compliant_likely' WHEN w > 60 THEN 'standard_width' ELSE 'narrow_door' END AS accessibility FROM (SELECT det_id, x2 - x1 AS w, (x2 - x1) * (y2 - y1) AS a {DOORS})""")
def door_classification(v: Views) -> DataFrame:
    w, h = size()
    return v.detections.filter("class_id = 3").select("det_id", c.door_size(w, h).alias("size_category"), c.door_access(w).alias("accessibility"))


@query(f"""SELECT det_id, CASE WHEN a < 1000 THEN 'small' WHEN a < 4000 THEN 'standard' WHEN a < 8000 THEN 'large' ELSE 'oversized' END AS size_category,
  CASE WHEN a < 2000 THEN 'single_glazing_likely' WHEN a < 6000 THEN 'double_glazing_likely' ELSE 'triple_glazing_likely' END AS glazing_type, CASE WHEN w > h THEN 'horizontal' ELSE 'vertical' END AS window_type
  FROM (SELECT det_id, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS a {WINDOWS})""")
def window_classification(v: Views) -> DataFrame:
    w, h = size()
    return v.detections.filter("class_id = 2").select("det_id", c.window_size(w, h).alias("size_category"), c.window_glazing(w, h).alias("glazing_type"), c.window_type(w, h).alias("window_type"))


SWING = """(SELECT det_id, x2 - x1 AS w, y2 - y1 AS h, CASE WHEN y2 - y1 > x2 - x1 THEN 'vertical' ELSE 'horizontal' END AS door_type,
  CASE WHEN y2 - y1 > x2 - x1 THEN CASE WHEN (x1 + x2) / 2 < width / 2 THEN 'opens_leftward' ELSE 'opens_rightward' END
  ELSE CASE WHEN (y1 + y2) / 2 > height / 2 THEN 'opens_upward' ELSE 'opens_downward' END END AS swing FROM detections JOIN images USING (image_id) WHERE class_id = 3)"""


@query(f"""SELECT det_id, door_type, swing AS estimated_swing, CASE swing WHEN 'opens_leftward' THEN 'left_edge' WHEN 'opens_rightward' THEN 'right_edge' WHEN 'opens_upward' THEN 'bottom_edge' ELSE 'top_edge' END AS hinge_side FROM {SWING}""")
def door_orientation_fallback(v: Views) -> DataFrame:
    d = v.detections.filter("class_id = 3").join(v.images, "image_id").select("det_id", c.door_orientation(g.box(), F.col("width"), F.col("height")).alias("o"))
    return d.select("det_id", "o.door_type", "o.estimated_swing", "o.hinge_side")


@query("SELECT det_id, " + notes_sql(("w > h AND w >= 80", "Likely a standard interior door (32+ inches)"), ("w > h AND w < 80", "Possible narrow door or entry"), ("swing LIKE '%upward'", "May open into upper room/hallway"), ("swing LIKE '%downward'", "May open into lower room/hallway"), ("swing LIKE '%leftward'", "Opens toward left side of floor plan"), ("swing LIKE '%rightward'", "Opens toward right side of floor plan"), ("true", "Low confidence - manual verification recommended")) + f" AS notes FROM {SWING}")
def door_notes(v: Views) -> DataFrame:
    return reports.door_records(v.detections, v.images).select("det_id", joined("notes").alias("notes"))


@query("SELECT det_id, " + notes_sql(("w * h < 1000", "Small window - possibly for ventilation or light"), ("w * h > 8000", "Large window - likely for significant natural lighting"), ("w > h", "Horizontal window orientation"), ("w > h AND w > h * 2", "Wide horizontal window - panoramic view"), ("w <= h", "Vertical window orientation"), ("w <= h AND h > w * 2", "Tall vertical window - floor-to-ceiling style"), ("w / h > 3", "Very wide window - modern architectural style"), ("w / h < 0.5::DOUBLE", "Very tall window - contemporary design")) + f" AS notes FROM (SELECT det_id, x2 - x1 AS w, y2 - y1 AS h {WINDOWS})")
def window_notes(v: Views) -> DataFrame:
    return reports.window_records(v.detections, v.images).select("det_id", joined("notes").alias("notes"))


@query("""+ kinds AS (SELECT unnest([1, 2, 3]) AS class_id, unnest(['walls', 'windows', 'doors']) AS object),
m AS (SELECT image_id, class_id, count(*) AS n, avg(score) AS a, avg((y2 - y1) * (x2 - x1)) AS s, min(score) AS lo, max(score) AS hi FROM detections GROUP BY 1, 2)
SELECT i.image_id, object, coalesce(n, 0)::BIGINT AS count, round(coalesce(a, 0), 9) AS avg_confidence, round(coalesce(s, 0), 9) AS avg_size, lo AS min_confidence, hi AS max_confidence
FROM images i CROSS JOIN kinds k LEFT JOIN m ON m.image_id = i.image_id AND m.class_id = k.class_id""")
def class_summary_zero_filled(v: Views) -> DataFrame:
    return rounded(metrics.class_summary(v.detections, v.images), "avg_confidence", "avg_size", digits=9)


@query("SELECT image_id, round(sum((y2 - y1) * (x2 - x1)) / any_value(width * height) * 100, 6) AS coverage_pct FROM detections JOIN images USING (image_id) GROUP BY image_id")
def coverage_pct(v: Views) -> DataFrame:
    return rounded(metrics.overall(v.detections, v.images).select("image_id", "coverage_pct"), "coverage_pct")


ANOMALIES = """w AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1 AS detection_id, (y2 - y1) * (x2 - x1) AS area FROM detections WHERE class_id = 1),
md AS (SELECT image_id, median(area) AS median_area FROM w GROUP BY image_id),
odd AS (SELECT image_id, detection_id, area, median_area, CASE WHEN area > median_area * 5 THEN 'unusually_large' ELSE 'unusually_small' END AS reason
  FROM w JOIN md USING (image_id) WHERE area > median_area * 5 OR area < median_area * 0.2::DOUBLE)"""


@query(f"+ {ANOMALIES}\nSELECT * FROM odd")
def size_anomalies(v: Views) -> DataFrame:
    return metrics.size_anomalies(v.detections)


PAIRS = f"""p AS (SELECT a.image_id, a.det_id AS a_id, b.det_id AS b_id, {AB} AS iou FROM detections a JOIN detections b ON a.image_id = b.image_id AND a.det_id < b.det_id WHERE {AB} > 0.3::DOUBLE)"""
ACCURACY = f"""{ANOMALIES},
{PAIRS},
base AS (SELECT image_id, count(*) AS n, avg(score) AS a, count(*) FILTER (score > 0.8::DOUBLE) AS high, count(*) FILTER (score <= 0.5::DOUBLE) AS low FROM detections GROUP BY image_id),
acc AS (SELECT image_id, n, a, high, low, coalesce((SELECT count(*) FROM p WHERE p.image_id = base.image_id), 0) AS n_over, coalesce((SELECT count(*) FROM odd WHERE odd.image_id = base.image_id), 0) AS anomalies FROM base),
rel AS (SELECT *, least(40, a * 40) + high / greatest(1, n) * 30 + greatest(0, 20 - 5 * n_over) + CASE WHEN n BETWEEN 1 AND 50 THEN 10 ELSE greatest(0, 10 - abs(n - 25)) END AS s FROM acc)"""


@query(f"+ {ACCURACY}\nSELECT image_id, n::BIGINT AS n, high::BIGINT AS high, low::BIGINT AS low, n_over::BIGINT AS overlaps, anomalies::BIGINT AS anomalies, round(s, 6) AS reliability_score FROM rel")
def reliability_score(v: Views) -> DataFrame:
    return rounded(metrics.accuracy(v.detections, v.images).select("image_id", "n", "high", "low", "overlaps", "anomalies", "reliability_score"), "reliability_score")


RECOMMENDED = """array_to_string(list_filter([CASE WHEN a < 0.6::DOUBLE THEN 'Low average confidence detected. Consider using higher quality images or retraining the model.' END,
  CASE WHEN low > n * 0.3::DOUBLE THEN 'Many low-confidence detections found. Review these detections manually.' END,
  CASE WHEN n_over > 0 THEN 'Found ' || n_over || ' overlapping detections. Check for duplicate objects.' END,
  CASE WHEN anomalies > 0 THEN 'Found ' || anomalies || ' size anomalies. Review unusual object sizes.' END,
  CASE WHEN s > 80 THEN 'High reliability score! Results appear very accurate.' WHEN s > 60 THEN 'Good reliability score. Results are generally trustworthy.' ELSE 'Low reliability score. Carefully review all detections.' END], lambda x: x IS NOT NULL), '|')"""


@query(f"+ {ACCURACY}\nSELECT image_id, {RECOMMENDED} AS recommendations FROM rel")
def recommendations(v: Views) -> DataFrame:
    return metrics.accuracy(v.detections, v.images).select("image_id", joined("recommendations").alias("recommendations"))


@query(f"+ {ACCURACY}\nSELECT image_id, n::BIGINT AS total_detections, round(a, 9) AS average_confidence, n_over::BIGINT AS bbox_overlaps, round(s, 6) AS reliability_score, {RECOMMENDED} AS recommendations FROM rel")
def accuracy_report(v: Views) -> DataFrame:
    d = reports.accuracy_report(v.detections, v.images)
    return d.select("image_id", "overall.total_detections", F.round("overall.average_confidence", 9).alias("average_confidence"), "spatial.bbox_overlaps", F.round("reliability_score", 6).alias("reliability_score"), joined("recommendations").alias("recommendations"))


@query(f"+ {PAIRS}\nSELECT image_id, a_id, b_id, round(iou, 9) AS iou FROM p")
def overlap_pairs(v: Views) -> DataFrame:
    return rounded(pairs.overlap_pairs(v.detections), "iou", digits=9)


@query(f"+ {PAIRS}\nSELECT image_id, count(a_id)::BIGINT AS overlaps FROM images LEFT JOIN p USING (image_id) GROUP BY image_id")
def overlap_counts(v: Views) -> DataFrame:
    return pairs.overlap_counts(v.detections)


@query("""SELECT a.image_id, a.det_id AS a_id, b.det_id AS b_id, (greatest(a.x1, b.x1) + least(a.x2, b.x2)) / 2 AS x, (greatest(a.y1, b.y1) + least(a.y2, b.y2)) / 2 AS y
FROM detections a JOIN detections b ON a.image_id = b.image_id AND a.det_id < b.det_id AND NOT (a.x2 < b.x1 OR b.x2 < a.x1 OR a.y2 < b.y1 OR b.y2 < a.y1) WHERE a.class_id = 1 AND b.class_id = 1""")
def bbox_junctions_raw(v: Views) -> DataFrame:
    return pairs.box_junctions(v.detections.filter("class_id = 1"))


CONNECTED = """con AS (SELECT w.image_id, w.wall_seq, min(CASE WHEN sqrt((w.sx - j.x) ** 2 + (w.sy - j.y) ** 2) <= 10 THEN j_seq END) AS start_junction,
  min(CASE WHEN sqrt((w.ex - j.x) ** 2 + (w.ey - j.y) ** 2) <= 10 THEN j_seq END) AS end_junction FROM walls w LEFT JOIN junctions j USING (image_id) GROUP BY 1, 2)"""


@query(f"+ {CONNECTED}\nSELECT image_id, wall_seq::INTEGER AS wall_seq, start_junction::INTEGER AS start_junction, end_junction::INTEGER AS end_junction FROM con")
def wall_connections(v: Views) -> DataFrame:
    return pairs.wall_connections(v.walls, v.junctions)


JTYPES = f"""{CONNECTED},
jw AS (SELECT DISTINCT image_id, unnest([start_junction, end_junction]) AS j_seq, wall_seq FROM con),
jt AS (SELECT j.image_id, j.j_seq, count(wall_seq) AS n, string_agg(wall_seq::VARCHAR, '|' ORDER BY wall_seq) AS walls FROM junctions j LEFT JOIN jw USING (image_id, j_seq) GROUP BY 1, 2)"""


@query(f"""+ {JTYPES}
SELECT image_id, j_seq::INTEGER AS j_seq, n::BIGINT AS wall_count, coalesce(walls, '') AS connected_walls,
  CASE WHEN n = 2 THEN 'corner' WHEN n = 3 THEN 'T_junction' WHEN n = 4 THEN 'cross_junction' WHEN n > 4 THEN 'complex_junction' ELSE 'unknown' END AS junction_type FROM jt""")
def junction_types(v: Views) -> DataFrame:
    d = pairs.junction_types(v.junctions, pairs.wall_connections(v.walls, v.junctions))
    return d.withColumn("connected_walls", joined("connected_walls"))


@query("""SELECT image_id, det_id FROM detections w WHERE class_id = 1 AND NOT EXISTS (SELECT 1 FROM detections d WHERE d.image_id = w.image_id AND d.class_id = 3
  AND greatest(0, least(w.x2, d.x2) - greatest(w.x1, d.x1)) * greatest(0, least(w.y2, d.y2) - greatest(w.y1, d.y1)) / greatest(1, (w.x2 - w.x1) * (w.y2 - w.y1)) > 0.35::DOUBLE)""")
def uncovered_walls(v: Views) -> DataFrame:
    return pairs.uncovered_walls(v.detections.filter("class_id = 1"), v.detections.filter("class_id = 3")).select("image_id", "det_id")


@query(f"SELECT a.image_id, a.gt_id AS a_id, b.pred_id AS b_id, round({AB}, 9) AS iou FROM gt a JOIN pred b USING (image_id)")
def iou_matrix(v: Views) -> DataFrame:
    return rounded(pairs.iou_matrix(v.gt.withColumnRenamed("gt_id", "det_id"), v.pred.withColumnRenamed("pred_id", "det_id")), "iou", digits=9)


def nms_sql(source: str, group: str, iou: str = "0.3") -> str:
    k = IOU.format(a="k", b="r")
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, det_id) AS rn FROM {source}),
s AS (SELECT {group}, 1::BIGINT AS rn, [{{'det_id': det_id, 'y1': y1, 'x1': x1, 'y2': y2, 'x2': x2}}] AS kept FROM r WHERE rn = 1
  UNION ALL SELECT {", ".join(f"r.{x.strip()}" for x in group.split(","))}, r.rn, CASE WHEN len(list_filter(s.kept, lambda k: {k} > {iou}::DOUBLE)) > 0 THEN s.kept
    ELSE list_append(s.kept, {{'det_id': r.det_id, 'y1': r.y1, 'x1': r.x1, 'y2': r.y2, 'x2': r.x2}}) END
  FROM s JOIN r ON {" AND ".join(f"r.{x.strip()} = s.{x.strip()}" for x in group.split(","))} AND r.rn = s.rn + 1),
kept AS (SELECT {group}, unnest(kept).det_id AS det_id FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY rn DESC) AS last FROM s) WHERE last = 1)"""


@query(f"+ {nms_sql('detections', 'image_id, class_id')}\nSELECT image_id, class_id, det_id FROM kept", recursive=True)
def nms_per_class(v: Views) -> DataFrame:
    return suppress.suppress_boxes(v.detections).select("image_id", "class_id", "det_id")


@query(f"+ good AS (SELECT * FROM detections WHERE score >= 0.15::DOUBLE),\n{nms_sql('good', 'image_id, class_id')}\nSELECT image_id, class_id, det_id FROM (SELECT k.*, row_number() OVER (PARTITION BY k.image_id ORDER BY score DESC, det_id) AS n FROM kept k JOIN detections d USING (det_id)) WHERE n <= 20", recursive=True)
def refine_detections(v: Views) -> DataFrame:
    return suppress.refine_detections(v.detections, k=20).select("image_id", "class_id", "det_id")


@query()
def detector_output(v: Views) -> DataFrame:
    """As :func:`refine_detections`, with the reference's 100 of an image."""
    return suppress.refine_detections(v.detections).select("image_id", "class_id", "det_id")


@query("SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS n FROM detections) WHERE n <= 10")
def topk_detections(v: Views) -> DataFrame:
    return suppress.top_detections(v.detections, 10).select("image_id", "det_id")


@query("""+ r AS (SELECT image_id, j_seq, x, y FROM junctions),
s AS (SELECT image_id, 1::BIGINT AS n, [{'j': j_seq, 'x': x, 'y': y}] AS kept FROM r WHERE j_seq = 1
  UNION ALL SELECT r.image_id, r.j_seq, CASE WHEN len(list_filter(s.kept, lambda k: sqrt((k.x - r.x) ** 2 + (k.y - r.y) ** 2) < 150)) > 0 THEN s.kept ELSE list_append(s.kept, {'j': r.j_seq, 'x': r.x, 'y': r.y}) END
  FROM s JOIN r ON r.image_id = s.image_id AND r.j_seq = s.n + 1)
SELECT image_id, unnest(kept).j::INTEGER AS j_seq FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC) AS last FROM s) WHERE last = 1""", recursive=True)
def junction_dedup(v: Views) -> DataFrame:
    return suppress.dedup_points(v.junctions.withColumnRenamed("j_seq", "p_id"), 150.0, F.col("p_id")).select("image_id", F.col("p_id").alias("j_seq"))


FOLD = "CASE WHEN {0} < 0 THEN {0} + 180 ELSE {0} END"
MEASURED = f"""{CONNECTED},
wm AS (SELECT image_id, wall_seq, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) * mm_per_px AS length, thickness_avg * mm_per_px AS thickness, degrees(atan2(ey - sy, ex - sx)) AS deg,
  least(sx, ex) * mm_per_px AS x1, least(sy, ey) * mm_per_px AS y1, greatest(sx, ex) * mm_per_px AS x2, greatest(sy, ey) * mm_per_px AS y2, width * mm_per_px AS w, height * mm_per_px AS h FROM walls JOIN images USING (image_id)),
nb AS (SELECT *, x1 <= w * 0.03::DOUBLE AS l, x2 >= w - w * 0.03::DOUBLE AS r, y1 <= h * 0.03::DOUBLE AS t, y2 >= h - h * 0.03::DOUBLE AS b FROM wm JOIN con USING (image_id, wall_seq)),
ext AS (SELECT *, {notes_sql(("l", "left_boundary"), ("r", "right_boundary"), ("t", "top_boundary"), ("b", "bottom_boundary"), ("NOT (l OR r OR t OR b) AND start_junction IS NULL AND end_junction IS NULL", "unconnected"), ("(l OR r OR t OR b) AND length > 150", "long_boundary_wall"), ("(l OR r) AND abs(y2 - y1) > h * 0.3::DOUBLE", "spans_vertical_edge"), ("(t OR b) AND abs(x2 - x1) > w * 0.3::DOUBLE", "spans_horizontal_edge"))} AS reasons FROM nb)"""


@query(f"+ {MEASURED}\nSELECT image_id, wall_seq::INTEGER AS wall_seq, reasons AS exterior_reasons, reasons <> '' AS is_exterior FROM ext")
def exterior_walls(v: Views) -> DataFrame:
    d = reports.connected_walls(v.walls, v.junctions, v.images)
    return d.select("image_id", "wall_seq", joined("exterior_reasons").alias("exterior_reasons"), "is_exterior")


@query(f"""+ {MEASURED},
l AS (SELECT image_id, list_sort(list(length), 'DESC') AS l, sum(length) AS s, count(*) AS n, count(*) FILTER (l) AS left_n, count(*) FILTER (r) AS right_n, count(*) FILTER (t) AS top_n, count(*) FILTER (b) AS bottom_n FROM ext WHERE reasons <> '' GROUP BY image_id)
SELECT image_id, round(s, 6) AS total_perimeter_length, n::BIGINT AS exterior_wall_count, CASE WHEN n >= 4 THEN l[1] * l[2] ELSE 0 END AS perimeter_area, round(s / n, 6) AS average_exterior_wall_length,
  left_n::BIGINT AS "left", right_n::BIGINT AS "right", top_n::BIGINT AS top, bottom_n::BIGINT AS bottom FROM l""")
def perimeter(v: Views) -> DataFrame:
    exterior = reports.connected_walls(v.walls, v.junctions, v.images).filter("is_exterior")
    return rounded(metrics.perimeter(exterior, by_boundary=True), "total_perimeter_length", "average_exterior_wall_length")


@query(f"""+ {JTYPES.replace(CONNECTED, MEASURED)},
m AS (SELECT *, avg(length) OVER (PARTITION BY image_id) AS mean, {FOLD.format("deg")} AS o FROM nb),
a AS (SELECT image_id, stddev_pop(thickness) AS sd, count(*) FILTER (length > mean * 1.5::DOUBLE) AS lw, count(*) FILTER (start_junction IS NULL AND end_junction IS NULL) AS alone, count(*) FILTER (o <= 30 OR o >= 150) AS h, count(*) FILTER (o BETWEEN 60 AND 120) AS v FROM m GROUP BY image_id),
b AS (SELECT image_id, count(*) AS busy FROM jt WHERE n > 3 GROUP BY image_id)
SELECT image_id, array_to_string(list_filter([CASE WHEN sd < 2 THEN 'Consistent wall thickness throughout floor plan' ELSE 'Variable wall thickness detected - may indicate different wall types' END,
  CASE WHEN lw > 0 THEN 'Found ' || lw || ' notably long walls - potential load-bearing structures' END, CASE WHEN busy > 0 THEN 'Found ' || busy || ' complex junctions with 4+ walls' END,
  CASE WHEN alone > 0 THEN 'Found ' || alone || ' isolated wall segments' END,
  CASE WHEN h > v * 1.5::DOUBLE THEN 'Predominantly horizontal wall layout' WHEN v > h * 1.5::DOUBLE THEN 'Predominantly vertical wall layout' ELSE 'Balanced horizontal and vertical wall layout' END], lambda x: x IS NOT NULL), '|') AS insights
FROM a LEFT JOIN b USING (image_id)""")
def wall_insights(v: Views) -> DataFrame:
    connected = pairs.wall_connections(v.walls, v.junctions)
    walls = reports.connected_walls(v.walls, v.junctions, v.images)
    return metrics.wall_insights(walls, pairs.junction_types(v.junctions, connected), v.images).select("image_id", joined("insights").alias("insights"))


@query("""+ d AS (SELECT image_id, det_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, y2 - y1 > x2 - x1 AS vert, width, height FROM detections JOIN images USING (image_id) WHERE class_id = 3),
c AS (SELECT a.image_id, count(*) AS n FROM d a JOIN d b ON a.image_id = b.image_id AND a.det_id < b.det_id WHERE sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) < least(a.width, a.height) * 0.2::DOUBLE GROUP BY 1),
s AS (SELECT image_id, count(*) FILTER (vert) AS v, count(*) FILTER (NOT vert) AS h, count(*) FILTER (x < width * 0.1::DOUBLE OR x > width * 0.9::DOUBLE OR y < height * 0.1::DOUBLE OR y > height * 0.9::DOUBLE) AS e FROM d GROUP BY image_id)
SELECT image_id, CASE WHEN v IS NULL THEN 'No doors detected for layout analysis' ELSE array_to_string(list_filter([CASE WHEN n > 0 THEN 'Found ' || n || ' pairs of doors in close proximity' END,
  CASE WHEN h > v THEN 'Predominantly horizontal door layout' WHEN v > h THEN 'Predominantly vertical door layout' ELSE 'Mixed door orientation layout' END,
  CASE WHEN e > 0 THEN e || ' doors positioned near floor plan boundaries' END], lambda x: x IS NOT NULL), '|') END AS insights FROM images LEFT JOIN s USING (image_id) LEFT JOIN c USING (image_id)""")
def door_insights(v: Views) -> DataFrame:
    doors = v.detections.filter("class_id = 3")
    return metrics.door_insights(doors, pairs.close_doors(doors, v.images), v.images).select("image_id", joined("insights").alias("insights"))


@query("""SELECT path_id, round(coalesce(sum(d), 0), 6) AS length FROM (SELECT path_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM path_points WINDOW w AS (PARTITION BY path_id ORDER BY pos)) GROUP BY path_id""")
def path_length(v: Views) -> DataFrame:
    return rounded(paths.path_length(v.path_points), "length")


@query(f"""+ e AS (SELECT path_id, degrees(atan2(arg_max(y, pos) - arg_min(y, pos), arg_max(x, pos) - arg_min(x, pos))) AS d FROM path_points GROUP BY path_id),
f AS (SELECT path_id, {FOLD.format("d")} AS f FROM e) SELECT path_id, round(CASE WHEN f >= 180 THEN f - 180 ELSE f END, 6) AS orientation_degrees FROM f""")
def path_orientation(v: Views) -> DataFrame:
    return rounded(paths.path_orientation(v.path_points), "orientation_degrees")


@query("""SELECT path_id, pos::INTEGER AS pos, round(CASE WHEN n < 3 THEN x ELSE ax END, 6) AS x, round(CASE WHEN n < 3 THEN y ELSE ay END, 6) AS y FROM (SELECT *, count(*) OVER (PARTITION BY path_id) AS n,
  avg(x) OVER w AS ax, avg(y) OVER w AS ay FROM path_points WINDOW w AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))""")
def path_smooth(v: Views) -> DataFrame:
    return rounded(paths.smooth_path(v.path_points), "x", "y")


@query("""SELECT det_id, round(y1 / (height - 1), 9) AS y1, round(x1 / (width - 1), 9) AS x1, round((y2 - 1) / (height - 1), 9) AS y2, round((x2 - 1) / (width - 1), 9) AS x2,
  round_even(y1 / (height - 1) * (height - 1), 0) AS py1, round_even((x2 - 1) / (width - 1) * (width - 1) + 1, 0) AS px2 FROM detections JOIN images USING (image_id)""")
def norm_denorm_boxes(v: Views) -> DataFrame:
    unit = g.normalised(g.box(), F.col("height"), F.col("width"))
    back = g.denormalised(unit, F.col("height"), F.col("width"))
    return v.detections.join(v.images, "image_id").select("det_id", *[F.round(x, 9).alias(k) for k, x in unit._asdict().items()], back.y1.alias("py1"), back.x2.alias("px2"))


@query("""SELECT det_id, round(cy - h / 2, 6) AS y1, round(cx - w / 2, 6) AS x1, round(cy + h / 2, 6) AS y2, round(cx + w / 2, 6) AS x2 FROM (SELECT det_id, y1 + (y2 - y1) / 2 + 0.1::DOUBLE * (y2 - y1) AS cy,
  x1 + (x2 - x1) / 2 - 0.2::DOUBLE * (x2 - x1) AS cx, (y2 - y1) * exp(0.3::DOUBLE) AS h, (x2 - x1) * exp(-0.4::DOUBLE) AS w FROM detections)""")
def apply_deltas(v: Views) -> DataFrame:
    moved = g.with_deltas(g.box(), F.lit(0.1), F.lit(-0.2), F.lit(0.3), F.lit(-0.4))
    return v.detections.select("det_id", *[F.round(x, 6).alias(k) for k, x in moved._asdict().items()])


@query("""SELECT pred_id, round(((t.y1 + t.y2) / 2 - (p.y1 + p.y2) / 2) / (p.y2 - p.y1), 6) AS dy, round(((t.x1 + t.x2) / 2 - (p.x1 + p.x2) / 2) / (p.x2 - p.x1), 6) AS dx,
  round(ln((t.y2 - t.y1) / (p.y2 - p.y1)), 6) + 0 AS dh, round(ln((t.x2 - t.x1) / (p.x2 - p.x1)), 6) + 0 AS dw FROM pred p JOIN gt t ON p.pred_id = t.gt_id""")
def box_refinement(v: Views) -> DataFrame:
    p, t_ = v.pred.alias("p"), v.gt.alias("t")
    d = g.deltas(g.box("p."), g.box("t."))
    return p.join(t_, F.col("p.pred_id") == F.col("t.gt_id")).select("pred_id", *[(F.round(x, 6) + 0).alias(k) for k, x in zip(("dy", "dx", "dh", "dw"), d, strict=True)])


@query("""SELECT det_id, least(5, greatest(2, (4 + round_even(log2(sqrt(h * w) / (224::DOUBLE / sqrt(width * height))), 0))::INTEGER)) AS level
FROM (SELECT det_id, (y2 - y1) / height AS h, (x2 - x1) / width AS w, width, height FROM detections JOIN images USING (image_id))""")
def fpn_level(v: Views) -> DataFrame:
    w, h = size()
    level = g.fpn_level(h / F.col("height"), w / F.col("width"), F.col("width") * F.col("height"))
    return v.detections.join(v.images, "image_id").select("det_id", level.alias("level"))


@query("SELECT image_id, stride, ceil(height / stride)::BIGINT AS rows, ceil(width / stride)::BIGINT AS cols FROM images CROSS JOIN (SELECT unnest([4, 8, 16, 32, 64]) AS stride)")
def backbone_shapes(v: Views) -> DataFrame:
    return evaluate.backbone_shapes(v.images)


@query("""SELECT image_id, ratio, r AS row, k AS col, round(r * 64 - 512 / sqrt(ratio) / 2, 6) AS y1, round(k * 64 - 512 * sqrt(ratio) / 2, 6) AS x1, round(r * 64 + 512 / sqrt(ratio) / 2, 6) AS y2, round(k * 64 + 512 * sqrt(ratio) / 2, 6) AS x2
FROM (SELECT image_id, unnest(range(ceil(height / 64)::INTEGER))::INTEGER AS r, width FROM images) JOIN (SELECT unnest(range(18))::INTEGER AS k) ON k < ceil(width / 64) CROSS JOIN (SELECT unnest([0.5::DOUBLE, 1, 2]) AS ratio)""")
def anchors(v: Views) -> DataFrame:
    return evaluate.anchor_boxes(evaluate.backbone_shapes(v.images, (64,)), {64: 512.0}, digits=6).drop("stride")


@query()
def anchor_pyramid(v: Views) -> DataFrame:
    """The boxes of all five levels; :func:`anchors` has the coarsest one."""
    return evaluate.anchor_boxes(evaluate.backbone_shapes(v.images), {4: 32.0, 8: 64.0, 16: 128.0, 32: 256.0, 64: 512.0}, digits=6)


MATCH = f"""cand AS (SELECT a.image_id, a.pred_id, b.gt_id, row_number() OVER (PARTITION BY a.image_id ORDER BY a.score DESC, a.pred_id, {AB} DESC, b.gt_id) AS rn
  FROM pred a JOIN gt b ON a.image_id = b.image_id AND a.class_id = b.class_id WHERE {AB} >= 0.5::DOUBLE),
st AS (SELECT image_id, rn, [pred_id] AS ps, [gt_id] AS gs FROM cand WHERE rn = 1
  UNION ALL SELECT c.image_id, c.rn, CASE WHEN list_contains(ps, c.pred_id) OR list_contains(gs, c.gt_id) THEN ps ELSE list_append(ps, c.pred_id) END,
    CASE WHEN list_contains(ps, c.pred_id) OR list_contains(gs, c.gt_id) THEN gs ELSE list_append(gs, c.gt_id) END FROM st s JOIN cand c ON c.image_id = s.image_id AND c.rn = s.rn + 1),
fin AS (SELECT image_id, unnest(ps) AS pred_id, unnest(gs) AS gt_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) AS last FROM st) WHERE last = 1),
mt AS (SELECT p.image_id, p.pred_id, p.class_id, p.score, f.gt_id FROM pred p LEFT JOIN fin f USING (image_id, pred_id)),
ng AS (SELECT image_id, count(*) AS n FROM gt GROUP BY image_id),
pr AS (SELECT image_id, rn AS rank, hits / rn AS precision, hits / n AS recall FROM (SELECT image_id, row_number() OVER w AS rn, sum((gt_id IS NOT NULL)::INTEGER) OVER w AS hits FROM mt WINDOW w AS (PARTITION BY image_id ORDER BY score DESC, pred_id ROWS UNBOUNDED PRECEDING)) JOIN ng USING (image_id))"""


@query(f"+ {MATCH}\nSELECT image_id, pred_id, gt_id FROM mt", recursive=True)
def greedy_match(v: Views) -> DataFrame:
    return evaluate.greedy_matches(v.gt, v.pred).select("image_id", "pred_id", "gt_id")


@query(f"+ {MATCH}\nSELECT image_id, rank::BIGINT AS rank, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr", recursive=True)
def precision_recall(v: Views) -> DataFrame:
    return rounded(evaluate.precision_recall(evaluate.greedy_matches(v.gt, v.pred), v.gt), "precision", "recall", digits=9)


@query(f"""+ {MATCH},
en AS (SELECT image_id, max(precision) OVER (PARTITION BY image_id ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) * (recall - coalesce(lag(recall) OVER (PARTITION BY image_id ORDER BY rank), 0)) AS a FROM pr)
SELECT image_id, round(coalesce(sum(a), 0), 6) AS ap FROM ng LEFT JOIN en USING (image_id) GROUP BY image_id""", recursive=True)
def average_precision(v: Views) -> DataFrame:
    return rounded(evaluate.average_precision(evaluate.greedy_matches(v.gt, v.pred), v.gt), "ap")


@query(f"""+ th AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS th),
cand AS (SELECT th, image_id, pred_id, gt_id, row_number() OVER (PARTITION BY th, image_id ORDER BY score DESC, pred_id, iou DESC, gt_id) AS rn
  FROM (SELECT a.image_id, a.pred_id, a.score, b.gt_id, {AB} AS iou FROM pred a JOIN gt b ON a.image_id = b.image_id AND a.class_id = b.class_id) JOIN th ON iou >= th),
st AS (SELECT th, image_id, rn, [pred_id] AS ps, [gt_id] AS gs FROM cand WHERE rn = 1
  UNION ALL SELECT c.th, c.image_id, c.rn, CASE WHEN list_contains(ps, c.pred_id) OR list_contains(gs, c.gt_id) THEN ps ELSE list_append(ps, c.pred_id) END,
    CASE WHEN list_contains(ps, c.pred_id) OR list_contains(gs, c.gt_id) THEN gs ELSE list_append(gs, c.gt_id) END FROM st s JOIN cand c ON c.th = s.th AND c.image_id = s.image_id AND c.rn = s.rn + 1),
fin AS (SELECT th, image_id, unnest(ps) AS pred_id FROM (SELECT *, row_number() OVER (PARTITION BY th, image_id ORDER BY rn DESC) AS last FROM st) WHERE last = 1),
mt AS (SELECT th.th, p.image_id, p.pred_id, p.score, f.pred_id IS NOT NULL AS hit FROM pred p CROSS JOIN th LEFT JOIN fin f ON f.th = th.th AND f.image_id = p.image_id AND f.pred_id = p.pred_id),
ng AS (SELECT image_id, count(*) AS n FROM gt GROUP BY image_id),
pr AS (SELECT th, image_id, rn AS rank, hits / rn AS precision, hits / n AS recall FROM (SELECT th, image_id, row_number() OVER w AS rn, sum(hit::INTEGER) OVER w AS hits FROM mt WINDOW w AS (PARTITION BY th, image_id ORDER BY score DESC, pred_id ROWS UNBOUNDED PRECEDING)) JOIN ng USING (image_id)),
en AS (SELECT image_id, max(precision) OVER (PARTITION BY th, image_id ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) * (recall - coalesce(lag(recall) OVER (PARTITION BY th, image_id ORDER BY rank), 0)) AS a FROM pr)
SELECT image_id, round(coalesce(sum(a), 0) / 10, 6) AS ap FROM ng LEFT JOIN en USING (image_id) GROUP BY image_id""", recursive=True)
def ap_range(v: Views) -> DataFrame:
    return rounded(evaluate.ap_over_thresholds(v.gt, v.pred), "ap")


@query(f"""+ b AS (SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id) AS n FROM (SELECT a.image_id, a.pred_id, b.gt_id, {AB} AS iou FROM pred a JOIN gt b USING (image_id)))
SELECT g.image_id, round(count(DISTINCT b.gt_id) / g.n, 6) AS recall FROM (SELECT image_id, count(*) AS n FROM gt GROUP BY 1) g LEFT JOIN b ON b.image_id = g.image_id AND b.n = 1 AND b.iou >= 0.5::DOUBLE GROUP BY g.image_id, g.n""")
def recall_at_iou(v: Views) -> DataFrame:
    return rounded(evaluate.recall_at(v.gt, v.pred), "recall")


@query(f"""+ b AS (SELECT *, row_number() OVER (PARTITION BY image_id, roi_id ORDER BY iou DESC, gt_id) AS n FROM (SELECT a.image_id, a.pred_id AS roi_id, b.gt_id, {AB} AS iou FROM pred a JOIN gt b USING (image_id)))
SELECT p.image_id, p.pred_id AS roi_id, b.gt_id, round(coalesce(iou, 0), 9) AS iou, coalesce(iou, 0) >= 0.5::DOUBLE AS positive FROM pred p LEFT JOIN b ON b.roi_id = p.pred_id AND b.n = 1""")
def roi_assignment(v: Views) -> DataFrame:
    return rounded(evaluate.assign_rois(v.pred.withColumnRenamed("pred_id", "roi_id"), v.gt), "iou", digits=9)


@query(f"""+ pa AS (SELECT a.image_id, a.pred_id AS anchor_id, b.gt_id, {AB} AS iou FROM pred a JOIN gt b USING (image_id)),
f AS (SELECT DISTINCT anchor_id FROM (SELECT anchor_id, iou, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, anchor_id) AS n FROM pa) WHERE n = 1 AND iou > 0),
m AS (SELECT anchor_id, max(iou) AS iou FROM pa GROUP BY 1)
SELECT p.image_id, p.pred_id AS anchor_id, CASE WHEN f.anchor_id IS NOT NULL OR coalesce(iou, 0) >= 0.7::DOUBLE THEN 1 WHEN coalesce(iou, 0) < 0.3::DOUBLE THEN -1 ELSE 0 END AS label
FROM pred p LEFT JOIN m ON m.anchor_id = p.pred_id LEFT JOIN f ON f.anchor_id = p.pred_id""")
def anchor_assignment(v: Views) -> DataFrame:
    return evaluate.assign_anchors(v.pred.withColumnRenamed("pred_id", "anchor_id"), v.gt)


@query("SELECT image_id, det_id, sum(x_end - x_start)::BIGINT AS area, min(y) AS y1, min(x_start) AS x1, max(y) + 1 AS y2, max(x_end) AS x2 FROM mask_runs GROUP BY 1, 2")
def mask_area_bbox(v: Views) -> DataFrame:
    return masks.mask_boxes(v.mask_runs)


PIXELS = "px AS (SELECT DISTINCT image_id, class_id, y, unnest(range(x_start, x_end)) AS x FROM mask_runs)"
ISLANDS = "SELECT image_id, y, min(x) AS x_start, max(x) + 1 AS x_end FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM {0}) GROUP BY image_id, y, k"


@query("""+ i AS (SELECT a.image_id, a.det_id AS a_id, b.det_id AS b_id, sum(least(a.x_end, b.x_end) - greatest(a.x_start, b.x_start)) AS n FROM mask_runs a JOIN mask_runs b USING (image_id, y)
  WHERE a.class_id = 1 AND b.class_id = 2 AND a.x_start < b.x_end AND b.x_start < a.x_end GROUP BY 1, 2, 3), s AS (SELECT det_id, sum(x_end - x_start) AS n FROM mask_runs GROUP BY 1)
SELECT i.image_id, a_id, b_id, round(i.n / (a.n + b.n - i.n), 9) AS iou FROM i JOIN s a ON a.det_id = a_id JOIN s b ON b.det_id = b_id""")
def mask_iou(v: Views) -> DataFrame:
    return rounded(masks.mask_iou(v.mask_runs.filter("class_id = 1"), v.mask_runs.filter("class_id = 2")), "iou", digits=9)


@query(f"+ {PIXELS}, u AS (SELECT DISTINCT image_id, y, x FROM px)\n{ISLANDS.format('u')}")
def mask_union(v: Views) -> DataFrame:
    return masks.union_runs(v.mask_runs)


@query(f"+ {PIXELS}, u AS (SELECT image_id, y, x FROM px WHERE class_id = 1 EXCEPT SELECT image_id, y, x FROM px WHERE class_id <> 1)\n{ISLANDS.format('u')}")
def mask_except(v: Views) -> DataFrame:
    return masks.except_runs(v.mask_runs.filter("class_id = 1"), v.mask_runs.filter("class_id <> 1"))


@query(f"+ {PIXELS}, u AS (SELECT image_id, y, x FROM px WHERE class_id = 1 INTERSECT SELECT image_id, y, x FROM px WHERE class_id <> 1)\n{ISLANDS.format('u')}")
def mask_intersect(v: Views) -> DataFrame:
    return masks.intersect_runs(v.mask_runs.filter("class_id = 1"), v.mask_runs.filter("class_id <> 1"))


@query(f"""+ g AS (SELECT image_id, y + unnest(range(-2, 3)) AS y, x_start - 2 AS a, x_end + 1 AS b FROM mask_runs WHERE class_id = 3),
u AS (SELECT DISTINCT image_id, y, unnest(range(greatest(a, 0), least(b, 1120))) AS x FROM g WHERE y >= 0 AND y < 1120)\n{ISLANDS.format('u')}""")
def rect_dilate(v: Views) -> DataFrame:
    return masks.dilate_runs(v.mask_runs.filter("class_id = 3"), v.images, 5, 4)


# two dilations inside an image that holds all runs are one of both reaches
@query(f"""+ g AS (SELECT image_id, y + unnest(range(-24, 25)) AS y, x_start - 24 AS a, x_end + 24 AS b FROM mask_runs WHERE class_id = 3
  UNION ALL SELECT image_id, y + unnest(range(-15, 14)), x_start - 15, x_end + 13 FROM mask_runs WHERE class_id = 2
  UNION ALL SELECT image_id, unnest(range(greatest(y1::BIGINT - m, 0), least(y2::BIGINT + m, 1120))), x1::BIGINT - m, x2::BIGINT + m FROM (SELECT *, CASE class_id WHEN 3 THEN 40 ELSE 25 END AS m FROM detections WHERE class_id IN (2, 3))),
px AS (SELECT DISTINCT image_id, y, unnest(range(x_start, x_end)) AS x FROM mask_runs WHERE class_id = 1),
u AS (SELECT * FROM px WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.image_id = px.image_id AND g.y = px.y AND px.x >= g.a AND px.x < g.b))\n{ISLANDS.format('u')}""")
def clean_wall_mask(v: Views) -> DataFrame:
    return masks.clean_walls(v.mask_runs, v.detections, v.images)


CROSS = """+ s AS (SELECT image_id, seg_id, x1, y1, x2, y2 FROM segments),
p AS (SELECT a.image_id, a.seg_id AS a_id, b.seg_id AS b_id, a.x1 AS ax, a.y1 AS ay, a.x2 - a.x1 AS adx, a.y2 - a.y1 AS ady, (a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2) AS det,
  (a.x1 - b.x1) * (b.y1 - b.y2) - (a.y1 - b.y1) * (b.x1 - b.x2) AS tn, (a.x1 - b.x1) * (a.y1 - a.y2) - (a.y1 - b.y1) * (a.x1 - a.x2) AS un
  FROM s a JOIN s b ON a.image_id = b.image_id AND a.seg_id < b.seg_id)
SELECT image_id, a_id, b_id, round(ax + tn / det * adx, 6) AS x, round(ay + tn / det * ady, 6) AS y FROM p WHERE abs(det) >= 1e-10 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1"""


@query(CROSS)
def segment_intersections(v: Views) -> DataFrame:
    a, b = v.segments.alias("a"), v.segments.alias("b")
    segment = lambda p: g.Segment(*(F.col(f"{p}.{k}") for k in ("x1", "y1", "x2", "y2")))
    at = g.crossing_point(segment("a"), segment("b"))
    both = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.seg_id") < F.col("b.seg_id")) & g.segments_meet(segment("a"), segment("b")))
    return rounded(both.select("a.image_id", F.col("a.seg_id").alias("a_id"), F.col("b.seg_id").alias("b_id"), at["x"].alias("x"), at["y"].alias("y")), "x", "y")


PART = "{{'x1': {0}, 'y1': {1}, 'x2': {2}, 'y2': {3}}}"
WHOLE, HEAD, TAIL = PART.format("x1", "y1", "x2", "y2"), PART.format("x1", "y1", "lo.x", "lo.y"), PART.format("hi.x", "hi.y", "x2", "y2")


@query(f"""+ e AS (SELECT s.image_id, s.seg_id, s.x1, s.y1, s.x2, s.y2, w.det_id, w.x1 - 6 AS bx1, w.y1 - 6 AS by1, w.x2 + 6 AS bx2, w.y2 + 6 AS by2 FROM segments s JOIN detections w ON w.image_id = s.image_id AND w.class_id = 2),
i AS (SELECT *, x1 BETWEEN bx1 AND bx2 AND y1 BETWEEN by1 AND by2 AS a_in, x2 BETWEEN bx1 AND bx2 AND y2 BETWEEN by1 AND by2 AS b_in FROM e),
k AS (SELECT *, CASE WHEN n IN (0, 3) THEN bx1 ELSE bx2 END AS ex1, CASE WHEN n IN (0, 1) THEN by1 ELSE by2 END AS ey1, CASE WHEN n IN (2, 3) THEN bx1 ELSE bx2 END AS ex2, CASE WHEN n IN (0, 3) THEN by1 ELSE by2 END AS ey2 FROM i, range(4) r(n)),
c AS (SELECT *, (x1 - x2) * (ey1 - ey2) - (y1 - y2) * (ex1 - ex2) AS det, (x1 - ex1) * (ey1 - ey2) - (y1 - ey1) * (ex1 - ex2) AS tn, (x1 - ex1) * (y1 - y2) - (y1 - ey1) * (x1 - x2) AS un FROM k),
p AS (SELECT *, x1 + tn / det * (x2 - x1) AS px, y1 + tn / det * (y2 - y1) AS py FROM c WHERE abs(det) >= 1e-10 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1),
h AS (SELECT seg_id, det_id, count(*) AS n, min(hit) AS lo, max(hit) AS hi FROM (SELECT *, {{'d': sqrt((px - x1) * (px - x1) + (py - y1) * (py - y1)), 'x': px, 'y': py}} AS hit FROM p) GROUP BY 1, 2),
f AS (SELECT i.*, n, lo, hi, row_number() OVER (PARTITION BY seg_id ORDER BY det_id) AS k FROM i LEFT JOIN h USING (seg_id, det_id) WHERE a_in OR b_in OR n IS NOT NULL),
q AS (SELECT s.image_id, s.seg_id, s.x1, s.y1, s.x2, s.y2, det_id, a_in, b_in, n, lo, hi FROM segments s LEFT JOIN (FROM f WHERE k = 1) USING (seg_id)),
t AS (SELECT image_id, seg_id, CASE WHEN det_id IS NULL THEN [{WHOLE}] ELSE list_filter(CASE WHEN n IS NULL AND a_in AND b_in THEN [] WHEN n IS NULL THEN [{WHOLE}] WHEN n BETWEEN 2 AND 4 AND hi.d - lo.d > 1 THEN [{HEAD}, {TAIL}]
  WHEN a_in AND NOT b_in THEN [{TAIL}] WHEN b_in AND NOT a_in THEN [{HEAD}] WHEN NOT a_in AND NOT b_in THEN [{WHOLE}] ELSE [] END, lambda v: sqrt((v.x2 - v.x1) * (v.x2 - v.x1) + (v.y2 - v.y1) * (v.y2 - v.y1)) > 2) END AS ps FROM q)
SELECT image_id, seg_id, part, round(v.x1, 6) AS x1, round(v.y1, 6) AS y1, round(v.x2, 6) AS x2, round(v.y2, 6) AS y2 FROM (SELECT image_id, seg_id, generate_subscripts(ps, 1) - 1 AS part, unnest(ps) AS v FROM t)""")
def split_around_windows(v: Views) -> DataFrame:
    return rounded(segments.split_around_windows(v.segments, v.detections.filter("class_id = 2")), "x1", "y1", "x2", "y2")


TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda r: upper(r[1]) || lower(r[2:])), '')"
HANGUL = "[\\x{AC00}-\\x{D7A3}\\x{3130}-\\x{318F}]"


@query(f"""+ a AS (SELECT DISTINCT text, regexp_replace(trim(text), '[^\\p{{L}}\\p{{N}}_\\s/\\-]', '', 'g') AS p FROM text_regions),
b AS (SELECT text, list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '') AS w FROM a),
c AS (SELECT text, array_to_string(list_filter(w, lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]$') OR (regexp_matches(x, '^[A-Za-z]$') AND len(w) > 1)), ' ') AS j FROM b),
d AS (SELECT text, CASE WHEN regexp_matches(j, '[0-9]+/[0-9]+') OR regexp_matches(lower(j), '(bath|bedroom|room)\\s*[0-9]+$') THEN j ELSE regexp_replace(j, '\\s+[0-9]+$', '') END AS j FROM c)
SELECT text, trim(CASE WHEN regexp_matches(j, '{HANGUL}') THEN j ELSE {TITLE.format("j")} END) AS name FROM d""")
def text_clean(v: Views) -> DataFrame:
    return v.text_regions.select("text").distinct().select("text", t.clean_room_name(F.col("text")).alias("name"))


def _quoted(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in terms) + "]"


REASONS = f"""+ r AS (SELECT region_id, trim(text) AS t, lower(trim(text)) AS l, confidence, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, width, height FROM text_regions JOIN images USING (image_id)),
f AS (SELECT *, regexp_matches(t, '{HANGUL}') AS ko, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS words,
  len(list_filter({_quoted(t.ROOM_PATTERNS)}, lambda p: regexp_matches(l, p))) > 0 OR len(list_filter({_quoted(t.ROOM_WORDS_KO)}, lambda p: contains(l, p))) > 0
  OR len(list_filter({_quoted(t.VOCABULARY_EN)}, lambda p: p = l OR (contains(l, p) AND length(p) > 2) OR (contains(p, l) AND length(l) > 2))) > 0
  OR len(list_filter({_quoted(t.VOCABULARY_KO)}, lambda p: p = t OR (contains(t, p) AND length(p) > 1) OR (contains(p, t) AND length(t) > 1))) > 0 AS room FROM r)
SELECT region_id, CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) <= 1 THEN 'single_character'
  WHEN confidence < 0.3::DOUBLE AND len(list_filter({_quoted(t.KNOWN_WORDS)}, lambda p: contains(l, p))) = 0 THEN 'low_confidence' WHEN alnum * 2 < length(t) THEN 'not_alphanumeric'
  WHEN len(list_filter({_quoted(t.WATERMARKS)}, lambda p: contains(l, p))) > 0 THEN 'watermark' WHEN regexp_matches(t, '^[0-9]{{1,2}}$') THEN 'number'
  WHEN NOT room AND len(list_filter({_quoted(t.DESCRIPTIVE_PATTERNS)}, lambda p: regexp_matches(l, p))) > 0 THEN 'descriptive'
  WHEN NOT room AND regexp_matches(t, '[0-9]+.*[0-9]+') AND len(list_filter({_quoted(t.PLURAL_ROOMS)}, lambda p: contains(l, p))) > 0 THEN 'room_count'
  WHEN NOT room AND len(list_filter({_quoted(t.DESCRIPTORS)}, lambda p: contains(l, p))) > 0 THEN 'descriptor'
  WHEN length(t) > CASE WHEN ko THEN 20 ELSE 30 END THEN 'too_long' WHEN words > CASE WHEN ko THEN 5 ELSE 3 END THEN 'too_many_words'
  WHEN area < 20 THEN 'too_small' WHEN area > 8000 THEN 'too_large' WHEN cy < height * 0.2::DOUBLE THEN 'title_area' WHEN cy > height * 0.85::DOUBLE THEN 'legend_area'
  WHEN cx < width * 0.05::DOUBLE OR cx > width * 0.95::DOUBLE THEN 'margin' END AS reject_reason FROM f"""


@query(REASONS)
def text_reject_reason(v: Views) -> DataFrame:
    return texts.room_reasons(v.text_regions, v.images).select("region_id", "reject_reason")


@query("""SELECT a.t AS a, b.t AS b, round(len(list_filter(range(1, least(length(a.t), length(b.t)) + 1), lambda i: substr(a.t, i, 1) = substr(b.t, i, 1))) / greatest(length(a.t), length(b.t)), 9) AS similarity
FROM (SELECT DISTINCT text AS t FROM text_regions) a JOIN (SELECT DISTINCT text AS t FROM text_regions) b ON a.t < b.t""")
def positional_similarity(v: Views) -> DataFrame:
    words = v.text_regions.select("text").distinct()
    both = words.select(F.col("text").alias("a")).join(words.select(F.col("text").alias("b")), F.col("a") < F.col("b"))  # twenty texts
    return both.select("a", "b", F.round(t.similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(f"SELECT region_id, regexp_matches(text, '{HANGUL}') AS hangul FROM text_regions")
def hangul_flag(v: Views) -> DataFrame:
    return v.text_regions.select("region_id", t.has_hangul(F.col("text")).alias("hangul"))


@query(f"SELECT region_id, text FROM text_regions WHERE len(list_filter({_quoted(t.VOCABULARY_EN)}, lambda p: p = lower(text) OR (contains(lower(text), p) AND length(p) > 2) OR (contains(p, lower(text)) AND length(text) > 2))) > 0")
def vocab_semi_join(v: Views) -> DataFrame:
    terms = F.array(*map(F.lit, t.VOCABULARY_EN))
    return v.text_regions.filter(t.in_vocabulary(F.lower("text"), terms, 2)).select("region_id", "text")


@query(f"SELECT region_id, text FROM text_regions WHERE len(list_filter({_quoted(t.WATERMARKS)}, lambda p: contains(lower(text), p))) = 0")
def watermark_anti_join(v: Views) -> DataFrame:
    return v.text_regions.filter(~F.lower("text").rlike(t.alternation(t.WATERMARKS))).select("region_id", "text")


EITHER = "(contains(a.low, b.low) OR contains(b.low, a.low))"
OVER_X, OVER_Y = (f"greatest(0, least(a.{c}2, b.{c}2) - greatest(a.{c}1, b.{c}1))" for c in "xy")


@query(f"""+ t AS (SELECT *, lower(trim(text)) AS low FROM text_regions WHERE length(trim(text)) > CASE method WHEN 'preprocessed_upscaled' THEN 1 ELSE 0 END
  AND confidence > CASE method WHEN 'enhanced' THEN 0.03 WHEN 'aggressive' THEN 0.01 ELSE 0.1 END::DOUBLE),
q AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, region_id) AS rn FROM t),
p AS (SELECT b.image_id, b.rn, list(a.rn) AS cl FROM q a JOIN q b ON a.image_id = b.image_id AND a.rn < b.rn WHERE
  sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) < 50 AND ({EITHER} OR length(a.low) > 3 AND length(b.low) > 3
    AND list_sum(list_transform(range(1, least(length(a.low), length(b.low)) + 1), lambda i: (a.low[i] = b.low[i])::INTEGER)) / greatest(length(a.low), length(b.low)) > 0.8::DOUBLE)
  OR {EITHER} AND {OVER_X} * {OVER_Y} > 0 AND {OVER_X} * {OVER_Y} / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) > 0.5::DOUBLE GROUP BY 1, 2),
m AS (SELECT q.image_id, q.rn, coalesce(cl, []) AS cl FROM q LEFT JOIN p USING (image_id, rn)),
st AS (SELECT image_id, rn, [rn] AS kept FROM m WHERE rn = 1
  UNION ALL SELECT m.image_id, m.rn, CASE WHEN list_has_any(kept, cl) THEN kept ELSE list_append(kept, m.rn) END FROM st JOIN m ON m.image_id = st.image_id AND m.rn = st.rn + 1),
fin AS (SELECT image_id, unnest(kept) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) AS last FROM st) WHERE last = 1)
SELECT image_id, region_id, text FROM q JOIN fin USING (image_id, rn)""", recursive=True)
def text_dedup(v: Views) -> DataFrame:
    return texts.dedup_regions(texts.accepted(v.text_regions)).select("image_id", "region_id", "text")


@query()
def text_cluster(v: Views) -> DataFrame:
    return texts.cluster_regions(v.text_regions).select("image_id", "region_id", "text")


@query()
def text_merge(v: Views) -> DataFrame:
    return texts.merge_regions(v.text_regions).select("image_id", "region_id", "text", "method")


@query()
def space_names(v: Views) -> DataFrame:
    return texts.space_names(v.text_regions, v.images)


@query("""SELECT image_id, count(*)::BIGINT AS regions, round(avg(confidence), 9) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence, string_agg(DISTINCT method, '|' ORDER BY method) AS methods FROM text_regions GROUP BY 1""")
def text_confidence(v: Views) -> DataFrame:
    d = v.text_regions.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("regions"), F.round(F.avg("confidence"), 9).alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.array_sort(F.collect_set("method")).alias("methods")
    )
    return d.withColumn("methods", joined("methods"))


def entries(x: str) -> Column:
    return F.array_join(F.transform(F.map_entries(F.col(x)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias(x)


COUNTS = "SELECT image_id, string_agg(k || '=' || n, '|' ORDER BY k) AS {0} FROM (SELECT image_id, k, count(*) AS n FROM {1} GROUP BY 1, 2) GROUP BY 1"


@query(COUNTS.format("swing_directions", f"(SELECT image_id, swing AS k FROM {SWING} JOIN detections USING (det_id))"))
def swing_histogram(v: Views) -> DataFrame:
    return metrics.histogram(reports.door_records(v.detections, v.images), "estimated_swing", "swing_directions").select("image_id", entries("swing_directions"))


@query(COUNTS.format("glazing_types", f"(SELECT image_id, CASE WHEN a < 2000 THEN 'single_glazing_likely' WHEN a < 6000 THEN 'double_glazing_likely' ELSE 'triple_glazing_likely' END AS k FROM (SELECT image_id, (x2 - x1) * (y2 - y1) AS a {WINDOWS}))"))
def glazing_histogram(v: Views) -> DataFrame:
    return metrics.histogram(reports.window_records(v.detections, v.images), "glazing_type", "glazing_types").select("image_id", entries("glazing_types"))


@query(COUNTS.format("object_counts", "(SELECT image_id, CASE class_id WHEN 1 THEN 'wall' WHEN 2 THEN 'window' ELSE 'door' END AS k FROM detections)"))
def object_counts(v: Views) -> DataFrame:
    named = v.detections.withColumn("name", c.class_name(F.col("class_id")))
    return metrics.histogram(named, "name", "object_counts").select("image_id", entries("object_counts"))


@query("""SELECT image_id, round(avg(greatest(x2 - x1, y2 - y1)) FILTER (class_id = 3), 9) AS average_door, round(avg(score), 9) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM detections GROUP BY 1""")
def object_summary(v: Views) -> DataFrame:
    door = F.when(F.col("class_id") == 3, F.greatest(*size()))
    return v.detections.groupBy("image_id").agg(F.round(F.avg(door), 9).alias("average_door"), F.round(F.avg("score"), 9).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


@query(f"""+ {MEASURED},
w AS (SELECT image_id, count(*) AS walls, sum(length) AS wl, avg(thickness) AS wt, count(*) FILTER (reasons <> '') AS xw FROM ext GROUP BY 1),
d AS (SELECT image_id, count(*) FILTER (class_id = 3) AS doors, count(*) FILTER (class_id = 2) AS windows, avg(score) AS conf FROM detections GROUP BY 1), j AS (SELECT image_id, count(*) AS junctions FROM junctions GROUP BY 1)
SELECT image_id, coalesce(walls, 0)::BIGINT AS walls, round(coalesce(wl, 0), 6) AS wall_length, round(coalesce(wt, 0), 6) AS wall_thickness, coalesce(xw, 0)::BIGINT AS exterior_walls, doors::BIGINT AS doors, windows::BIGINT AS windows, round(conf, 6) AS confidence, coalesce(junctions, 0)::BIGINT AS junctions
FROM images LEFT JOIN w USING (image_id) LEFT JOIN d USING (image_id) LEFT JOIN j USING (image_id)""")
def floorplan_summary(v: Views) -> DataFrame:
    spaces = texts.space_names(v.text_regions, v.images)
    d = reports.floorplan_summary(v.detections, v.walls, v.junctions, spaces, v.images)
    return rounded(d.select("image_id", "walls", "wall_length", "wall_thickness", "exterior_walls", "doors", "windows", "confidence", "junctions"), "wall_length", "wall_thickness", "confidence")


@query()
def report_json(v: Views) -> DataFrame:
    spaces = texts.space_names(v.text_regions, v.images)
    return outputs.as_json(reports.floorplan_report(v.detections, v.walls, v.junctions, spaces, v.images))


@query("""+ n AS (SELECT ['plan', 'vis', 'acc', 'final', 'x'][event_id % 5 + 1] || event_id || ['.json', '.png', '.txt'][event_id % 3 + 1] AS name FROM events)
SELECT coalesce(max(regexp_extract(name, '[0-9]+')::BIGINT), 0) + 1 AS next_number FROM n WHERE regexp_matches(name, '^(plan|vis|acc|final).*\\.(json|png)$')""")
def next_run_number(v: Views) -> DataFrame:
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.col("e") % k + 1).cast("int"))
    names = v.events.select(F.concat(pick(["plan", "vis", "acc", "final", "x"], 5), F.col("e").cast("string"), pick([".json", ".png", ".txt"], 3)).alias("name"))
    return outputs.next_run_number(names)


@query("""+ s AS (SELECT event_id AS image_id, (event_id * 7 % 3000)::INTEGER AS w, (event_id * 13 % 2500)::INTEGER AS h FROM events),
r AS (SELECT *, CASE WHEN greatest(w, h) > 2048 THEN 2048::DOUBLE / greatest(w, h) ELSE 1::DOUBLE END AS f FROM s)
SELECT image_id, floor(w * f + 1e-9)::INTEGER AS new_width, floor(h * f + 1e-9)::INTEGER AS new_height, CASE WHEN least(w, h) >= 100 AND least(floor(w * f + 1e-9), floor(h * f + 1e-9)) >= 100 THEN 200 ELSE 400 END AS status, f < 1 AS resized FROM r""")
def image_admission(v: Views) -> DataFrame:
    sized = v.events.selectExpr("e image_id", "cast(e * 7 % 3000 as int) width", "cast(e * 13 % 2500 as int) height", "1D mm_per_px")
    return images.admitted(sized).select("image_id", "new_width", "new_height", "status", "resized")


@query("""+ s AS (SELECT event_id AS image_id, (100 + event_id * 7 % 3000)::DOUBLE AS w, (100 + event_id * 13 % 2500)::DOUBLE AS h FROM events),
u AS (SELECT *, greatest(1, 800 / least(h, w)) AS up FROM s), z AS (SELECT *, CASE WHEN round_even(greatest(h, w) * up, 0) > 1600 THEN 1600 / greatest(h, w) ELSE up END AS z FROM u),
o AS (SELECT *, round_even(h * z, 0)::INTEGER AS oh, round_even(w * z, 0)::INTEGER AS ow FROM z)
SELECT image_id, round(z, 9) AS scale, 1600 AS out_width, 1600 AS out_height, (1600 - oh) // 2 AS y1, (1600 - ow) // 2 AS x1, (1600 - oh) // 2 + oh AS y2, (1600 - ow) // 2 + ow AS x2 FROM o""")
def resize_plan(v: Views) -> DataFrame:
    sized = v.events.selectExpr("e image_id", "cast(100 + e * 7 % 3000 as double) width", "cast(100 + e * 13 % 2500 as double) height")
    return rounded(prepare.resize_plan(sized), "scale", digits=9)


@query("""+ a AS (SELECT image_id, det_id, class_id, sum(x_end - x_start) AS area FROM mask_runs GROUP BY 1, 2, 3)
SELECT image_id, class_id, det_id, area::BIGINT AS area FROM (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY area DESC, det_id) AS n FROM a) WHERE n <= 4""")
def largest_masks(v: Views) -> DataFrame:
    return prepare.largest_masks(v.detections, masks.mask_boxes(v.mask_runs)).select("image_id", "class_id", "det_id", "area")


@query("""+ m AS (SELECT det_id, sum(x_end - x_start) AS n, min(y) AS y1, max(x_end) - 1 AS x2 FROM mask_runs GROUP BY 1)
SELECT det_id, CASE class_id WHEN 1 THEN 'wall' WHEN 2 THEN 'window' ELSE 'door' END AS type, n::DOUBLE AS area, round(n / 1254400 * 100, 9) AS coverage_pct, m.y1 AS mask_y1, m.x2 AS mask_x2
FROM (SELECT det_id, class_id, score FROM detections) JOIN m USING (det_id)""")
def object_records(v: Views) -> DataFrame:
    d = prepare.object_records(v.detections, v.mask_runs, v.images)
    return d.select("det_id", "type", F.col("dimensions.area").alias("area"), F.round("mask.coverage_pct", 9).alias("coverage_pct"), F.col("mask.y1").alias("mask_y1"), F.col("mask.x2").alias("mask_x2"))


def crossing_bars(v: Views) -> DataFrame:
    """Masks with something to walk: bars of 81 x 11 pixels on a 25-pixel grid, lying and standing, some of which cross."""
    d = v.walls.selectExpr("image_id", "det_id", "cast(least(sx, ex) / 4 as bigint) + 75 x", "cast(least(sy, ey) / 4 as bigint) + 75 y", "sx <> ex flat")
    rows = F.explode(F.expr("if(flat, sequence(y - 5, y + 5), sequence(y - 40, y + 40))")).alias("y")
    return d.select("image_id", "det_id", F.lit(1).alias("class_id"), "x", "flat", rows).selectExpr("image_id", "det_id", "class_id", "y", "x - if(flat, 40, 5) x_start", "x + if(flat, 41, 6) x_end")


@query()
def wall_segmentation(v: Views) -> DataFrame:
    return raster.wall_segments(crossing_bars(v), images=v.images).groupBy("image_id", "wall_seq").agg(F.count(F.lit(1)).alias("points"), F.min("y").alias("y1"), F.max("y").alias("y2"))


@query()
def raster_junctions(v: Views) -> DataFrame:
    return raster.raster_junctions(crossing_bars(v), cleaned=False, images=v.images)


@query()
def skeleton_walk(v: Views) -> DataFrame:
    points = raster.wall_segments(crossing_bars(v), images=v.images).select(F.concat_ws("-", "image_id", "wall_seq").alias("path_id"), "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rounded(paths.path_length(points), "length")


@query()
def wall_thickness(v: Views) -> DataFrame:
    return rounded(raster.wall_thickness(crossing_bars(v), images=v.images).select("image_id", "wall_seq", "average", "minimum", "maximum"), "average", "minimum", "maximum")


@query()
def centered_centerline(v: Views) -> DataFrame:
    return rounded(raster.centered_lines(crossing_bars(v)), "x", "y")


@query("""SELECT image_id, wall_seq, sx * mm_per_px AS sx, sy * mm_per_px AS sy, ex * mm_per_px AS ex, ey * mm_per_px AS ey, least(sx, ex) * mm_per_px AS x1, greatest(sy, ey) * mm_per_px AS y2, thickness_avg * mm_per_px AS thickness, thickness_avg / mm_per_px AS px
FROM walls JOIN images USING (image_id)""")
def mm_conversions(v: Views) -> DataFrame:
    s, at = F.col("mm_per_px"), lambda c, i, j: F.get(F.get(c, F.lit(i)), F.lit(j))
    d = v.walls.join(v.images, "image_id").select(
        "image_id",
        "wall_seq",
        units.line_to_mm(F.array(F.array("sx", "sy"), F.array("sx"), F.array("ex", "ey", "sx")), s).alias("line"),
        units.box_to_mm(F.struct(F.least("sx", "ex").alias("x1"), F.least("sy", "ey").alias("y1"), F.greatest("sx", "ex").alias("x2"), F.greatest("sy", "ey").alias("y2")), s).alias("box"),
        units.thickness_to_mm(F.struct(F.col("thickness_avg").alias("average"), F.lit(None).cast("double").alias("min"), F.lit(0.0).alias("max"), F.array("thickness_avg").alias("profile")), s).alias("t"),
        units.mm_to_px(F.col("thickness_avg"), s).alias("px"),
    )
    line = F.col("line")
    return d.select("image_id", "wall_seq", at(line, 0, 0).alias("sx"), at(line, 0, 1).alias("sy"), at(line, 1, 0).alias("ex"), at(line, 1, 1).alias("ey"), "box.x1", "box.y2", F.get("t.profile", F.lit(0)).alias("thickness"), "px")


@query("""SELECT image_id, '[' || string_agg(CASE det_id % 5 WHEN 1 THEN '{"name":"wall"}' WHEN 2 THEN '{"name":"window"}' WHEN 3 THEN '{"name":"door"}' ELSE '{}' END, ',' ORDER BY det_id) || ']' AS names FROM detections GROUP BY image_id""")
def class_name_lists(v: Views) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("det_id", (F.col("det_id") % 5).cast("int").alias("c")))), lambda x: x["c"])
    return v.detections.groupBy("image_id").agg(ids.alias("ids")).select("image_id", F.to_json(c.class_name_maps(F.col("ids"))).alias("names"))


@query(f"+ {MEASURED}\nSELECT image_id, wall_seq FROM ext WHERE reasons = ''")
def interior_walls(v: Views) -> DataFrame:
    exterior = reports.connected_walls(v.walls, v.junctions, v.images).filter("is_exterior")
    return selection.interior_walls(v.walls, exterior).select("image_id", F.col("wall_seq").cast("long").alias("wall_seq"))


@query("""+ s AS (SELECT path_id, pos, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2 FROM path_points WINDOW w AS (PARTITION BY path_id ORDER BY pos)),
n AS (SELECT *, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) OVER (PARTITION BY path_id) AS length FROM s)
SELECT path_id, pos::BIGINT AS pos, x1, y1, x2, y2 FROM n WHERE length >= 10 AND x1 IS NOT NULL AND NOT (x1 < 40 AND y1 < 140 OR x2 < 40 AND y2 < 140)""")
def drawn_lines(v: Views) -> DataFrame:
    return selection.line_steps(v.path_points).withColumn("pos", F.col("pos").cast("long"))


COVER = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) / (({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)) > 0.5::DOUBLE"


@query(f"""+ d AS (SELECT * FROM detections WHERE class_id = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_id) AS rn FROM d b WHERE det_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM d a WHERE a.image_id = b.image_id AND a.det_id % 3 = 0 AND {COVER.format(a="a", b="b")})),
p AS (SELECT b.image_id, b.rn, list(a.rn) AS cl FROM q a JOIN q b ON a.image_id = b.image_id AND a.rn < b.rn WHERE {COVER.format(a="a", b="b")} GROUP BY 1, 2),
m AS (SELECT q.image_id, q.rn, coalesce(cl, []) AS cl FROM q LEFT JOIN p USING (image_id, rn)),
st AS (SELECT image_id, rn, [rn] AS kept FROM m WHERE rn = 1
  UNION ALL SELECT m.image_id, m.rn, CASE WHEN list_has_any(kept, cl) THEN kept ELSE list_append(kept, m.rn) END FROM st JOIN m ON m.image_id = st.image_id AND m.rn = st.rn + 1),
fin AS (SELECT image_id, unnest(kept) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) AS last FROM st) WHERE last = 1)
SELECT image_id, det_id FROM q JOIN fin USING (image_id, rn)""", recursive=True)
def walls_without_line(v: Views) -> DataFrame:
    walls = v.detections.filter("class_id = 1")
    return selection.without_line(walls.filter("det_id % 3 <> 0"), walls.filter("det_id % 3 = 0")).select("image_id", "det_id")


#: Every fiftieth box is a crowd. The order of sampling is arithmetic here, so that SQL can say it.
CROWDS = f"""g AS (SELECT * REPLACE (CASE WHEN gt_id % 50 = 0 THEN -1 ELSE class_id END AS class_id) FROM gt),
o AS (SELECT a.image_id, a.pred_id, b.gt_id, b.class_id, {AB} AS iou FROM pred a JOIN g b USING (image_id)),
cr AS (SELECT DISTINCT pred_id FROM o WHERE class_id < 0 AND iou >= 0.001::DOUBLE)"""
MIXED = "7919 * {0} % 10007"


def _with_crowds(v: Views) -> DataFrame:
    return v.gt.withColumn("class_id", F.expr("if(gt_id % 50 = 0, -1, class_id)"))


@query(f"""+ {CROWDS},
b AS (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY iou DESC, gt_id) AS n FROM o WHERE class_id > 0),
s AS (SELECT p.image_id, p.pred_id AS roi_id, b.gt_id, b.class_id, coalesce(iou, 0) >= 0.5::DOUBLE AS positive FROM pred p LEFT JOIN b ON b.pred_id = p.pred_id AND b.n = 1 WHERE coalesce(iou, 0) >= 0.5::DOUBLE OR p.pred_id NOT IN (FROM cr)),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, positive ORDER BY {MIXED.format("roi_id")}, roi_id) AS place FROM s),
t AS (SELECT * FROM r WHERE positive AND place <= 6), n AS (SELECT image_id, count(*) AS n FROM t GROUP BY 1)
SELECT image_id, roi_id, positive, gt_id, class_id FROM t
UNION ALL SELECT image_id, roi_id, positive, NULL, 0 FROM r JOIN n USING (image_id) WHERE NOT positive AND place <= floor(n * (1 / 0.33::DOUBLE)) - n""")
def sampled_detection_targets(v: Views) -> DataFrame:
    rois = v.pred.withColumnRenamed("pred_id", "roi_id")
    return evaluate.detection_targets(rois, _with_crowds(v), per_image=20, order=F.expr(MIXED.format("roi_id")))


@query(f"""+ {CROWDS},
f AS (SELECT DISTINCT pred_id FROM (SELECT pred_id, iou, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, pred_id) AS n FROM o WHERE class_id > 0) WHERE n = 1 AND iou > 0),
m AS (SELECT pred_id, max(iou) AS iou FROM o WHERE class_id > 0 GROUP BY 1),
l AS (SELECT p.image_id, p.pred_id AS anchor_id, CASE WHEN f.pred_id IS NOT NULL OR coalesce(iou, 0) >= 0.7::DOUBLE THEN 1 WHEN coalesce(iou, 0) < 0.3::DOUBLE AND p.pred_id NOT IN (FROM cr) THEN -1 ELSE 0 END AS label
  FROM pred p LEFT JOIN m ON m.pred_id = p.pred_id LEFT JOIN f ON f.pred_id = p.pred_id),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY {MIXED.format("anchor_id")}, anchor_id) AS place, least(count(*) FILTER (label = 1) OVER (PARTITION BY image_id), 10) AS n FROM l)
SELECT image_id, anchor_id, CASE WHEN place <= CASE WHEN label = 1 THEN 10 ELSE 20 - n END THEN label ELSE 0 END AS label FROM r""")
def sampled_anchor_targets(v: Views) -> DataFrame:
    anchors = v.pred.withColumnRenamed("pred_id", "anchor_id")
    return evaluate.anchor_targets(anchors, _with_crowds(v), per_image=20, order=F.expr(MIXED.format("anchor_id")))


@query("""+ r AS (SELECT image_id, det_id, [image_id, 1120, 1120, 3, 1600, 1600, 3, y1, x1, y2, x2, 1.5, 1, det_id % 2, 0] AS meta FROM detections)
SELECT det_id, image_id::BIGINT AS image_id, array_to_string(list_transform(meta[8:11], lambda x: x::BIGINT), ',') AS window, 1.5::DOUBLE AS scale, '1,' || det_id % 2 || ',0' AS active FROM r""")
def image_meta(v: Views) -> DataFrame:
    whole = lambda *x: F.array(*[F.lit(i) for i in x])
    meta = prepare.image_meta(F.col("image_id"), whole(1120, 1120, 3), whole(1600, 1600, 3), F.array("y1", "x1", "y2", "x2"), F.lit(1.5), F.array(F.lit(1), (F.col("det_id") % 2).cast("int"), F.lit(0)))
    text = lambda x: F.array_join(F.col(x).cast("array<string>"), ",")
    return v.detections.select("det_id", prepare.parsed_meta(meta).alias("m")).select("det_id", "m.image_id", text("m.window").alias("window"), "m.scale", text("m.active_class_ids").alias("active"))


@query("""SELECT i.image_id, 1120::BIGINT AS width, round(coalesce(avg(greatest(x2 - x1, y2 - y1)) FILTER (class_id = 3), 0), 6) AS average_door,
  string_agg(CASE class_id WHEN 1 THEN 'wall' WHEN 2 THEN 'window' ELSE 'door' END, '|' ORDER BY det_id) AS names, string_agg(concat_ws(',', x1::BIGINT, y1::BIGINT, x2::BIGINT, y2::BIGINT), '|' ORDER BY det_id) AS points
FROM images i JOIN detections d USING (image_id) GROUP BY i.image_id""")
def flat_json(v: Views) -> DataFrame:
    w, h = size()
    doors = v.detections.filter("class_id = 3").groupBy("image_id").agg(F.avg(F.greatest(w, h)).alias("average_door"))
    d = prepare.detection_json(v.detections, v.images, doors)
    points = F.transform("legacy.points", lambda p: F.concat_ws(",", *[p[k].cast("long") for k in ("x1", "y1", "x2", "y2")]))
    return d.select("image_id", F.col("legacy.Width").alias("width"), F.round("legacy.averageDoor", 6).alias("average_door"), F.array_join(F.transform("legacy.classes", lambda x: x["name"]), "|").alias("names"), F.array_join(points, "|").alias("points"))


@query("""+ d AS (SELECT image_id, det_id % 2 AS t, score AS p, (y1 - x1) / 400 AS a, det_id % 3 AS k, [score * 0.5, score * 0.3, 1 - score * 0.8] AS ps FROM detections),
c AS (SELECT *, greatest(1e-7, least(1 - 1e-7, p)) AS q, abs(a) AS z, greatest(1e-7, least(1 - 1e-7, ps[k + 1])) AS s FROM d)
SELECT image_id, round(avg(CASE WHEN z < 1 THEN 0.5 * z * z ELSE z - 0.5 END), 6) AS smooth, round(avg(-(t * ln(q) + (1 - t) * ln(1 - q))), 6) AS binary, round(avg(-ln(s)), 6) AS sparse FROM c GROUP BY image_id""")
def losses(v: Views) -> DataFrame:
    s = F.col("score")
    probabilities = F.array(s * 0.5, s * 0.3, 1 - s * 0.8)
    return rounded(
        v.detections.groupBy("image_id").agg(
            F.avg(evaluate.smooth_l1((F.col("y1") - F.col("x1")) / 400, F.lit(0.0))).alias("smooth"),
            F.avg(evaluate.cross_entropy(F.col("det_id") % 2, s)).alias("binary"),
            F.avg(evaluate.sparse_cross_entropy((F.col("det_id") % 3).cast("int"), probabilities)).alias("sparse"),
        ),
        "smooth", "binary", "sparse",
    )


@query("SELECT det_id FROM detections WHERE NOT (det_id % 2 = 0 AND det_id % 3 = 0)")
def nonzero_rows(v: Views) -> DataFrame:
    return prepare.without_zero_rows(v.detections.selectExpr("det_id", "det_id % 2 a", "det_id % 3 b"), ["a", "b"]).select("det_id")


@query()
def wall_parameters(v: Views) -> DataFrame:
    d = reports.wall_parameters(crossing_bars(v), v.images, "R1_", cleaned=False)
    return rounded(d.select("image_id", "wall_id", "length", F.col("thickness.average").alias("thickness"), "orientation_degrees", "box.x1", "box.y2", "start_junction", "segment_area"), "length", "thickness", "orientation_degrees")


@query(f"""SELECT r.det_id, row_number() OVER (PARTITION BY image_id ORDER BY r.det_id)::BIGINT AS door_id, round((x1 + x2) / 2 * mm_per_px, 6) AS center_x_mm, round((y1 + y2) / 2 * mm_per_px, 6) AS center_y_mm,
  round(CASE WHEN h > w THEN w ELSE h END * mm_per_px, 6) AS width_mm, round(CASE WHEN h > w THEN h ELSE w END * mm_per_px, 6) AS height_mm, round(w / h, 6) AS aspect_ratio, CASE WHEN w < h THEN 'interior' ELSE 'entrance' END AS door_use,
  door_type, swing AS estimated_swing, CASE swing WHEN 'opens_leftward' THEN 'left_edge' WHEN 'opens_rightward' THEN 'right_edge' WHEN 'opens_upward' THEN 'bottom_edge' ELSE 'top_edge' END AS hinge_side,
  CASE WHEN w * h < 2000 THEN 'small' WHEN w * h < 6000 THEN 'standard' WHEN w * h < 10000 THEN 'large' ELSE 'oversized' END AS size_category, CASE WHEN w > 80 THEN 'ADA_compliant_likely' WHEN w > 60 THEN 'standard_width' ELSE 'narrow_door' END AS accessibility
FROM {SWING} r JOIN detections d USING (det_id) JOIN images USING (image_id)""")
def door_records(v: Views) -> DataFrame:
    d = reports.door_records(v.detections, v.images).drop("image_id", "from_left", "from_top", "notes")
    return rounded(d, "center_x_mm", "center_y_mm", "width_mm", "height_mm", "aspect_ratio")


@query(f"""SELECT det_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id)::BIGINT AS window_id, round((x1 + x2) / 2 * mm_per_px, 6) AS center_x_mm, round((y1 + y2) / 2 * mm_per_px, 6) AS center_y_mm,
  round(greatest(w, h) * mm_per_px, 6) AS width_mm, CASE WHEN w > h THEN 'horizontal' ELSE 'vertical' END AS window_type, CASE WHEN w * h < 1000 THEN 'small' WHEN w * h < 4000 THEN 'standard' WHEN w * h < 8000 THEN 'large' ELSE 'oversized' END AS size_category,
  CASE WHEN w * h < 2000 THEN 'single_glazing_likely' WHEN w * h < 6000 THEN 'double_glazing_likely' ELSE 'triple_glazing_likely' END AS glazing_type FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h {WINDOWS}) JOIN images USING (image_id)""")
def window_records(v: Views) -> DataFrame:
    d = reports.window_records(v.detections, v.images).drop("image_id", "from_left", "from_top", "notes")
    return rounded(d, "center_x_mm", "center_y_mm", "width_mm")


@query(f"""SELECT a.region_id AS a_id, b.region_id AS b_id, round(len(list_filter(range(1, least(length(a.text), length(b.text)) + 1), lambda i: substr(a.text, i, 1) = substr(b.text, i, 1))) / greatest(length(a.text), length(b.text)), 9) AS similarity
FROM text_regions a JOIN text_regions b ON a.image_id = b.image_id AND a.region_id < b.region_id WHERE abs(a.x1 - b.x1) < 50 AND abs(a.y1 - b.y1) < 50""")
def similarity_nearby(v: Views) -> DataFrame:
    a, b = v.text_regions.alias("a"), v.text_regions.alias("b")
    near = (F.abs(F.col("a.x1") - F.col("b.x1")) < 50) & (F.abs(F.col("a.y1") - F.col("b.y1")) < 50)
    both = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.region_id") < F.col("b.region_id")) & near)
    return both.select(F.col("a.region_id").alias("a_id"), F.col("b.region_id").alias("b_id"), F.round(t.similarity(F.col("a.text"), F.col("b.text")), 9).alias("similarity"))


@query("+ o AS (SELECT unnest(['walls', 'windows', 'doors']) AS object, unnest([1, 2, 3]) AS class_id)\nSELECT image_id, object, count(d.det_id)::BIGINT AS count, round(coalesce(avg(score), 0), 9) AS avg_confidence, round(coalesce(avg((y2 - y1) * (x2 - x1)), 0), 9) AS avg_size, min(score) AS min_confidence, max(score) AS max_confidence FROM images CROSS JOIN o LEFT JOIN detections d USING (image_id, class_id) GROUP BY 1, 2")
def report_objects(v: Views) -> DataFrame:
    d = reports.accuracy_report(v.detections, v.images).select("image_id", F.explode("objects").alias("object", "s")).select("image_id", "object", "s.*")
    return rounded(d, "avg_confidence", "avg_size", digits=9)


@query("""+ f AS (SELECT image_id, det_id, class_id, y, 1120 - x_end AS a, 1120 - x_start AS b FROM mask_runs WHERE class_id IN (1, 3) AND NOT (det_id % 4 = 0))
SELECT image_id, det_id AS gt_id, class_id, min(y) AS y1, min(a) AS x1, max(y) + 1 AS y2, max(b) AS x2 FROM f GROUP BY 1, 2, 3""")
def flipped_ground_truth(v: Views) -> DataFrame:
    runs = v.mask_runs.withColumn("x_end", F.expr("if(det_id % 4 = 0, x_start, x_end)"))  # every fourth mask is empty
    return masks.ground_truth(masks.flipped_runs(runs, v.images), [1, 3])
