"""Detection-shaped views of the test tables, by fixed arithmetic on event ids. The shapes mean nothing; they exercise operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEXTS = [
    "Living Room", "bedroom", "Kitchen 2", "1/2 Bath", "ALAMY stock", "12", "x", "4 Bedrooms/3 Bathrooms", "거실", "안방 1",
    "Lauivdry", "Laundry", "formal", "dining", "room", "@@##", "conference room", "North Wing", "the quick brown fox jumps", "Bath1",
]
METHODS = ["original", "preprocessed", "enhanced", "aggressive", "preprocessed_upscaled"]
BOX = {
    "y1": "cast(104729 * e % 900 as double)",
    "x1": "cast(1299709 * e % 900 as double)",
    "y2": "cast(104729 * e % 900 + 20 + 31 * e % 200 as double)",
    "x2": "cast(1299709 * e % 900 + 20 + 37 * e % 200 as double)",
}


class Views:
    """The views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("e"), F.col("user_id").alias("image_id"), "event_type")

    @property
    def images(self) -> DataFrame:
        return self.events.select("image_id").distinct().selectExpr("image_id", "1120D width", "1120D height", "(image_id % 5 + 1) * 0.5D mm_per_px")

    @property
    def detections(self) -> DataFrame:
        kind = "case event_type when 'view' then 1 when 'click' then 1 when 'signup' then 2 when 'error' then 2 else 3 end class_id"
        return self.events.selectExpr("image_id", "e det_id", kind, "cast((7919 * e + 17) % 1000 as double) / 1000D score", *[f"{v} {k}" for k, v in BOX.items()])

    @property
    def gt(self) -> DataFrame:
        return self.detections.filter("det_id % 2 = 0").withColumnRenamed("det_id", "gt_id").drop("score")

    @property
    def pred(self) -> DataFrame:
        d = self.detections.filter("(det_id % 2 = 0 and det_id % 7 <> 0) or det_id % 6 = 1")
        dy, dx = "cast(13 * det_id % 21 - 10 as double)", "cast(17 * det_id % 21 - 10 as double)"
        kind = "case when det_id % 11 = 0 then class_id % 3 + 1 else class_id end class_id"
        return d.selectExpr("image_id", "det_id pred_id", kind, "score", f"y1 + {dy} y1", f"x1 + {dx} x1", f"y2 + {dy} y2", f"x2 + {dx} x2")

    @property
    def walls(self) -> DataFrame:
        d = self.detections.filter("class_id = 1").selectExpr(
            "image_id", "det_id", "cast((7919 * det_id % 1009) % 9 * 100 as double) sx", "cast((104729 * det_id % 1013) % 9 * 100 as double) sy", "cast(4 + det_id % 7 as double) thickness_avg"
        )
        seq = F.row_number().over(Window.partitionBy("image_id").orderBy("det_id"))
        ex = F.expr("case when det_id % 2 = 0 then sx + 100 * (1 + 31 * det_id % 4) else sx end")
        ey = F.expr("case when det_id % 2 = 0 then sy else sy + 100 * (1 + 37 * det_id % 4) end")
        return d.select("image_id", seq.alias("wall_seq"), "det_id", "sx", "sy", ex.alias("ex"), ey.alias("ey"), "thickness_avg")

    @property
    def junctions(self) -> DataFrame:
        seq = F.row_number().over(Window.partitionBy("image_id").orderBy("sx", "sy"))
        d = self.walls.select("image_id", "sx", "sy").distinct().withColumn("j_seq", seq)
        return d.selectExpr("image_id", "j_seq", "sx + j_seq % 4 x", "sy + j_seq % 5 y")

    @property
    def path_points(self) -> DataFrame:
        seq = F.row_number().over(Window.partitionBy("image_id").orderBy("det_id"))
        return self.detections.select(F.col("image_id").alias("path_id"), seq.alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y"))

    @property
    def mask_runs(self) -> DataFrame:
        d = self.detections.selectExpr("image_id", "det_id", "class_id", "cast(y1 as bigint) y1", "cast(x1 as bigint) x1", "explode(sequence(0, 7)) dy").filter("dy <= det_id % 8")
        return d.selectExpr("image_id", "det_id", "class_id", "y1 + dy y", "x1 + dy x_start", "x1 + 20 + 37 * det_id % 50 x_end")

    @property
    def segments(self) -> DataFrame:
        return self.detections.filter("class_id = 1").selectExpr("image_id", "det_id seg_id", "x1", "y1", "x2", "y2")

    @property
    def text_regions(self) -> DataFrame:
        pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), F.expr(k).cast("int"))
        return self.detections.select(
            "image_id",
            F.col("det_id").alias("region_id"),
            pick(TEXTS, "(7919 * det_id % 1009) % 20 + 1").alias("text"),
            "x1",
            "y1",
            F.expr("x1 + 5 + 13 * det_id % 150").alias("x2"),
            F.expr("y1 + 5 + 11 * det_id % 40").alias("y2"),
            F.col("score").alias("confidence"),
            pick(METHODS, "det_id % 5 + 1").alias("method"),
        )


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same views as common table expressions of the SQL that results are compared with.
SQL_VIEWS = f"""images AS (SELECT DISTINCT user_id AS image_id, 1120::DOUBLE AS width, 1120::DOUBLE AS height, (user_id % 5 + 1) * 0.5::DOUBLE AS mm_per_px FROM events),
detections AS (SELECT user_id AS image_id, e AS det_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 2 ELSE 3 END AS class_id,
  ((7919 * e + 17) % 1000)::DOUBLE / 1000::DOUBLE AS score, {", ".join(f"{v} AS {k}" for k, v in BOX.items())} FROM (SELECT *, event_id AS e FROM events)),
gt AS (SELECT image_id, det_id AS gt_id, class_id, y1, x1, y2, x2 FROM detections WHERE det_id % 2 = 0),
pred AS (SELECT image_id, det_id AS pred_id, CASE WHEN det_id % 11 = 0 THEN class_id % 3 + 1 ELSE class_id END AS class_id, score, y1 + dy AS y1, x1 + dx AS x1, y2 + dy AS y2, x2 + dx AS x2
  FROM (SELECT *, (13 * det_id % 21 - 10)::DOUBLE AS dy, (17 * det_id % 21 - 10)::DOUBLE AS dx FROM detections) WHERE (det_id % 2 = 0 AND det_id % 7 <> 0) OR det_id % 6 = 1),
walls AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) AS wall_seq, det_id, sx, sy,
  CASE WHEN det_id % 2 = 0 THEN sx + 100 * (1 + 31 * det_id % 4) ELSE sx END AS ex, CASE WHEN det_id % 2 = 0 THEN sy ELSE sy + 100 * (1 + 37 * det_id % 4) END AS ey, thickness_avg
  FROM (SELECT image_id, det_id, ((7919 * det_id % 1009) % 9 * 100)::DOUBLE AS sx, ((104729 * det_id % 1013) % 9 * 100)::DOUBLE AS sy, (4 + det_id % 7)::DOUBLE AS thickness_avg FROM detections WHERE class_id = 1)),
junctions AS (SELECT image_id, j_seq, sx + j_seq % 4 AS x, sy + j_seq % 5 AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sx, sy) AS j_seq FROM (SELECT DISTINCT image_id, sx, sy FROM walls))),
path_points AS (SELECT image_id AS path_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) AS pos, x1 AS x, y1 AS y FROM detections),
mask_runs AS (SELECT image_id, det_id, class_id, y1::BIGINT + dy AS y, x1::BIGINT + dy AS x_start, x1::BIGINT + 20 + 37 * det_id % 50 AS x_end
  FROM (SELECT *, unnest(range(8)) AS dy FROM detections) WHERE dy <= det_id % 8),
segments AS (SELECT image_id, det_id AS seg_id, x1, y1, x2, y2 FROM detections WHERE class_id = 1),
text_regions AS (SELECT image_id, det_id AS region_id, {_listed(TEXTS)}[(7919 * det_id % 1009) % 20 + 1] AS text, x1, y1, x1 + 5 + 13 * det_id % 150 AS x2, y1 + 5 + 11 * det_id % 40 AS y2,
  score AS confidence, {_listed(METHODS)}[det_id % 5 + 1] AS method FROM detections)"""
