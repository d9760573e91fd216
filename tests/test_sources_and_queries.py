import struct
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from floorlake import queries, schemas
from floorlake.sources import images, outputs
from floorlake.streaming import arrivals

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"rest"


def test_read_and_detect(spark, tmp_path):
    for name, size in (("a.png", (300, 200)), ("b.png", (5000, 400)), ("c.png", (90, 500))):
        (tmp_path / name).write_bytes(png(*size))
    (tmp_path / "d.txt").write_text("no image")
    files = images.read_images(spark, str(tmp_path))
    sized = files.withColumn("s", images.image_size(F.col("content"))).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", "s.*")
    assert {r["name"]: (r["width"], r["height"]) for r in sized.collect()} == {"a.png": (300, 200), "b.png": (5000, 400), "c.png": (90, 500), "d.txt": (None, None)}
    out = {r["name"]: r for r in images.admitted(sized.withColumn("mm_per_px", F.lit(2.0))).collect()}
    assert [out[k]["status"] for k in ("a.png", "b.png", "c.png", "d.txt")] == [200, 200, 400, 400]
    assert (out["b.png"]["new_width"], out["b.png"]["new_height"]) == (2048, 163) and out["b.png"]["scale"] == 2.0 * 2048 / 5000
    assert images.admitted(sized.withColumn("mm_per_px", F.lit(2.0)), ready=False).filter("status = 503").count() == 4

    def load():
        return lambda content: pd.DataFrame({"det_id": [1, 2], "class_id": [1, 3], "score": [0.5, 0.9], "y1": 0.0, "x1": 0.0, "y2": 1.0, "x2": float(len(content))})

    found = images.detect(sized.filter("width is not null").withColumn("image_id", F.xxhash64("name")), load)
    assert found.count() == 6 and ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in found.schema) == schemas.DETECTIONS


def test_office_plans_and_registry(spark):
    edges = spark.createDataFrame([(1, y, 0, 10, 100) for y in range(60)] + [(2, y, 0, 10, 100) for y in range(75)], "image_id long, y int, x int, width int, height int")
    assert {r["image_id"]: r["is_office"] for r in images.is_office_plan(edges).collect()} == {1: True, 2: False}
    i = spark.createDataFrame([("s", "b"), ("s", "a"), ("t", "z")], "source string, source_image_id string")
    c = spark.createDataFrame([("s", 3, "door"), ("s", 1, "wall"), ("s", 0, "x")], "source string, class_id int, name string")
    a, b = images.registered(i, c)
    assert {(r["image_key"], r["internal_id"]) for r in a.collect()} == {("s.a", 0), ("s.b", 1), ("t.z", 0)}
    assert {(r["class_key"], r["internal_id"], r["name"]) for r in b.collect()} == {("s.0", 0, "BG"), ("s.1", 1, "wall"), ("s.3", 2, "door")}


def test_run_numbers(spark):
    number = lambda names: outputs.next_run_number(spark.createDataFrame([(n,) for n in names], "name string")).first()[0]
    assert number(["plan7.json", "vis12.png", "acc3.json", "other99.json", "final.json", "vis50.txt"]) == 13
    assert number([]) == 1


def test_json_output(spark, tmp_path):
    d = outputs.as_json(spark.createDataFrame([(1, 2.0, [3])], "image_id long, a double, b array<int>"))
    assert d.first()["report"] == '{"a":2.0,"b":[3]}'
    outputs.write_json(d, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1, 0.9, 0.0, 0.0, 10.0, 10.0)], schemas.DETECTIONS).write.parquet(f"{tmp_path}/in")
    i = spark.createDataFrame([(1, 100.0, 100.0, 1.0), (2, 100.0, 100.0, 1.0)], schemas.IMAGES)
    run = lambda: arrivals.stream_accuracy(spark, f"{tmp_path}/in", i, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    run()
    spark.createDataFrame([(2, 1, 1, 0.9, 0.0, 0.0, 10.0, 10.0)], schemas.DETECTIONS).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(r["image_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def normal(df):
    one = lambda v: None if v is None or v is pd.NA or v != v else (round(float(v), 9) if not isinstance(v, str) else v)
    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_pyramid_and_detector_output(spark, tmp_path):
    spark.range(300).selectExpr("id event_id", "1L user_id", "element_at(array('view', 'signup', 'purchase'), cast(id % 3 + 1 as int)) event_type").write.parquet(f"{tmp_path}/events.parquet")
    levels = {r["stride"]: r["count"] for r in queries.QUERIES["anchor_pyramid"](spark, str(tmp_path)).groupBy("stride").count().collect()}
    assert levels == {s: 3 * (-(-1120 // s)) ** 2 for s in (4, 8, 16, 32, 64)}
    assert queries.QUERIES["detector_output"](spark, str(tmp_path)).count() == 100
