"""Vocabularies from tables, pixel arrays, settings and ground truth from masks."""

import pytest
from pyspark.sql import functions as F

from floorlake import schemas, settings
from floorlake.operators import masks, pixels, texts
from floorlake.sources import vocabulary


def test_a_large_vocabulary(spark, monkeypatch):
    terms = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "ko").otherwise("en").alias("lang"), F.concat(F.lit("zq"), F.col("id").cast("string"), F.lit(" wing")).alias("term"))
    terms = terms.unionByName(spark.createDataFrame([("en", None), ("en", " "), (None, "zq1 wing"), ("en", "zq1 wing")], "lang string, term string"))
    found = vocabulary.vocabulary(terms)
    assert len(found["english"]) == 4000 + 1 and len(found["korean"]) == 1000
    images = spark.createDataFrame([(1, 1000.0, 1000.0, 1.0)], schemas.IMAGES)
    rows = [(1, i, text, 400.0, 400.0, 460.0, 430.0, 0.9, "original") for i, text in enumerate(["zq1 wing", "Zq4999 Wing", "north wing", "my mark here"])]
    regions = spark.createDataFrame(rows, schemas.TEXT_REGIONS)
    reasons = lambda **k: [r["reject_reason"] for r in texts.room_reasons(regions, images, **k).orderBy("region_id").collect()]
    marks = vocabulary.watermarks(spark.createDataFrame([("MY mark",), (None,)], "term string"))
    assert reasons(**found, watermarks=marks) == [None, None, "descriptive", "watermark"]
    assert reasons() == ["descriptive", "descriptive", "descriptive", None]
    monkeypatch.setattr(vocabulary, "MOST_TERMS", 10)
    with pytest.raises(ValueError, match="more than"):
        vocabulary.vocabulary(terms)


def test_pixels(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first()["x"]
    whole = lambda *x: F.array(*map(F.lit, x))
    assert one(pixels.to_rgb(whole(1, 2), F.lit(1))) == [1, 1, 1, 2, 2, 2]
    assert one(pixels.to_rgb(whole(1, 2, 3, 9, 4, 5, 6, 9), F.lit(4))) == [1, 2, 3, 4, 5, 6]
    assert one(pixels.to_rgb(whole(1, 2, 3), F.lit(3))) == [1, 2, 3] and one(pixels.to_rgb(whole(1, 2), F.lit(2))) is None
    assert one(pixels.molded(whole(124, 117, 104, 0, 0, 0))) == pytest.approx([0.3, 0.2, 0.1, -123.7, -116.8, -103.9])
    assert one(pixels.unmolded(pixels.molded(whole(5, 6, 7, 250, 0, 1)))) == [5, 6, 7, 250, 0, 1]


def test_settings(spark):
    assert settings.settings(spark).log_level == "DEBUG" and settings.settings(spark, "nowhere") == settings.DEVELOPMENT
    spark.conf.set(settings.ENVIRONMENT, "production")
    assert settings.settings(spark).cache_timeout == 600 and settings.settings(spark, "testing").enable_caching is False
    spark.conf.unset(settings.ENVIRONMENT)


def test_ground_truth_from_masks(spark):
    runs = spark.createDataFrame([(1, 1, 2, 5, 10, 20), (1, 1, 2, 6, 12, 25), (1, 2, 1, 0, 4, 4), (1, 3, 3, 0, 0, 1)], schemas.MASK_RUNS)
    images = spark.createDataFrame([(1, 100.0, 50.0, 1.0)], schemas.IMAGES)
    assert {tuple(r) for r in masks.ground_truth(runs).collect()} == {(1, 1, 2, 5, 10, 7, 25), (1, 3, 3, 0, 0, 1, 1)}
    assert [tuple(r) for r in masks.ground_truth(masks.flipped_runs(runs, images), [2]).collect()] == [(1, 1, 2, 5, 75, 7, 90)]
