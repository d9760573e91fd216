"""Reports over detections and images as files of them arrive. Every operator is per image, so a batch is whole by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from floorlake.plans.reports import accuracy_report
from floorlake.schemas import DETECTIONS


def arriving(spark: SparkSession, path: str, schema: str = DETECTIONS, max_files: int = 100) -> DataFrame:
    """Rows of Parquet files as they appear under ``path``; an image's rows come in one file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def each_batch(stream: DataFrame, report: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends ``report(batch)`` to Parquet at ``out``; ``once`` ends with the files there are. A repeated batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        report(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_accuracy(spark: SparkSession, detections: str, images: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The accuracy report of each image whose detections arrive."""

    def report(batch: DataFrame) -> DataFrame:
        seen = batch.select("image_id").distinct()
        return accuracy_report(batch, images.join(seen, "image_id", "left_semi"))

    return each_batch(arriving(spark, detections), report, out, checkpoint)
