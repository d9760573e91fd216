"""Tables staged in the folder that all executors share, and joins that broadcast small ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine gets a temporary one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='floorlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that a Python function gets at a time, or one row where that is larger.
BATCH_BYTES = 8 << 20
#: A staged table of up to so many bytes is broadcast.
BROADCAST_BYTES = 4 << 20
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python functions of this session get by BATCH_BYTES, unless the session bounds them lower."""
    now = spark.conf.get(ARROW_BYTES).rstrip("b")
    if not (now.isdigit() and int(now) <= BATCH_BYTES):
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end, but for those staged with ``keep``."""
    path = f"{shared_dir(spark)}/floorlake-{uuid.uuid4().hex}"
    token = _RUN.set(path)
    try:
        yield
    finally:
        _RUN.reset(token)
        fs, where = _folder(spark, path)
        fs.delete(where, True)


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path for a table in the shared folder, or in that of the :func:`scratch` around."""
    run = None if keep else _RUN.get()
    return f"{run or shared_dir(spark)}/floorlake-{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a written table removed when the driver ends."""
    fs, where = _folder(spark, path)
    fs.deleteOnExit(where)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder, now, and read back, which cuts its lineage.

    A :func:`scratch` around removes it at its end, unless ``keep``; otherwise it goes when the driver ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_folder(spark, name, keep)
    df.write.parquet(path)
    if keep or not _RUN.get():
        until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast if Spark's own estimate of ``df`` is ``max_bytes`` at most; else the join is left to Spark.

    For a staged table the estimate is the size of its files.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= max_bytes else df


def by_image(df: DataFrame) -> DataFrame:
    """``df`` dealt by image_id over as many tasks as the session shuffles to, so that windows and groups inside an image need no shuffle.

    For rows that are yet to become many: adaptive execution would size tasks by the few bytes that these have.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as the session shuffles to, whatever shuffled it before.

    By a hash of the keys: a shuffle that a step before needs by the keys themselves would stand for this one, and adaptive execution may split or skip that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def group_starts(columns: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Places in sorted columns at which a group begins, the first one too."""
    first = columns[keys[0]]
    new = np.ones(len(first), bool)
    # nulls are nan here, and of one group
    differ = lambda a, b: (a != b) & ((a == a) | (b == b))
    new[1:] = np.logical_or.reduce([differ(columns[k][1:], columns[k][:-1]) for k in keys])
    return np.flatnonzero(new)


def by_groups(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[dict[str, np.ndarray]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``solve`` gets the columns of many whole groups at a time, sorted by ``keys`` and ``order``, so that small groups cost no call each.

    A call gets a batch of Arrow at most, and the group that goes on beyond it. Dealt by ``keys`` over
    as many tasks as the session shuffles to. Whole numbers with nulls among them come as floats, nulls as nan, and go back as they were.
    """
    names, whole_numbers = df.columns, [part.split()[0] for part in schema.split(", ") if part.endswith(" long")]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        whole = lambda parts: {c: np.concatenate([p[c] for p in parts]) for c in names}

        def solved(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for out in solve(columns):
                for c in whole_numbers:
                    if c in out.schema.names and pa.types.is_floating(out.schema.field(c).type):
                        back = pa.array(out.column(c).to_numpy(zero_copy_only=False), from_pandas=True).cast(pa.int64())
                        out = out.set_column(out.schema.get_field_index(c), c, back)
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            own = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            last = int(group_starts(own, keys)[-1])
            if held and (last or len(group_starts({k: np.array([held[-1][k][-1], own[k][0]]) for k in keys}, keys)) > 1):
                yield from solved(whole([*held, {c: v[:last] for c, v in own.items()}]))
                held = []
            elif last:
                yield from solved({c: v[:last] for c, v in own.items()})
            held.append({c: v[last:] for c, v in own.items()})
        if held:
            yield from solved(whole(held))

    return dealt(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
