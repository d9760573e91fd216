"""Reports as JSON files, and the number of the next run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prefixes of the files a run leaves.
PREFIXES = "plan|vis|acc|final"


def as_json(df: DataFrame, key: str = "image_id", out: str = "report") -> DataFrame:
    """``key`` and all columns as one JSON text."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias(out))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def next_run_number(files: DataFrame, column: str = "name") -> DataFrame:
    """next_number: one more than the largest first number in names of run files, 1 if there is none."""
    name = F.col(column)
    own = files.filter(name.rlike(rf"^({PREFIXES}).*\.(json|png)$"))
    return own.select((F.coalesce(F.max(F.try_to_number(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long")), F.lit(0)) + 1).alias("next_number"))
