"""Reproducible shuffle into shards: a Feistel permutation over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.llm.common import set_aside

SEED = "floorlake-1"
ROUNDS = 6
#: Row-number buckets: an even split of the key space, so that each is sorted in one task.
ROWS_PER_BUCKET = 20_000
MAX_BUCKETS = 1 << 20


def row_key(doc_id: Column, text: Column) -> Column:
    """Hex key of a row: fixes its place in the global numbering, whatever the partitioning."""
    flag = F.when(text.isNull(), F.lit("0")).otherwise(F.lit("1"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), flag, F.coalesce(text, F.lit(""))).cast("binary"))


def hex32(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def number_rows(df: DataFrame, key: str, n_rows: int, out: str) -> DataFrame:
    """Adds ``out``: 0 to n_rows - 1 in the order of the hex column ``key``.

    The key space is cut into equal buckets; each bucket is numbered on its own and shifted by
    the rows of the buckets before it, so no task sees more than a bucket. Rows with equal keys
    take neighbouring numbers, in the order of a hash of their columns (maps left out).
    """
    columns = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    n_buckets = min(MAX_BUCKETS, max(1, math.ceil(n_rows / ROWS_PER_BUCKET)))
    df = df.withColumn("__bucket", F.shiftright(hex32(F.col(key)) * F.lit(n_buckets), 32))
    sizes = df.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(key, F.xxhash64(*columns))) - 1
    # at most MAX_BUCKETS rows of two longs: the broadcast is bounded
    return (
        df.withColumn("__inside", inside)
        .join(F.broadcast(starts), "__bucket")
        .withColumn(out, F.col("__start") + F.col("__inside"))
        .drop("__bucket", "__inside", "__start")
    )


def _round(value: Column, key: Column, modulus: int, seed: str) -> Column:
    text = F.concat_ws(":", F.lit(seed), key.cast("string"), value.cast("string"))
    return F.pmod(hex32(F.md5(text.cast("binary"))), F.lit(modulus).cast("long"))


def permuted(index: Column, n: int, seed: str = SEED) -> Column:
    """A permutation of 0..n-1 at ``index``: a Feistel network over a grid of about sqrt(n) x sqrt(n) cells, with cycle walking.

    The grid has fewer than sqrt(n) + 1 cells too many. A walk visits each of those once at most,
    which bounds it exactly, and only rows that land on one of them walk at all.
    """
    rows = math.isqrt(max(n - 1, 0)) + 1
    cols = max(1, -(-n // rows))

    def network(x: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            left, right = s["l"], s["r"]
            return F.when(k % 2 == 0, F.struct(left.alias("l"), ((right + _round(left, k, cols, seed)) % cols).alias("r"))).otherwise(
                F.struct(((left + _round(right, k, rows, seed)) % rows).alias("l"), right.alias("r"))
            )

        start = F.struct(F.floor(x / cols).cast("long").alias("l"), (x % cols).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * cols + s["r"])

    def walked(first: Column) -> Column:
        further = F.aggregate(F.sequence(F.lit(1), F.lit(rows * cols - n + 1)), first, lambda x, _: F.when(x < n, x).otherwise(network(x)))
        return F.when(first < n, first).otherwise(further)

    return F.get(F.transform(F.array(network(index.cast("long"))), walked), F.lit(0))


def feistel_shards(df: DataFrame, key: str, n_shards: int = 16, seed: str = SEED) -> DataFrame:
    """Adds ``shard`` and ``slot``: shard sizes differ by one row at most, slots are gapless from 0.

    ``key`` is a hex column (see :func:`row_key`). A row's place follows from its global number i:
    with p = permuted(i), shard = p mod n_shards and slot = p div n_shards. Columns of the same
    names are replaced; other columns pass through. Repeated rows each get a place of their own;
    an empty input gives an empty result. Null ids and texts are part of the key.
    """
    n = df.count()
    df = df.drop("shard", "slot")
    numbered = number_rows(df, key, n, "__number")
    placed = numbered.withColumn("__place", permuted(F.col("__number"), n, seed))
    return placed.withColumns({"shard": (F.col("__place") % n_shards).cast("int"), "slot": F.floor(F.col("__place") / n_shards).cast("long")}).drop("__number", "__place")


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: str = SEED) -> DataFrame:
    """Whole documents with ``shard`` and ``slot``; see :func:`feistel_shards`."""
    docs, named_back = set_aside(docs)
    keyed = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text")))
    return named_back(feistel_shards(keyed, "__key", n_shards, seed).drop("__key"))


def place_of(doc_index: int, n: int, n_shards: int = 16, seed: str = SEED) -> tuple[int, int]:
    """Shard and slot of one global row number, computed without the table."""
    import hashlib

    rows = math.isqrt(max(n - 1, 0)) + 1
    cols = max(1, -(-n // rows))
    x = doc_index
    while True:
        left, right = divmod(x, cols)
        for k in range(ROUNDS):
            digest = lambda v: int(hashlib.md5(f"{seed}:{k}:{v}".encode()).hexdigest()[:8], 16)  # noqa: B023, E731
            if k % 2 == 0:
                right = (right + digest(left) % cols) % cols
            else:
                left = (left + digest(right) % rows) % rows
        x = left * cols + right
        if x < n:
            return x % n_shards, x // n_shards
