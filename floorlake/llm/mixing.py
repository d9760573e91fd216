"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.llm.common import set_aside
from floorlake.staging import staged

BLOCK_ROWS = 64
#: Default weights: rows of a source to this power, but no source is gone through more often than MAX_EPOCHS.
POWER = 0.8
MAX_EPOCHS = 4.0
SEED = 17
#: Rows of a source are numbered in buckets of about this size.
BUCKET_ROWS = 4096
#: Epochs of a bucket that meet its rows at a time.
EPOCHS_AT_ONCE = 64
#: Slots that one task schedules.
FRAME_SLOTS = 4096
#: The list of sources is a setting, not data; a longer one is an error.
MAX_SOURCES = 65_536
#: Weights are held as integers over this sum, so that all window arithmetic is exact.
SCALE = 1 << 30


def default_weights(rows: Mapping[str, int]) -> dict[str, float]:
    most = max(rows.values(), default=1)
    return {s: n * min(MAX_EPOCHS, (most / n) ** (1 - POWER)) for s, n in rows.items()}


def whole_weights(weights: list[float]) -> list[int]:
    """Integers of at least 1 that sum up to SCALE, in proportion to the weights: largest remainders."""
    total = sum(Fraction(w) for w in weights)
    shares = [Fraction(w) / total * (SCALE - len(weights)) for w in weights]
    out = [int(x) for x in shares]
    order = sorted(range(len(out)), key=lambda i: (out[i] - shares[i], i))
    for i in order[: SCALE - len(weights) - sum(out)]:
        out[i] += 1
    return [x + 1 for x in out]


def _state(weights: list[int], t: int, low: list[int], high: list[int]) -> list[int]:
    """Blocks of each source in the first t slots: floor or ceiling of its share, between ``low`` and ``high``, t in all."""
    counts = [max(w * t // SCALE, a) for w, a in zip(weights, low, strict=True)]
    room = [min(-(-w * t // SCALE), b) - c for w, b, c in zip(weights, high, counts, strict=True)]
    missing = t - sum(counts)
    for i in sorted((i for i, r in enumerate(room) if r > 0), key=lambda i: (-(weights[i] * t % SCALE), i))[:missing]:
        counts[i] += 1
    return counts


def frame_states(weights: list[int], n_slots: int, frame: int) -> tuple[int, int, list[int], list[int]]:
    """First slot, end, and the blocks of each source before both, for one frame of the schedule.

    States are fixed by halving the schedule, so any task can find those of its frame by itself.
    A schedule of unit blocks within their windows exists between any two such states: every
    interval has room for the windows that lie inside it.
    """
    n_frames = -(-n_slots // FRAME_SLOTS)
    a, b = 0, n_frames
    end = n_frames * FRAME_SLOTS
    low = [0] * len(weights)
    high = _state(weights, end, low, [end] * len(weights))
    while b - a > 1:
        middle = (a + b) // 2
        state = _state(weights, middle * FRAME_SLOTS, low, high)
        if frame < middle:
            b, high = middle, state
        else:
            a, low = middle, state
    return a * FRAME_SLOTS, b * FRAME_SLOTS, low, high


def schedule_frame(weights: list[int], n_slots: int, frame: int) -> list[tuple[int, int, int, int, int]]:
    """(slot, source, block of the source, release, deadline) of a frame: earliest deadline first among released blocks.

    Block k of a source with share w may run in slots floor(k / w) to ceil((k + 1) / w) - 1, cut to
    the frame. Ties go to the smaller source number.
    """
    start, end, low, high = frame_states(weights, n_slots, frame)
    waiting: list[tuple[int, int, int]] = []  # release, source, block
    for s, (k, last) in enumerate(zip(low, high, strict=True)):
        if k < last:
            heapq.heappush(waiting, (max(start, k * SCALE // weights[s]), s, k))
    ready: list[tuple[int, int, int, int]] = []  # deadline, source, block, release
    out = []
    for slot in range(start, end):
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (min(end, -(-(k + 1) * SCALE // weights[s])), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        assert slot < deadline, "a block missed its window"
        if slot < n_slots:
            out.append((slot, s, k, k * SCALE // weights[s], -(-(k + 1) * SCALE // weights[s])))
        if k + 1 < high[s]:
            heapq.heappush(waiting, (max(slot + 1, (k + 1) * SCALE // weights[s]), s, k + 1))
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED, order_columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with mix_slot, mix_block, mix_epoch, mix_release, mix_deadline, mix_position.

    Each source's rows, in the order of a seeded hash of ``order_columns``, are cut into blocks of ``block_rows``; slot t of the
    mix takes one block, and after any number t of slots a source with share w has had between
    t w - 1 and t w + 1 of them, bounds excluded. The mix is as long as it takes for every row to come up
    once; sources whose weight exceeds their share of the rows start over (mix_epoch 1, 2 ...), so
    such rows appear again. No row is left out. A position is the slot times ``block_rows`` plus
    the place in the block; a bucket's last block may be short. Weights default to
    :func:`default_weights`; given ones must name every source and be positive. A null source is
    a source of its own; null ids and texts and repeated rows are rows like others; an empty table gives an empty
    result. Columns of the six names are replaced, all others stay as they are.
    """
    spark = docs.sparkSession
    added = ["mix_slot", "mix_block", "mix_epoch", "mix_release", "mix_deadline", "mix_position"]
    docs, named_back = set_aside(docs.drop(*added))
    # a null source gets a name that starts with a control character of its own
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    order = F.xxhash64(F.lit(seed), *order_columns)
    sizes = {r["s"]: r["n"] for r in docs.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted(sizes)
    plain = {s: (s[1:] if s[0] == "=" else None) for s in names}
    wanted = default_weights(sizes) if weights is None else {s: weights[plain[s]] for s in names}
    if any(not wanted[s] > 0 for s in names):
        raise ValueError("weights must be positive")

    n_buckets = {s: max(1, -(-sizes[s] // BUCKET_ROWS)) for s in names}
    listed = spark.createDataFrame([(s, i, n_buckets[s]) for i, s in enumerate(names)], "__s string, __source int, __buckets int")
    placed = (
        docs.withColumns({"__s": source, "__order": order})
        .join(F.broadcast(listed), "__s")  # MAX_SOURCES rows at most
        .withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__order"), F.col("__buckets").cast("long")))
        .drop("__s", "__buckets")
    )
    # blocks of each bucket, and the number of its first block within the source
    filled = staged(placed.groupBy("__source", "__bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("__blocks")), "mix-buckets")
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = filled.withColumn("__first", F.coalesce(F.sum("__blocks").over(before), F.lit(0)))
    blocks = {r[0]: r[1] for r in filled.groupBy("__source").agg(F.sum("__blocks")).collect()}  # a row a source
    shares = whole_weights([wanted[s] for s in names]) if names else []
    n_slots = max((-(-blocks[i] * SCALE // w) for i, w in enumerate(shares)), default=0)
    n_frames = -(-n_slots // FRAME_SLOTS)
    sent = spark.sparkContext.broadcast(shares)

    def schedule(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for frame in batch["id"]:
                yield pd.DataFrame(schedule_frame(sent.value, n_slots, int(frame)), columns=["slot", "source", "k", "release", "deadline"])

    slots = spark.range(0, n_frames, 1, max(1, min(n_frames, 2000))).mapInPandas(schedule, "slot long, source int, k long, release long, deadline long")
    # how often each source is gone through, in parts of EPOCHS_AT_ONCE: more than one part only where weights are far from the rows' shares
    parts = {i: -(-(-(-shares[i] * n_slots // SCALE)) // (n * EPOCHS_AT_ONCE)) for i, n in blocks.items()}
    rounds = spark.createDataFrame([(i, n, parts[i]) for i, n in sorted(blocks.items())], "__source int, in_round long, __parts long")
    turns = slots.withColumnRenamed("source", "__source").join(F.broadcast(rounds), "__source").select(
        "__source", (F.col("k") % F.col("in_round")).alias("__k"), F.floor(F.col("k") / F.col("in_round")).alias("epoch"), "slot", "release", "deadline"
    )
    # a bucket's turns of a part meet in one row: (BUCKET_ROWS / block_rows) x EPOCHS_AT_ONCE of them at most
    firsts = buckets.select("__source", "__bucket", F.posexplode(F.sequence(F.col("__first"), F.col("__first") + F.col("__blocks") - 1)).alias("__i", "__k"))
    dealt = turns.join(firsts, ["__source", "__k"]).withColumn("__part", F.floor(F.col("epoch") / EPOCHS_AT_ONCE))
    by_block = dealt.groupBy("__source", "__bucket", "__part", "__i").agg(F.collect_list(F.struct("slot", "epoch", "__k", "release", "deadline")).alias("turns"))
    by_bucket = by_block.groupBy("__source", "__bucket", "__part").agg(F.map_from_entries(F.collect_list(F.struct("__i", "turns"))).alias("__turns"))
    inside = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__order")) - 1
    numbered = placed.withColumn("__inside", inside)
    if max(parts.values(), default=1) > 1:
        numbered = numbered.join(F.broadcast(rounds.select("__source", "__parts")), "__source").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
        numbered = numbered.join(by_bucket, ["__source", "__bucket", "__part"])
    else:  # rows stay where their numbers were given
        numbered = numbered.join(by_bucket.drop("__part"), ["__source", "__bucket"])
    turn = F.explode(F.element_at("__turns", F.floor(F.col("__inside") / block_rows).cast("int")))
    return named_back(
        numbered.select(*docs.columns, "__inside", turn.alias("__turn")).select(
            *docs.columns,
            F.col("__turn.slot").alias("mix_slot"),
            F.col("__turn.__k").alias("mix_block"),
            F.col("__turn.epoch").alias("mix_epoch"),
            F.col("__turn.release").alias("mix_release"),
            F.col("__turn.deadline").alias("mix_deadline"),
            (F.col("__turn.slot") * block_rows + F.col("__inside") % block_rows).alias("mix_position"),
        )
    )
