"""Chat formatting: logged snapshots of one conversation collapse into the longest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place ``j`` from 1 and two 64-bit hashes of (place, role, text)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("__t").asc_nulls_last())
    base = turns.select(
        "conv_id", "turn", "role", F.coalesce(F.xxhash64(F.lit(1), F.col("text").isNull(), "text"), F.lit(0)).alias("__t"), F.xxhash64(F.lit(2), "text").alias("__u")
    )
    placed = base.withColumn("j", F.row_number().over(order))
    return placed.select(
        "conv_id",
        "j",
        F.xxhash64(F.lit(11), "j", F.col("role").isNull(), "role", "__t", "__u").alias("a"),
        F.xxhash64(F.lit(12), "j", F.col("role").isNull(), "role", "__t", "__u").alias("b"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """For each turn: conv_id, place j, n turns of the conversation, and the rolling hash (a, b) of turns 1 to j.

    The hash of a prefix is the exclusive-or of its turns' place-keyed hashes, so a window rolls
    it forward turn by turn; 128 bits identify a prefix.
    """
    rolling = Window.partitionBy("conv_id").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    return _numbered(turns).select(
        "conv_id", "j", F.count(F.lit(1)).over(whole).alias("n"), F.bit_xor("a").over(rolling).alias("a"), F.bit_xor("b").over(rolling).alias("b")
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_same of each conversation that no longer one starts with.

    Of equal conversations the smallest conv_id stays; n_same counts them. Prefixes are
    pre-aggregated to one row each before the anti-join, so a first turn that a third of all
    conversations share is one row there. Turns with a null conv_id form one conversation.
    """
    prefixes = prefix_hashes(turns).groupBy("j", "a", "b").agg(
        F.max("n").alias("longest"), F.min(F.when(F.col("n") == F.col("j"), F.col("conv_id"))).alias("conv_id"), F.count_if(F.col("n") == F.col("j")).alias("n_same")
    )
    ends = prefixes.filter(F.col("n_same") > 0)
    continued = prefixes.filter(F.col("longest") > F.col("j")).select("j", "a", "b")
    return ends.join(continued, ["j", "a", "b"], "left_anti").select("conv_id", F.col("j").cast("long").alias("n_turns"), "n_same")


def render_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_same and ``chat`` of each maximal conversation.

    Each turn renders as ``<|role|>``, a line break, its text and ``<|end|>``, joined by line
    breaks, in the order of turn, then role and text. A null role renders as ``unknown``, a null
    text as nothing; turns that share a number all stay; an empty table gives no rows. One chat
    is one value, so a conversation must fit a row. Extra columns are ignored.
    """
    keep = maximal_conversations(turns).withColumnRenamed("conv_id", "__keep")
    part = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>"))
    kept = turns.select("conv_id", "turn", "role", "text").join(keep, F.col("conv_id").eqNullSafe(F.col("__keep")))
    t = F.coalesce(F.xxhash64(F.lit(1), F.col("text").isNull(), "text"), F.lit(0))
    # nulls last: the flag sorts ahead of the value
    item = F.struct(F.col("turn").isNull().alias("f"), "turn", F.col("role").isNull().alias("g"), "role", t.alias("t"), part.alias("part"))
    return (
        kept.groupBy("conv_id", "n_turns", "n_same")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select("conv_id", "n_turns", "n_same", F.array_join(F.transform("items", lambda x: x["part"]), "\n").alias("chat"))
    )
