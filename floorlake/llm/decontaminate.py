"""Benchmark decontamination: short test items found inside long documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorlake.llm.common import let, set_aside, text_key, words
from floorlake.staging import broadcast_if_small, staged

WORDS = 5
CONTAINMENT = 0.8


def _lower_words(text: Column) -> Column:
    return words(F.lower(text))


def _shingle_hashes(w: Column, length: int) -> Column:
    """64-bit hashes of all runs of ``length`` words, repeats included."""

    def hashed(h: Column) -> Column:
        run = lambda i: F.xxhash64(F.lit(length), *[F.get(h, i + k) for k in range(length)])
        return F.when(F.size(h) < length, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - length), run))

    return let(F.transform(w, lambda x: F.xxhash64(x)), hashed)


def _shingles(w: Column, length: Column | int) -> Column:
    """The distinct runs of ``length`` words themselves, joined by single spaces."""
    length = F.lit(length) if isinstance(length, int) else length

    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - length + 1), lambda i: F.array_join(F.slice(w, i, length), " "))
        return F.when((F.size(w) < length) | (length < 1), F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return let(w, made)


def item_sketches(benchmark: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """(items, sketches). items: item_id, length, shingles, size. sketches: item_id, length, size, hash.

    Items are partitioned by set size into powers of two. A partition with upper bound u keeps
    the bottom-k MinHash sketch with k = floor((1 - containment) u) + 1: a document that holds the
    given share of an item can lack at most k - 1 of its shingles, so it shares a sketch value
    with certainty. An item of fewer than n words is one shingle of its own length.
    """
    w = _lower_words(F.col("text"))
    items = (
        benchmark.select("item_id", w.alias("__w"))
        .withColumn("length", F.least(F.size("__w"), F.lit(n)))
        .filter("length > 0")
        .withColumn("shingles", _shingles(F.col("__w"), F.col("length")))
        .withColumn("size", F.size("shingles"))
    )
    upper = F.pow(F.lit(2), F.ceil(F.log2("size"))).cast("int")
    hashes = F.coalesce(*[F.when(F.col("length") == k, _shingle_hashes(F.col("__w"), k)) for k in range(1, n + 1)])
    # the order of the sketch is a second hash of the first
    ordered = F.array_sort(F.transform(F.array_distinct(hashes), lambda h: F.struct(F.xxhash64(F.lit(7), h).alias("order"), h.alias("hash"))))
    k = F.floor(upper * (1 - containment) + 1e-9).cast("int") + 1
    sketches = items.select("item_id", "length", "size", F.explode(F.slice(ordered, 1, k)).alias("s")).select("item_id", "length", "size", F.col("s.hash").alias("hash"))
    return items.select("item_id", "length", "shingles", "size"), sketches


def contained_items(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """key (of the text), item_id, containment: the items of which a text holds the given share or more.

    Sketch values are looked up among all shingles of all documents; the pairs found are verified
    on the shingles themselves. A text and its copies count once.
    """
    items, sketches = item_sketches(benchmark, n, containment)
    items, sketches = staged(items, "items"), staged(sketches.dropDuplicates(), "sketches")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # n rows at most
    hashed = docs.select(
        text_key(F.col("text")).alias("key"),
        let(_lower_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.concat(F.array().cast("array<long>"), *[_shingle_hashes(w, k) for k in lengths]).alias("hashes"))).alias("__h"),
    )
    probes = hashed.filter(F.size("__h.hashes") > 0).select("key", F.col("__h.n_words").alias("n_words"), F.explode("__h.hashes").alias("hash"))
    long_enough = F.col("n_words") - F.col("length") + 1 >= F.ceil(F.col("size") * containment - 1e-9)
    found = probes.join(broadcast_if_small(sketches), "hash").filter(long_enough).groupBy("key", "item_id").agg(F.lit(1).alias("__one")).drop("__one")
    candidates = staged(found, "candidates")
    # copies of a text are verified once
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(broadcast_if_small(candidates.select("key").distinct()), "key", "left_semi")
    pairs = candidates.join(texts.dropDuplicates(["key"]), "key").join(items, "item_id")
    share = F.size(F.array_intersect("shingles", _shingles(_lower_words(F.col("text")), F.col("length")))) / F.col("size")
    return pairs.select("key", "item_id", share.alias("containment")).filter(F.col("containment") >= containment)


def _flagged(docs: DataFrame, benchmark: DataFrame, n: int, containment: float) -> DataFrame:
    held = contained_items(docs, benchmark, n, containment)
    by_text = staged(
        held.groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_set("item_id")).alias("__items"), F.max("containment").alias("__containment")), "contaminated"
    )
    return docs.withColumn("__key", text_key(F.col("text"))).join(broadcast_if_small(by_text), "__key", "left").drop("__key")


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_items, item_ids, max_containment (6 digits), contaminated, kept; a row for each row of ``docs``.

    Words are runs of other than ASCII white space, in lower case. A null or empty text holds
    nothing; null or empty items are ignored; items with equal ids count once in the list; an
    empty table of either kind is fine. Extra columns are ignored.
    """
    flagged = _flagged(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), n, containment)
    hit = F.col("__items").isNotNull()
    return flagged.select(
        "doc_id",
        F.coalesce(F.size("__items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("__items").cast("array<string>"), ","), F.lit("")).alias("item_ids"),
        F.round(F.coalesce("__containment", F.lit(0.0)), 6).alias("max_containment"),
        hit.alias("contaminated"),
        (~hit).alias("kept"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they were."""
    docs, named_back = set_aside(docs)
    return named_back(_flagged(docs, benchmark.select("item_id", "text"), n, containment).filter(F.col("__items").isNull()).select(*docs.columns))
