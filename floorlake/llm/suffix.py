"""Removal of repeated passages: bytes covered by a long string that also starts elsewhere.

Every string of LENGTH bytes has an anchor, the position of the least hash among the GRAM-byte
strings inside it; equal strings have their anchors at the same place. A run of neighbouring
strings with one anchor is a context. Contexts whose anchors' GRAM bytes occur once in the corpus
match nothing; equal contexts match as wholes; the rest, contexts of one anchor that differ
somewhere, have their strings sorted by :mod:`deepshallow`, equal ones ending up side by side.
Contexts of a common anchor are narrowed down first: cut into pieces of BLOCK strings, which can
only have strings in common where they agree in all bytes that each of BLOCK such strings has. What is still
too many for one task is sorted in runs, in as many tasks, and the runs' distinct strings are then
merged by their places in the anchor's strings and 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.llm.deepshallow import sort_substrings
from floorlake.llm.shingles import BASE, INVERSE, U, _powers, mixed
from floorlake.staging import broadcast_if_small, scratch, small_batches, staged

LENGTH = 200
GRAM = 24
#: A text is hashed in pieces of so many strings.
PIECE = 1 << 20
#: Bytes of contexts that are sorted at a time, whole buckets of one anchor.
SLAB_BYTES = 1 << 20
#: Contexts, or pieces of contexts, that make a run. An anchor with more contexts is narrowed down.
RUN_CONTEXTS = 2000
#: Strings of a piece.
BLOCK = 16
ROW_SCHEMA = "doc_id long, node long, n_bytes long, gram array<long>, context array<long>, first array<long>, strings array<int>, offset array<int>"
_CACHE: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if base not in _CACHE or len(_CACHE[base]) < n:
        _CACHE[base] = _powers(base, max(n, 1 << 16))
    return _CACHE[base][:n]


def _least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring keys."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, U)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(text: bytes, length: int = LENGTH) -> list[np.ndarray]:
    """gram hash, context hash, first string, number of strings, and the anchor's offset from the first one, of each context."""
    parts: list[list[np.ndarray]] = []
    for piece in range(0, max(0, len(text) - length + 1), PIECE):
        raw = np.frombuffer(text[piece : piece + PIECE + length - 1], np.uint8)
        n = len(raw)
        prefix = np.zeros(n + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * _power_table(BASE, n), out=prefix[1:])
        back = _power_table(INVERSE, n + 1)
        grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * back[: n - GRAM + 1])
        # the position in the low bits makes the first of equal hashes the least
        key = (grams >> U(24) << U(24)) | np.arange(len(grams), dtype=U)
        anchor = (_least_in_windows(key, length - GRAM + 1) & U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.append(first, len(anchor)))
        at = anchor[first]
        end = first + count - 1 + length
        whole = mixed((prefix[end] - prefix[first]) * back[first] + (U(length) * count.astype(U) << U(20)) + (at - first).astype(U))
        parts.append([grams[at].view(np.int64), whole.view(np.int64), first + piece, count.astype(np.int32), (at - first).astype(np.int32)])
    if not parts:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def anchored(docs: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                some = b.iloc[at : at + 64]
                texts = [(t or "").encode() for t in some["text"]]
                found = [contexts(t, length) for t in texts]
                columns = dict(zip(("gram", "context", "first", "strings", "offset"), (list(x) for x in zip(*found, strict=True)), strict=True))
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").to_numpy(), "node": some["node"].to_numpy(), "n_bytes": [len(t) for t in texts]} | columns)

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text").mapInPandas(find, ROW_SCHEMA)


def _string_hashes(text: bytes, at: np.ndarray, length: int) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    prefix = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * _power_table(BASE, len(raw)))))
    return mixed((prefix[at + length] - prefix[at]) * _power_table(INVERSE, len(raw))[at]).view(np.int64)


def _pieces(length: int):  # noqa: ANN202
    """Contexts cut into pieces of strings whose places in the anchor's strings share a block; ``gram`` becomes a hash of gram, block and the bytes that all of a block's strings have."""

    def cut(b: pd.DataFrame) -> pd.DataFrame:
        text = b"".join(b["bytes"])
        raw = np.frombuffer(text, np.uint8)
        prefix = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * _power_table(BASE, len(raw)))))
        back = _power_table(INVERSE, len(raw) + 1)
        hashed = lambda x, y: mixed((prefix[y] - prefix[x]) * back[x])
        begin = np.concatenate(([0], np.cumsum(b["bytes"].str.len())))[:-1]
        most = b["offset"].to_numpy().astype(np.int64)  # place of the first string; places fall by one a string
        least = most - b["strings"].to_numpy() + 1
        n = most // BLOCK - least // BLOCK + 1
        row = np.repeat(np.arange(len(b)), n)
        block = (least // BLOCK)[row] + np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
        high, low = np.minimum(most[row], block * BLOCK + BLOCK - 1), np.maximum(least[row], block * BLOCK)
        anchor = (begin + most)[row]
        start, end = anchor - high, anchor - low + length
        core = hashed(anchor - block * BLOCK, anchor - (block * BLOCK + BLOCK - 1) + length)
        gram = mixed(core ^ mixed(b["gram"].to_numpy().view(U)[row] + block.astype(U)))
        piece = mixed(hashed(start, end) + (high << 16 | low).astype(U))
        return pd.DataFrame(
            {
                "gram": gram.view(np.int64),
                "context": piece.view(np.int64),
                "first": b["first"].to_numpy()[row] + most[row] - high,
                "strings": high - low + 1,
                "offset": high,
                "rows": b["rows"].to_numpy()[row],
                "node": b["node"].to_numpy()[row],
                "bytes": [text[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                yield cut(b.iloc[at : at + 500])

    return run


def sorted_strings(slab: pd.DataFrame, length: int) -> pd.DataFrame:
    """Sorts all strings of a slab's contexts. node, start, end of those that another context of the same run has too,
    and for buckets of several runs each distinct string with its gram, place and hash; ``lone`` if only one context of this run has it and only one row that.
    """
    if not len(slab):
        return pd.DataFrame(columns=["node", "start", "end", "gram", "place", "hash", "lone"])
    counts = slab["strings"].to_numpy()
    text = b"".join(slab["bytes"])
    begins = np.concatenate(([0], np.cumsum(slab["bytes"].str.len())))[:-1]
    row = np.repeat(np.arange(len(slab)), counts)
    inside = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
    at = begins[row] + inside
    order, group = sort_substrings(text, at, length)
    head = np.ones(len(order), bool)
    head[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(head)
    alone = np.repeat(np.diff(np.append(first, len(order))) == 1, np.diff(np.append(first, len(order))))
    once = slab["rows"].to_numpy() == 1
    node, start = slab["node"].to_numpy(), slab["first"].to_numpy()

    twin = np.zeros(len(row) + 1, bool)
    twin[order[~alone]] = True
    twin[:-1] &= once[row]
    # runs of marked strings; a context's first string never continues the one before
    opens = twin[:-1] & ~(np.concatenate(([False], twin[:-2])) & (inside > 0))
    closes = twin[:-1] & ~(twin[1:] & np.append(inside[1:] > 0, False))
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    spans = pd.DataFrame({"node": node[row[a]], "start": start[row[a]] + inside[a], "end": start[row[b]] + inside[b] + length})

    told = order[first]
    told = told[slab["runs"].to_numpy()[row[told]] > 1]
    is_alone = np.zeros(len(row), bool)
    is_alone[order[alone]] = True
    r = row[told]
    heads = pd.DataFrame(
        {"node": node[r], "start": start[r] + inside[told], "gram": slab["gram"].to_numpy()[r], "place": slab["offset"].to_numpy()[r] - inside[told], "hash": _string_hashes(text, at[told], length), "lone": is_alone[told] & once[r]}
    )
    return pd.concat([spans, heads]).astype({"end": "Int64", "gram": "Int64", "place": "Int64", "hash": "Int64", "lone": "boolean"})


SORTED = "node long, start long, end long, gram long, place long, hash long, lone boolean"


def _sort_slabs(length: int):  # noqa: ANN202
    def solve(slab: pd.DataFrame) -> pd.DataFrame:
        slab = slab.drop_duplicates(["gram", "context"])
        alone = (slab.groupby(["gram", "run"])["context"].transform("size") == 1) & (slab["runs"] == 1)
        return sorted_strings(slab[~alone].reset_index(drop=True), length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        last = None
        for b in batches:
            if not len(b):
                continue
            grams, runs = b["gram"].to_numpy(), b["run"].to_numpy()
            lengths = b["bytes"].str.len().to_numpy()
            cut = 0
            for at in np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (runs[1:] != runs[:-1]))):
                if at == 0 and last == (grams[0], runs[0]):
                    continue
                size_here = size + int(lengths[cut:at].sum())
                if size_here >= SLAB_BYTES:
                    yield solve(pd.concat([*held, b.iloc[cut:at]]))
                    held, size, cut = [], 0, at
            held.append(b.iloc[cut:])
            size += int(lengths[cut:].sum())
            last = (grams[-1], runs[-1])
        if held:
            yield solve(pd.concat(held))

    return run


FIELDS = ("gram", "context", "first", "strings", "offset", "rows", "runs")


def _context_bytes(length: int):  # noqa: ANN202
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 128):
                some = b.iloc[at : at + 128]
                parts = []
                for text, first, strings in zip(some["text"], some["first"], some["strings"], strict=True):
                    raw = (text or "").encode()
                    parts += [raw[x : x + n - 1 + length] for x, n in zip(first.tolist(), strings.tolist(), strict=True)]
                columns = {c: np.concatenate(some[c].to_list()) for c in FIELDS}
                yield pd.DataFrame(columns | {"node": np.repeat(some["node"].to_numpy(), some["first"].str.len()), "bytes": parts})

    return cut


def _spans(intervals: DataFrame) -> DataFrame:
    """node, spans: overlapping and touching intervals of a text joined, as sorted (start, end) structs."""
    before = Window.partitionBy("node").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("node").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = intervals.groupBy("node", "start").agg(F.max("end").alias("end")).withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    joined = opened.withColumn("span", F.sum("new").over(upto)).groupBy("node", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: doc_id, node (64-bit hash of the text), n_bytes. spans: node and its repeated byte ranges, for texts that have some."""
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    rows = staged(anchored(docs, length), "anchored", keep=True)
    with scratch(docs.sparkSession):
        spans = staged(_spans(_intervals(texts, rows, length)), "spans", keep=True)
    return rows.select("doc_id", "node", "n_bytes"), spans


def _intervals(texts: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """node, start, end of repeated ranges. What a join meets by gram or context is staged first, so that Spark can split a hot one."""
    runs = rows.select("node", F.inline(F.arrays_zip("gram", "context", "first", "strings", "offset")))
    grams = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).filter("n > 1")
    grams = staged(grams.select("gram", (F.col("lo") != F.col("hi")).alias("open")), "grams")
    shared = staged(runs.join(grams, "gram"), "shared")
    # of each context of an anchor, one row is looked at
    counted = shared.groupBy("gram", "context", "open").agg(*[F.first(c).alias(c) for c in ("node", "first", "strings", "offset")], F.count(F.lit(1)).alias("rows"))
    counted = staged(counted, "counted")
    # equal contexts match as wholes
    equal = counted.filter("rows > 1").select("gram", "context")
    whole = shared.join(equal, ["gram", "context"]).select("node", F.col("first").alias("start"), (F.col("first") + F.col("strings") - 1 + length).alias("end"))
    # anchors whose contexts all occur twice or more have nothing left to find
    shape = counted.filter("open").groupBy("gram").agg(F.count(F.lit(1)).alias("size"), F.min("rows").alias("least")).filter("least = 1")
    shape = staged(shape.select("gram", F.ceil(F.col("size") / RUN_CONTEXTS).alias("runs")), "shape")
    wanted = counted.filter("open").join(shape, "gram").groupBy("node").agg(F.collect_list(F.struct(*FIELDS)).alias("wanted"))
    wanted = wanted.select("node", *[F.col(f"wanted.{c}").alias(c) for c in FIELDS])
    named = rows.groupBy("node").agg(F.min("doc_id").alias("rep"))
    wanted = staged(wanted.join(named, "node"), "wanted")
    # one row of each text, however many copies it has
    sources = texts.join(wanted.withColumnRenamed("node", "key"), (F.col("node") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    made = sources.select("text", "node", *FIELDS).mapInPandas(
        _context_bytes(length), "gram long, context long, first long, strings int, offset int, rows long, runs long, node long, bytes binary"
    )
    cut = staged(made, "contexts")
    narrowed, equal_pieces = _narrowed(cut.filter("runs > 1"), length)
    dealt = cut.filter("runs = 1").unionByName(narrowed).withColumn("run", F.pmod(F.xxhash64(F.lit(9), "context"), "runs"))
    found = staged(dealt.repartition("gram", "run").sortWithinPartitions("gram", "run", "context").mapInPandas(_sort_slabs(length), SORTED), "sorted")
    heads = found.filter("end is null")
    twins = staged(heads.groupBy("gram", "place", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "twins")
    merged = heads.filter("lone").join(twins, ["gram", "place", "hash"], "left_semi").select("node", "start", (F.col("start") + length).alias("end"))
    return whole.union(equal_pieces).union(found.filter("end is not null").select("node", "start", "end")).union(merged)


def _narrowed(contexts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(pieces, intervals): of each differing piece that agrees with another in its core, one row; and where pieces are equal as wholes."""
    kind = "gram long, context long, first long, strings int, offset int, rows long, node long, bytes binary"
    pieces = staged(contexts.mapInPandas(_pieces(length), kind), "pieces")
    cores = staged(pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "cores")
    alike = staged(pieces.join(broadcast_if_small(cores), "gram"), "alike")
    counted = staged(alike.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    equal = broadcast_if_small(staged(counted.filter("n > 1"), "equal-pieces"))
    intervals = alike.filter("rows = 1").join(equal, ["gram", "context"]).select("node", F.col("first").alias("start"), (F.col("first") + F.col("strings") - 1 + length).alias("end"))
    sizes = staged(counted.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("gram", F.ceil(F.col("size") / RUN_CONTEXTS).alias("runs")), "piece-groups")
    open_ = alike.join(broadcast_if_small(sizes), "gram").dropDuplicates(["gram", "context"])
    rest = open_.join(equal, ["gram", "context"], "left").withColumn("rows", F.greatest("rows", "n")).drop("n")
    return rest, intervals


def _cut(raw: bytes, spans: list) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` (the bytes left) for each row of ``docs``.

    A byte goes if a string of ``length`` bytes around it also starts anywhere else, in the same
    text or another, overlaps included; all is judged on the input. A null text is empty; texts
    shorter than ``length`` keep all; repeated rows are copies like others; an empty table gives
    no rows. Strings count as equal when two 64-bit hashes or the bytes themselves do.
    Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    _, spans = repeated_spans(docs, length)
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    joined = texts.join(broadcast_if_small(spans), "node", "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, found in b.itertuples(index=False, name=None):
                raw = (text or "").encode()
                found = [] if found is None else list(found)
                kept = _cut(raw, found)
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(raw), len(raw) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], dtype=object)

    out = joined.mapInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
