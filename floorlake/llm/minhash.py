"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorlake.llm import shingles
from floorlake.llm.common import set_aside
from floorlake.llm.components import components
from floorlake.staging import broadcast_if_small, scratch, staged

BANDS, ROWS = 32, 4
PERCENT = 80
#: Values compared at a time, and the probability, given those compared so far, below which a pair is given up.
BATCH = 16
MISS = 1e-6
#: Buckets of up to so many members are resolved by joining members of different components; larger ones block by block.
SMALL_BUCKET = 64
#: Shingles of a block of members: a task holds two blocks, each larger by one member's set at most.
BLOCK_SHINGLES = 1 << 18
SIGNED = "doc_id long, node long, n_shingles long, bands array<long>, signature binary"


@cache
def least_matches(n_hashes: int, percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """After n values, the fewest matches with which similarity may still reach the threshold with probability ``miss`` or more.

    The prior of the similarity is uniform; a value matches with probability s + (1 - s) / 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = {}
    for n in range(BATCH, n_hashes + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            density = np.exp(log - log.max())
            if density[s >= percent / 100].sum() / density.sum() >= miss:
                out[n] = m
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For rows of two signature arrays: False where a batch's posterior gave the pair up."""
    alive = np.arange(len(a))
    seen = np.zeros(len(a), int)
    for n, m in least_matches(a.shape[1], percent).items():
        seen[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
        alive = alive[seen[alive] >= m]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, node (64-bit hash of the text), n_shingles, bands and a signature of one byte a hash, for each row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(t or "").encode() for t in b["text"]]
            for some in shingles.chunks(texts):
                h, ends = shingles.shingle_sets([texts[i] for i in some], n)
                sizes = np.diff(np.concatenate(([0], ends)))
                values = shingles.signatures(h, ends, BANDS * ROWS)
                bands, short = shingles.band_hashes(values, ROWS), shingles.short_signature(values)
                row = iter(range(len(values)))
                at = [next(row) if s else None for s in sizes]
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"].iloc[some].astype("Int64"),
                        "node": b["node"].iloc[some],
                        "n_shingles": sizes,
                        "bands": [bands[i] if i is not None else [] for i in at],
                        "signature": [short[i].tobytes() if i is not None else b"" for i in at],
                    }
                )

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    return rows.mapInPandas(sign, SIGNED)


def known_nodes(members: DataFrame, signs: DataFrame) -> DataFrame:
    """node, rep, n, signature of each member, once for all copies of its text; rep is their smallest doc_id."""
    nodes = staged(members.select("node").distinct(), "nodes")
    used = signs.select("node", "doc_id", "n_shingles", "signature").join(broadcast_if_small(nodes), "node", "left_semi")
    return staged(used.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("signature").alias("signature")), "known")


def bayes_pruned(pairs: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v, nu, nv of the pairs that no batch of signature values gave up and whose set sizes allow the similarity."""

    @F.pandas_udf("boolean")
    def keeps(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(plausible(_unpacked(a), _unpacked(b), percent) if len(a) else [], dtype=bool)

    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    sized = pairs.join(side("u"), "u").join(side("v"), "v").filter(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    return sized.filter(keeps("su", "sv")).select("u", "v", "nu", "nv")


def _texts_of(nodes: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text: a row for each of ``nodes``, a staged table; more only where rows repeat both id and text."""
    reps = staged(known.join(broadcast_if_small(nodes), "node", "left_semi").select(F.col("node").alias("key"), "rep"), "reps")
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    return texts.join(broadcast_if_small(reps), (F.col("node") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")


def _sets(nodes: DataFrame, known: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """node, shingles: the sorted 64-bit hashes of the whole set of each node."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(t or "").encode() for t in b["text"]]
            for some in shingles.chunks(texts):
                h, ends = shingles.shingle_sets([texts[i] for i in some], n)
                yield pd.DataFrame({"node": b["node"].iloc[some], "shingles": np.split(h.view(np.int64), ends[:-1])})

    return staged(_texts_of(nodes, known, docs).mapInPandas(made, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")


def exact_links(pairs: DataFrame, known: DataFrame, docs: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """The pairs, smaller node first, whose whole shingle sets have the similarity.

    The partners of a ``u`` are dealt into parts by their sets' sizes, a part at least four times as large as the set of ``u``,
    which is sent to each part and sorted ahead of the partners' sets. So no row holds two sets, a much-named ``u`` is
    no single key, and a task holds one set and a batch of others.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty(0, np.int64)
        for b in batches:
            out = []
            for u, v, s in zip(b["u"], b["v"], b["shingles"], strict=True):
                if u == v:
                    held = s.copy()
                elif shingles.jaccard_at_least(held, s, percent):
                    out.append((min(u, v), max(u, v)))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    made = _sets(staged(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "nodes"), known, docs, n)
    room = F.greatest(F.lit(BLOCK_SHINGLES), 4 * F.max("nu"))
    parts = staged(pairs.groupBy("u").agg(F.ceil(F.sum("nv") / room).alias("parts")), "parts")
    dealt = pairs.join(broadcast_if_small(parts), "u").select("u", F.pmod(F.xxhash64(F.lit(5), "v"), "parts").alias("part"), "v")
    every = parts.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("u").alias("v"))
    sets = dealt.union(every).join(made.toDF("v", "shingles"), "v")
    ordered = sets.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v") != F.col("u"))
    return ordered.select("u", "v", "shingles").mapInPandas(compare, "u long, v long").distinct()


def _star_pairs(members: DataFrame) -> DataFrame:
    """One pair (centre, node) a node: with the centre of one of its buckets, the member that shares most buckets with others, so the text that a group of copies was made from.

    What buckets are joined with is staged, here and below: a small table is broadcast, and with a large one Spark can split a hot bucket.
    """
    sizes = staged(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "sizes")
    shared = members.join(broadcast_if_small(sizes), "band").groupBy("node").agg(F.sum("n").alias("shared"))
    best = members.join(shared, "node").groupBy("band").agg(F.max(F.struct("shared", "node")).alias("c"))
    centres = staged(best.select("band", F.col("c.node").alias("centre")), "centres")
    one = members.join(broadcast_if_small(centres), "band").filter("node <> centre").groupBy("node").agg(F.min("centre").alias("centre"))
    return one.select(F.col("centre").alias("u"), F.col("node").alias("v"))


def _own_shingles(members: DataFrame, known: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """node, n, own: how many shingles a member has, and how many of them no other member has."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(t or "").encode() for t in b["text"]]
            for some in shingles.chunks(texts):
                h, ends = shingles.shingle_sets([texts[i] for i in some], n)
                owner = np.repeat(b["node"].to_numpy()[some], np.diff(np.concatenate(([0], ends))))
                for at in range(0, len(h), shingles.FOLD):
                    yield pd.DataFrame({"node": owner[at : at + shingles.FOLD], "shingle": h[at : at + shingles.FOLD].view(np.int64)})

    nodes = staged(members.select("node").distinct(), "nodes")
    # least and largest holder: equal for a shingle of one member
    holders = _texts_of(nodes, known, docs).mapInPandas(split, "node long, shingle long").groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last")
    owned = holders.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sized = known.select("node", "n").join(broadcast_if_small(nodes), "node", "left_semi")
    return sized.join(owned, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"))


def _open_members(members: DataFrame) -> DataFrame:
    """``members`` of the buckets that lie in two components or more, with the bucket's size."""
    shape = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    return members.drop("size").join(broadcast_if_small(staged(shape.select("band", "size"), "shape")), "band")


def _may_share(nu, ou, nv, ov, percent: int):  # noqa: ANN001, ANN202
    """Whether sets of nu and nv shingles, ou and ov of which nobody else has, can be as similar as that."""
    most = F.least(nu - ou, nv - ov)
    return 100 * most >= percent * (nu + nv - most)


def _small_pairs(members: DataFrame, percent: int) -> DataFrame:
    few = members.filter(F.col("size") <= SMALL_BUCKET)
    side = lambda k: few.select("band", F.col("node").alias(k), F.col("root").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("own").alias(f"o{k}"))
    possible = _may_share(F.col("nu"), F.col("ou"), F.col("nv"), F.col("ov"), percent)
    return side("u").join(side("v"), "band").filter("u < v and ru <> rv").filter(possible).select("u", "v").distinct()


def _large_links(members: DataFrame, known: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between different components in large buckets: members outside the largest component against all.

    Buckets with one most popular member hold much the same group and are taken together. A group
    is compared a block against a block, blocks being cut by their sets' sizes: a task holds two
    of them, whatever the group's size. Pairs that neither their own shingles nor the posterior
    rule out are counted exactly there, and a pair that a link found before has already joined is skipped.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        s, node, root = _unpacked(rows["signature"]), rows["node"].to_numpy(), rows["root"].to_numpy()
        size, free = rows["n"].to_numpy(), rows["n"].to_numpy() - rows["own"].to_numpy()
        sets = list(rows["shingles"])
        above: dict[int, int] = {}

        def top(r: int) -> int:
            while r in above:
                r = above[r]
            return r

        probe = rows["probe"].to_numpy()
        targets = np.flatnonzero(~probe)
        out = []
        for a in np.flatnonzero(probe):
            most = np.minimum(free[a], free[targets])
            take = (root[targets] != root[a]) & (100 * most >= percent * (size[a] + size[targets] - most))
            b = targets[take]
            for x in b[plausible(np.broadcast_to(s[a], (len(b), s.shape[1])), s[b], percent)]:
                if (ra := top(root[a])) != (rx := top(root[x])) and shingles.jaccard_at_least(sets[a], sets[x], percent):
                    above[ra] = rx
                    out.append((min(node[a], node[x]), max(node[a], node[x])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    many = members.filter(F.col("size") > SMALL_BUCKET)
    popular = many.join(many.groupBy("node").agg(F.sum("size").alias("shared")), "node")
    centres = popular.groupBy("band").agg(F.max(F.struct("shared", "node")).alias("c")).select("band", F.col("c.node").alias("centre"))
    groups = staged(many.join(centres, "band").select("centre", "node", "root", "n", "own").distinct(), "groups")
    if groups.isEmpty():
        return members.sparkSession.createDataFrame([], "u long, v long")
    nodes = staged(groups.select("node").distinct(), "nodes")
    named = known.select("node", "signature").join(_sets(nodes, known, docs, n), "node")
    # a null for the sum of a group of one component, which has nothing to compare
    rooted = groups.groupBy("centre", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("weight"))
    largest = rooted.groupBy("centre").agg(F.max_by(F.struct("root", "weight"), F.struct("k", "root")).alias("most"), F.sum("weight").alias("all"), F.count(F.lit(1)).alias("roots"))
    sized = groups.join(largest.filter("roots > 1"), "centre").withColumn("others", F.col("all") - F.col("most.weight"))
    wide, high = F.ceil(F.col("all") / BLOCK_SHINGLES), F.ceil(F.col("others") / BLOCK_SHINGLES)
    deal = lambda blocks: F.pmod(F.xxhash64(F.lit(3), "node"), blocks)
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    columns = ["centre", "i", "j", "node", "root", "n", "own", "probe"]
    probes = sized.filter("root <> most.root").withColumn("i", deal(high)).withColumn("j", every(wide)).withColumn("probe", F.lit(True))
    targets = sized.withColumn("j", deal(wide)).withColumn("i", every(high)).withColumn("probe", F.lit(False))
    dealt = probes.select(columns).union(targets.select(columns)).join(named, "node")
    return dealt.groupBy("centre", "i", "j").applyInPandas(compare, "u long, v long").distinct()


def linked_nodes(docs: DataFrame, signs: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """node, root for each node that is linked with another one.

    Each node is compared with the centre of one of its buckets. Members of a bucket that are then
    still in different components are compared with one another, unless so many of a member's
    shingles are its own that it can't be similar to any, or not to that one; pairs inside a
    component need no test. So no bucket is capped and no bucket's pairs are listed.
    """
    banded = signs.select(F.explode("bands").alias("band"), "node")
    shared = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("band")
    members = staged(banded.join(broadcast_if_small(staged(shared, "shared")), "band").distinct(), "members")
    if members.isEmpty():
        return signs.sparkSession.createDataFrame([], "node long, root long")
    known = known_nodes(members, signs)
    stars = staged(bayes_pruned(staged(_star_pairs(members), "pairs"), known, percent), "likely")
    links = staged(exact_links(stars, known, docs, n, percent), "links")
    roots = staged(components(links), "roots")
    rooted = members.join(broadcast_if_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = staged(_open_members(rooted), "open")
    if rest.isEmpty():
        return roots
    counted = rest.join(_own_shingles(rest, known, docs, n), "node").filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    rest = staged(_open_members(staged(counted, "possible")), "open")
    if rest.isEmpty():
        return roots
    near = staged(bayes_pruned(staged(_small_pairs(rest, percent), "pairs"), known, percent), "near")
    found = staged(exact_links(near, known, docs, n, percent).union(_large_links(rest, known, docs, n, percent)), "found")
    return roots if found.isEmpty() else components(staged(links.union(found), "links"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Two documents are linked if their sets of n-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more, counted on whole sets; component_id is the smallest doc_id that links reach.
    Banding misses a pair at the threshold with a probability of (1 - 0.8^4)^32, below 1e-7, the
    posterior one of MISS a batch. Null and blank texts have no shingles and are linked with nothing. A null
    doc_id reaches a component like others but doesn't name it, nor is it kept where another has an id; rows that
    repeat a doc_id share its fate. Empty tables give no rows; extra columns are ignored.
    """
    return _grouped(docs, n, percent).drop("node")


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession):
        signs = staged(signed(docs, n), "signed")
        roots = staged(linked_nodes(docs, signs, n, percent), "roots")
        base = staged(signs.select("doc_id", "node", "n_shingles").join(broadcast_if_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted", keep=True)
    rows = base.filter("n_shingles > 0")
    shared = staged(rows.groupBy("root").agg(F.min("doc_id").alias("component"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"), "shared")
    named = base.join(broadcast_if_small(shared), "root", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "node", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows of which :func:`near_duplicates` keeps another one; columns as they were."""
    docs, named_back = set_aside(docs)
    out = _grouped(docs, n, percent).filter("not kept").select(F.col("doc_id").alias("__doc"), F.col("node").alias("__node")).distinct()
    dropped = broadcast_if_small(staged(out, "dropped"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__node"))
    return named_back(docs.join(dropped, same, "left_anti").select(*docs.columns))
