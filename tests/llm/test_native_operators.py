"""Sharding, chat, quality, decontamination and mixing on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from floorlake.llm import chat, decontaminate, minhash, mixing, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, mix_slot string, kept string"


def docs_of(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "word", "Same text here.", "Same text here.", "long " * 20_000, "é ß 漢字 " * 40]


def odd_docs(spark):
    more = spark.createDataFrame([(None, "no id", None, None, None, "x", "y", "z"), (3, "word", "en", "s", 4, "x", "y", "z"), (3, "word", "en", "s", 4, "x", "y", "z")], DOCS)
    return docs_of(spark, ODD).union(more)


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


# sharding


@pytest.mark.parametrize("n", [0, 1, 2, 3, 15, 16, 17, 100, 1000, 1023])
def test_permutation_is_one(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))


def test_place_is_computable(spark):
    n = 500
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).collect()
    assert all(sharding.place_of(r["id"], n) == (r["p"] % 16, r["p"] // 16) for r in rows)


def test_shards_are_even_and_gapless(spark):
    d = odd_docs(spark)
    rows = sharding.shard_documents(d, 4).collect()
    assert len(rows) == d.count() and set(sharding.shard_documents(d, 4).columns) == {*d.columns, "slot"}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_sharding_does_not_depend_on_partitions(spark):
    d = docs_of(spark, [f"text {i}" for i in range(300)])
    a, b = ({r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(x).collect()} for x in (d, d.repartition(7)))
    assert a == b
    assert sharding.shard_documents(d.limit(0)).count() == 0


def test_many_buckets_number_like_one(spark, monkeypatch):
    d = docs_of(spark, [f"text {i}" for i in range(300)]).withColumn("k", sharding.row_key(F.col("doc_id"), F.col("text")))
    one = {r["doc_id"]: r["n"] for r in sharding.number_rows(d, "k", 300, "n").collect()}
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 10)
    many = {r["doc_id"]: r["n"] for r in sharding.number_rows(d, "k", 300, "n").collect()}
    keys = sorted((hashlib.md5(f"{i}|1text {i}".encode()).hexdigest(), i) for i in range(300))
    assert one == many == {i: n for n, (_, i) in enumerate(keys)}


def test_crc32(spark):
    assert spark.createDataFrame([("añb",)], "t string").select(F.crc32(F.col("t").cast("binary"))).first()[0] == zlib.crc32("añb".encode())


# chat


def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (4, 0, "user", "b"), (5, 0, "user", "b"), (6, 0, None, None), (6, 0, "user", None), (7, 5, "user", "a"), (None, 0, "user", "z")]
    rows = {r["conv_id"]: r for r in chat.render_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("chat", F.lit(1))).collect()}
    assert set(rows) == {2, 4, 6, None}
    assert rows[2]["chat"] == "<|user|>\na<|end|>\n<|bot|>\nb<|end|>\n<|user|>\nc<|end|>" and rows[2]["n_turns"] == 3
    assert rows[4]["n_same"] == 2
    assert rows[6]["chat"] == "<|user|>\n<|end|>\n<|unknown|>\n<|end|>"


def test_snapshots_against_brute_force(spark):
    r = random.Random(5)
    convs = {i: [(r.choice("ub"), r.choice("xyz")) for _ in range(r.randint(1, 4))] for i in range(120)}
    turns = [(i, j, a, b) for i, c in convs.items() for j, (a, b) in enumerate(c)]
    got = {x["conv_id"] for x in chat.render_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    want = {i for i, c in convs.items() if not any((len(d) > len(c) and d[: len(c)] == c) or (d == c and k < i) for k, d in convs.items())}
    assert got == want
    assert chat.render_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# quality


def brute_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, x in enumerate(grams) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts(spark):
    r = random.Random(2)
    texts = [*ODD, "a a a a a a", "x y z x y z\nq\nq\n\nq", "# * $|<b>", *["\n".join(" ".join(r.choices("abc", k=r.randint(0, 6))) for _ in range(r.randint(1, 6))) for _ in range(60)]]
    rows = quality.quality_report(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    for x in rows:
        want = brute_counts(texts[x["doc_id"]])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_divergence(spark):
    r = random.Random(1)
    clean = [sentence(r, 150).capitalize() + "." for _ in range(40)]
    junk = ["### *** $$$ %%% " * 60 + " ".join(sentence(r, 60).upper().split())]
    kept = {x["doc_id"]: x["kept"] for x in quality.quality_report(docs_of(spark, clean + junk, lang="fr")).collect()}
    assert all(kept[i] for i in range(40)) and not kept[40]
    assert quality.keep_good(odd_docs(spark)).columns == odd_docs(spark).columns
    assert quality.quality_report(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_js_distance(spark):
    d = lambda p, q: spark.createDataFrame([(p, q)], "p array<long>, q array<long>").select(quality.js_distance(F.col("p"), F.col("q"))).first()[0]
    assert d([1, 0], [0, 5]) == 1.0 and d([2, 4], [1, 2]) == 0.0 and d([0, 0], [1, 1]) == 0.0
    m = [0.75, 0.25]
    want = math.sqrt(sum(p * math.log2(p / k) / 2 for p, k in zip([1.0], m, strict=False)) + sum(q * math.log2(q / k) / 2 for q, k in zip([0.5, 0.5], m, strict=True)))
    assert abs(d([7, 0], [3, 3]) - want) < 1e-12


# decontamination


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_decontamination_against_brute_force(spark):
    r = random.Random(3)
    items = [sentence(r, r.randint(8, 60)) for _ in range(30)]
    texts = list(ODD)
    for _ in range(80):
        w = items[r.randrange(30)].split()
        cut = w[: r.randint(len(w) // 2, len(w))]
        texts.append(sentence(r, r.randint(0, 200)) + " " + " ".join(cut).upper() + " " + sentence(r, 5))
    texts += [texts[-1]] * 3
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "the rare pair")], "item_id long, text string").withColumn("kept", F.lit(0))
    texts.append("so the rare pair shows up")
    rows = decontaminate.contamination_report(docs_of(spark, texts), bench).collect()
    assert len(rows) == len(texts)
    for x in rows:
        have = grams(texts[x["doc_id"]])
        want = [i for i, t in enumerate(items) if len(grams(t) & have) >= 0.8 * len(grams(t))]
        if x["doc_id"] == len(texts) - 1:
            want.append(92)
        assert x["item_ids"] == ",".join(map(str, want)) and x["contaminated"] == bool(want) == (not x["kept"])


def test_decontamination_by_shuffle_joins(spark, monkeypatch):
    r = random.Random(4)
    items = [sentence(r, 12) for _ in range(5)]
    texts = [sentence(r, 30) + " " + items[i % 5] if i % 2 else sentence(r, 30) for i in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "broadcast_if_small", lambda df, *_: df)
    kept = {x["doc_id"] for x in decontaminate.drop_contaminated(docs_of(spark, texts), bench).collect()}
    assert kept == {i for i in range(30) if not i % 2}


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    d = odd_docs(spark)
    assert decontaminate.drop_contaminated(d, bench).count() == d.count()
    assert decontaminate.drop_contaminated(d, bench).columns == d.columns
    assert decontaminate.contamination_report(d.limit(0), bench).count() == 0


# mixing


@pytest.mark.parametrize("seed", range(6))
def test_schedule_keeps_within_a_block(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(mixing, "FRAME_SLOTS", r.choice([7, 16, 50]))
    w = mixing.whole_weights([r.random() ** 3 + 1e-3 for _ in range(r.randint(1, 25))])
    n = r.randint(1, 400)
    slots = [x for f in range(-(-n // mixing.FRAME_SLOTS)) for x in mixing.schedule_frame(w, n, f)]
    assert [x[0] for x in slots] == list(range(n))
    had = [0] * len(w)
    for t, s, k, release, deadline in slots:
        assert k == had[s] and release <= t < deadline
        had[s] += 1
        assert all(abs(h * mixing.SCALE - x * (t + 1)) < mixing.SCALE for h, x in zip(had, w, strict=True))


def test_mix_has_every_row(spark):
    rows = [(i, f"t{i}", "en", s, 1, "x", "y", "z") for i, s in enumerate(["a"] * 100 + ["b"] * 30 + ["c"] * 3 + [None] * 5)]
    rows += [(None, None, None, "b", None, "x", "y", "z")] * 2
    d = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(d, {"a": 0.4, "b": 0.3, "c": 0.1, None: 0.2}, block_rows=4).collect()
    first = Counter((x["doc_id"], x["source"]) for x in out if x["mix_epoch"] == 0)
    assert first == Counter((x["doc_id"], x["source"]) for x in d.collect())
    slots = {}
    for x in out:
        slots.setdefault(x["mix_slot"], set()).add((x["source"], x["mix_block"], x["mix_epoch"]))
        assert x["mix_release"] <= x["mix_slot"] < x["mix_deadline"]
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    share = Counter(next(iter(v))[0] for v in slots.values())
    assert all(abs(share[s] - w * len(slots)) < 1 for s, w in (("a", 0.4), ("b", 0.3), ("c", 0.1), (None, 0.2)))


def test_mix_defaults_and_errors(spark):
    d = odd_docs(spark)
    out = mixing.mix_sources(d, block_rows=2)
    assert {x["doc_id"] for x in out.collect()} == {x["doc_id"] for x in d.collect()}
    assert mixing.mix_sources(d.limit(0)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        mixing.mix_sources(d, {"s": 0.0, None: 1.0})
    most = mixing.default_weights({"a": 10**6, "b": 1})
    assert most["b"] == mixing.MAX_EPOCHS


def test_a_small_source_with_a_large_weight(spark):
    d = spark.createDataFrame([(i, f"t{i}", "a" if i == 0 else "b") for i in range(10_001)], "doc_id long, text string, source string")
    out = mixing.mix_sources(d, {"a": 1.0, "b": 1.0}, block_rows=1)
    rows = out.filter("source = 'a'").orderBy("mix_epoch").collect()
    assert abs(len(rows) - 10_000) <= 1 and [x["mix_epoch"] for x in rows] == list(range(len(rows)))
    assert all(x["mix_release"] <= x["mix_slot"] < x["mix_deadline"] for x in rows)
    assert out.filter("source = 'b' and mix_epoch = 0").select("doc_id").distinct().count() == 10_000


def test_columns_named_like_the_operators_own(spark):
    names = ["__source", "__bucket", "__w", "__lang", "__key", "__items", "__doc", "__node", "__n_words", "__part", "__turns", "kept"]
    r = random.Random(8)
    rows = [(i, sentence(r, 80), "en", f"s{i % 2}", *([str(i)] * len(names))) for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
    items = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    for out in (quality.keep_good(d), decontaminate.drop_contaminated(d, items), minhash.drop_near_duplicates(d), mixing.mix_sources(d), sharding.shard_documents(d)):
        assert out.columns[: len(d.columns)] == d.columns
        assert all(x[c] == str(x["doc_id"]) for x in out.collect() for c in names)


def test_shards_of_rows_that_share_id_and_text(spark):
    d = spark.createDataFrame([(1, "same", str(i)) for i in range(40)], "doc_id long, text string, extra string")
    one, two = ({(x["extra"], x["shard"], x["slot"]) for x in sharding.shard_documents(d.repartition(n)).collect()} for n in (1, 7))
    assert one == two
