"""The pipeline's stages against plain Python on a small fixture."""

import random
from collections import Counter

import corpus_pipeline

from test_free_operators import brute_components
from test_native_operators import brute_counts, grams, sentence

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, path):
    r = random.Random(21)
    clean = [sentence(r, r.randint(60, 200)).capitalize() + "." for _ in range(60)]
    items = [sentence(r, 20) for _ in range(6)]
    texts = [*clean, *[" ".join(w if r.random() > 0.01 else "edited" for w in t.split()) for t in clean[:20]], *[t + " " + items[i % 6] for i, t in enumerate(clean[30:40])]]
    texts += ["too short", None, "same words over and over " * 30]
    texts += [f"{sentence(r, 80)} {items[i]} {sentence(r, 20)}" for i in range(6)]
    rows = [(i, t, "en", f"s{i % 7}" if i % 3 else "s0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = lambda i, d: STAGES[i][1](spark, d, str(tmp_path))
    STAGES = corpus_pipeline.STAGES

    good = stage(0, docs)
    text = {i: t for i, t, *_ in rows}
    passed = {i for i, t in text.items() if (n := brute_counts(t))[0] >= 50 and 100 * n[4] <= 50 * n[0]}
    assert {x["doc_id"] for x in good.collect()} == passed and good.columns == docs.columns

    order = sorted(passed)
    _, root = brute_components([text[i] for i in order], 5)
    alone = {i for k, i in enumerate(order) if root[k] == k}
    single = stage(1, good)
    assert {x["doc_id"] for x in single.collect()} == alone and single.columns == docs.columns

    held = {i for i in alone for t in items if len(grams(t) & grams(text[i])) >= 0.8 * len(grams(t))}
    pure = stage(2, single)
    assert held and {x["doc_id"] for x in pure.collect()} == alone - held and pure.columns == docs.columns

    mixed = stage(3, pure)
    assert mixed.columns == docs.columns
    times = Counter(x["doc_id"] for x in mixed.collect())
    assert set(times) == alone - held

    final = stage(4, mixed).collect()
    assert len(final) == sum(times.values())
    by = {}
    for x in final:
        by.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["shard"], x["slot"]) for x in whole) == sorted((x["doc_id"], x["shard"], x["slot"]) for x in final)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
