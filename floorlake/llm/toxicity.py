"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text's features are its character n-grams inside words, word boundaries included, hashed into
buckets; each bucket has an embedding, a text is the mean of its distinct features' embeddings, and a
linear softmax over it gives the two classes. A misspelling shares most n-grams with its word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.llm.shingles import mixed
from floorlake.staging import scratch, small_batches, staged

U = np.uint64
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
#: Rows are gone through so often in all, but MAX_EPOCHS times each at most.
VISITS = 45_000
MAX_EPOCHS = 40
#: Buckets that fewer of the fitting rows have say nothing.
LEAST_ROWS = 5
BATCH = 64
RATE = 0.05
SEED = 11
#: The model is fit on so many labelled rows of class 0 and 1 at most, those with the smallest hash of doc_id.
FIT_ROWS = (3000, 1500)
#: ... and of those only as many, in that order, as have so many bytes of bags in all: what the driver holds.
FIT_BYTES = 128 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def features(text: bytes) -> np.ndarray:
    """Buckets of all n-grams of a text, repeats included."""
    raw = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    space = raw == 32
    wide = raw.astype(U) + U(1)
    before = np.concatenate(([0], np.cumsum(space)))
    h = np.zeros(len(raw), U)
    out = []
    for n in range(1, max(SIZES) + 1):
        if len(raw) < n:
            break
        h = h[: len(raw) - n + 1] * U(0x100000001B3) + wide[n - 1 :]
        if n in SIZES:
            # white space may stand at either end only
            inner = before[n - 1 : len(raw)] - before[1 : len(raw) - n + 2]
            out.append((mixed(h[inner == 0] + U(n << 56)) % U(BUCKETS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def bag(text: bytes) -> np.ndarray:
    """Distinct buckets: a word that fills a text counts as one that occurs once."""
    there = np.zeros(BUCKETS, bool)
    there[features(text)] = True
    return np.flatnonzero(there).astype(np.int32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings of the buckets, weights and bias of the softmax over a text's mean embedding.

    They are trained together by Adagrad on cross entropy, its classes weighted by the root of
    their rarity. Buckets of fewer than LEAST_ROWS rows keep a zero embedding.
    """
    seen = np.zeros(BUCKETS, int)
    for ids in bags:
        seen[ids] += 1
    known = seen >= LEAST_ROWS
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)) * known[:, None]
    weights, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    g_table, g_weights, g_bias = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    share = np.bincount(labels, minlength=2)
    balance = np.sqrt(len(labels) / (2 * np.maximum(1, share)))
    for _ in range(epochs or min(MAX_EPOCHS, -(-VISITS // len(bags)))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            ids = np.concatenate([bags[i] for i in some])
            sizes = np.array([len(bags[i]) for i in some])
            rows = np.repeat(np.arange(len(some)), sizes)
            keep = known[ids]
            ids, rows = ids[keep], rows[keep]
            amount = 1 / sizes[rows]
            summed = lambda at, x, n: np.stack([np.bincount(at, x[:, d], n) for d in range(DIM)], axis=1)
            mean = summed(rows, table[ids] * amount[:, None], len(some))
            y = labels[some]
            delta = softmax(mean @ weights + bias)
            delta[np.arange(len(some)), y] -= 1
            delta *= balance[y][:, None] / len(some)
            back = delta @ weights.T
            used, place = np.unique(ids, return_inverse=True)
            grad = summed(place, back[rows] * amount[:, None], len(used))
            g_table[used] += (grad**2).sum(1) / DIM
            table[used] -= RATE * 10 * grad / np.sqrt(g_table[used])[:, None]
            grad_w, grad_b = mean.T @ delta, delta.sum(0)
            g_weights += grad_w**2
            g_bias += grad_b**2
            weights -= RATE * grad_w / np.sqrt(g_weights)
            bias -= RATE * grad_b / np.sqrt(g_bias)
    return table, weights, bias


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(value of each bucket, offset): a text's log odds are the offset plus the mean of its buckets' values.

    With two classes the mean and the last layer of the trained model are both linear, so they fold into that.
    """
    table, weights, bias = train(bags, labels, epochs, seed)
    return table @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])


def score(texts: list[bytes], values: np.ndarray, offset: float) -> np.ndarray:
    """Probability of the toxic class for each text; an empty text gets that of the offset."""
    out = np.zeros(len(texts))
    there = np.zeros(BUCKETS, bool)
    for i, t in enumerate(texts):
        f = features(t)
        if len(f):
            there[f] = True
            out[i] = values[there].mean()
            there[f] = False
    return 1 / (1 + np.exp(-(out + offset)))


def held_out(doc_id) -> object:  # noqa: ANN001
    """Whether a document is one whose labels aren't learned from; a null id is."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> tuple[np.ndarray, float]:
    """Fits on the labelled rows that aren't held out, at most ``fit_rows`` of each class and ``fit_bytes`` of bags.

    The driver receives those rows' bags. Rows with a null text or label teach nothing. A class
    without rows leaves all scores at what the other one's share says.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(fit_rows[c]) for c in (0, 1)]
    picked = chosen[0].union(chosen[1])

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [bag(t.encode()).tobytes() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "n": [len(x) for x in made], "ids": made})

    # at most sum(fit_rows) rows: the broadcast is bounded, and so is the running sum, but for rows that repeat an id
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")
    with scratch(docs.sparkSession):
        made = staged(texts.mapInPandas(bags, "doc_id long, toxic int, n long, ids binary"), "bags")
        sizes = made.groupBy("doc_id").agg(F.sum("n").alias("n"))
        running = F.sum("n").over(Window.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        taken = sizes.withColumn("upto", running).filter(F.col("upto") <= fit_bytes).select("doc_id")
        rows = made.join(F.broadcast(taken), "doc_id").collect()
    rows = sorted((r for r in rows if r["ids"]), key=lambda r: (r["doc_id"], bytes(r["ids"])))
    if not rows:
        return np.zeros(BUCKETS), 0.0
    return fit([np.frombuffer(r["ids"], np.int32) for r in rows], np.array([r["toxic"] for r in rows]))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, from its whole text alone.

    Null and empty texts get the score of the model's offset; repeated rows score alike; a null
    doc_id counts as held out; an empty table gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, offset = sent.value
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": score([(t or "").encode() for t in b["text"]], values, offset)})

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(scored, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
