"""Main text of web pages: a bidirectional LSTM in numpy labels every leaf block of a page.

A block's input is the sum of vectors of its tag path, the mean of vectors of its hashed words,
and a few lengths; both directions run over the whole page, so each label sees all of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from floorlake.llm.html_blocks import PATH_DIM, Leaf, leaves
from floorlake.llm.html_pages import labelled_page
from floorlake.staging import small_batches

WORD_DIM = 64
EXTRA = 4
INPUT = PATH_DIM + WORD_DIM + EXTRA
HIDDEN = 12
#: The labeller is trained on so many made-up pages, so many times.
TRAIN_PAGES = 1200
EPOCHS = 8
PAGES_A_STEP = 24
RATE = 0.01
SEED = 3
#: Blocks, padding included, that are labelled at once; a longer page is labelled alone.
STEP_BLOCKS = 8192


class Weights(NamedTuple):
    """For both directions, in axis 0: input, recurrent and bias weights of the gates; then the output layer."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    wo: np.ndarray
    bo: np.ndarray


def encoded(blocks: list[Leaf]) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Path ids, and the dense part of the input: mean of hashed words, then lengths."""
    dense = np.zeros((len(blocks), WORD_DIM + EXTRA))
    for i, leaf in enumerate(blocks):
        words = leaf.text.lower().split()
        ids = [crc32(w.encode()) % WORD_DIM for w in words]
        dense[i, :WORD_DIM] = np.bincount(ids, minlength=WORD_DIM) / len(ids)
        dense[i, WORD_DIM:] = math.log1p(len(words)) / 4, min(1.0, leaf.linked / len(leaf.text)), sum(map(leaf.text.count, ".!?")) > 0, leaf.text[-1:] in ".!?"
    return [leaf.ids for leaf in blocks], dense


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(w: Weights, paths: list[tuple[int, ...]], dense: np.ndarray) -> np.ndarray:
    """Gate inputs of each block for both directions: [2, blocks, 4 HIDDEN]. Equal paths are summed once."""
    seen: dict[tuple[int, ...], int] = {}
    at = np.array([seen.setdefault(p, len(seen)) for p in paths])
    sums = np.stack([w.wx[:, list(p)].sum(1) for p in seen], axis=1)
    return sums[:, at] + dense @ w.wx[:, PATH_DIM:] + w.b[:, None]


def _layout(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places [2, steps, pages] of the pages' blocks in reading and in reverse order, and which places hold one."""
    steps = max(lengths)
    t = np.arange(steps)[:, None]
    n = np.array(lengths)[None]
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1][None]
    here = t < n
    return np.stack([np.where(here, first + t, 0), np.where(here, first + n - 1 - t, 0)]), here


def forward(w: Weights, gates: np.ndarray, lengths: list[int], keep: bool = False):  # noqa: ANN201
    """Hidden states of each block, both directions side by side; with ``keep`` also what training needs."""
    place, here = _layout(lengths)
    steps, pages = here.shape
    h, c = np.zeros((2, pages, HIDDEN)), np.zeros((2, pages, HIDDEN))
    hidden = np.zeros((2, gates.shape[1], HIDDEN))
    tape = []
    for t in range(steps):
        z = np.stack([gates[d, place[d, t]] for d in (0, 1)]) + h @ w.wh
        i, f, o = (_sigmoid(z[..., k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[..., 3 * HIDDEN :])
        new = f * c + i * g
        th = np.tanh(new)
        if keep:
            tape.append((h, c, i, f, o, g, th))
        on = here[t]
        c = np.where(on[None, :, None], new, c)
        h = np.where(on[None, :, None], o * th, h)
        for d in (0, 1):
            hidden[d, place[d, t, on]] = h[d, on]
    out = np.concatenate(hidden, axis=1)
    return (out, tape, place, here) if keep else out


def _gradients(w: Weights, tape: list, place: np.ndarray, here: np.ndarray, d_hidden: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs [2, blocks, 4 HIDDEN] and of the recurrent weights, back through all steps."""
    parts = np.split(d_hidden, 2, axis=1)
    dh, dc = np.zeros_like(tape[0][0]), np.zeros_like(tape[0][1])
    d_gates, d_wh = np.zeros((2, n, 4 * HIDDEN)), np.zeros_like(w.wh)
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, g, th = tape[t]
        on = here[t][None, :, None]
        own = dh + np.stack([parts[d][place[d, t]] for d in (0, 1)])
        carry = dc + own * o * (1 - th**2)
        z = np.concatenate([carry * g * i * (1 - i), carry * c * f * (1 - f), own * th * o * (1 - o), carry * i * (1 - g**2)], axis=-1) * on
        d_wh += h.transpose(0, 2, 1) @ z
        for d in (0, 1):
            d_gates[d, place[d, t, here[t]]] = z[d, here[t]]
        dh = np.where(on, z @ w.wh.transpose(0, 2, 1), dh)
        dc = np.where(on, carry * f, dc)
    return d_gates, d_wh


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Weights fit by Adam to made-up labelled pages; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    made = [labelled_page(i) for i in range(pages)]
    data = [(*encoded(leaves(h)), np.array(y)) for h, y in made]
    data = [x for x in data if len(x[2])]
    w = Weights(rng.normal(0, 0.1, (2, INPUT, 4 * HIDDEN)), rng.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)), np.zeros((2, 4 * HIDDEN)), rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1))
    w.b[:, HIDDEN : 2 * HIDDEN] = 1
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), PAGES_A_STEP):
            some = [data[i] for i in order[at : at + PAGES_A_STEP]]
            lengths = [len(y) for *_, y in some]
            n = sum(lengths)
            # dropped path names make the words and neighbours count too
            paths = [tuple(i for i in p if rng.random() > 0.1) for ps, _, _ in some for p in ps]
            dense, y = np.concatenate([d for _, d, _ in some]), np.concatenate([y for *_, y in some])
            hidden, tape, place, here = forward(w, _inputs(w, paths, dense), lengths, keep=True)
            error = (_sigmoid(hidden @ w.wo + w.bo) - y) / n
            d_gates, d_wh = _gradients(w, tape, place, here, error[:, None] * w.wo, n)
            d_wx = np.zeros_like(w.wx)
            d_wx[:, PATH_DIM:] = dense.T @ d_gates
            ids = np.concatenate([np.array(p, int) for p in paths])
            owner = np.repeat(np.arange(n), [len(p) for p in paths])
            for d in (0, 1):
                np.add.at(d_wx[d], ids, d_gates[d][owner])
            grads = [d_wx, d_wh, d_gates.sum(1), hidden.T @ error, np.array([error.sum()])]
            step += 1
            rate = RATE * (1 - epoch / (epochs + 1))
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g**2 - v[k])
                w[k][...] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Weights(*(x.astype(np.float32) for x in w))


@cache
def default_weights() -> Weights:
    return train()


def probabilities(w: Weights, pages: list[list[Leaf]]) -> list[np.ndarray]:
    """For each page, the probability of each block to be part of the article."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= STEP_BLOCKS:
            end += 1
        some = order[at:end]
        codes = [encoded(pages[i]) for i in some]
        lengths = [len(pages[i]) for i in some]
        gates = _inputs(w, [p for ps, _ in codes for p in ps], np.concatenate([d for _, d in codes]).astype(np.float32))
        chances = _sigmoid(forward(w, gates, lengths) @ w.wo + w.bo)
        for i, part in zip(some, np.split(chances, np.cumsum(lengths)[:-1]), strict=True):
            out[i] = part
        at = end
    return out


def main_texts(w: Weights, pages: list[str | None]) -> list[str]:
    parsed = [leaves(p) if p else [] for p in pages]
    return ["\n".join(leaf.text for leaf, c in zip(blocks, chance, strict=True) if c >= 0.5) for blocks, chance in zip(parsed, probabilities(w, parsed), strict=True)]


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    ``text`` has the article's blocks in page order, one a line, character references decoded and
    white space inside a block as one space. A null, empty or blank page has an empty text, and so
    has one without an article block. Repeated rows come out alike, each with a row; an empty
    table gives no rows; extra columns are ignored.
    """
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(weights or default_weights())  # about 60,000 numbers

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256]
                texts = main_texts(sent.value, list(some["html"]))
                yield pd.DataFrame({"page_id": some["page_id"].astype("Int64"), "url": some["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(extract, "page_id long, url string, text string, n_chars long")
