"""Cross-tokenizer alignment: groups of tokens that end at common byte offsets, and the links between overlapping tokens."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.staging import broadcast_if_small, small_batches, staged

#: Vocabulary files, which every executor has.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the pattern that splits text before the merges of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text whose tokens are aligned at a time, or one text where that is larger.
SLICE_BYTES = 1 << 20
SALTS = 16
#: A task forgets the pieces it knows beyond so many, or so many links of them.
MOST_PIECES = 1 << 17
MOST_LINKS = 1 << 21
#: Pieces that go through a tokenizer at a time.
RUN_PIECES = 256
#: A pair of ids is one integer: the first id times this, plus the second.
SPREAD = 1 << 32

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, n: int>>"


class Tokenizer(NamedTuple):
    """``encode`` of a text to ids, each id's bytes, and their lengths. ``whole``: some token has a space after something else, so texts can't be cut there. The pattern of the byte-level one never matches across such a place."""

    encode: Callable[[str], list[int]]
    pieces: list[bytes]
    lengths: np.ndarray
    whole: bool


def _tokenizer(encode: Callable[[str], list[int]], pieces: list[bytes]) -> Tokenizer:
    return Tokenizer(encode, pieces, np.array([len(p) for p in pieces], np.int64), False)


@lru_cache(maxsize=2)
def byte_level(path: str = BYTE_BPE) -> Tokenizer:
    """The byte-level vocabulary of a ``tokenizers`` file. It knows no special tokens, so their strings are plain text.

    Its ids are in the order of its merges, so they serve as ranks.
    """
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printed)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    vocab = {bytes(shown[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = token
    return _tokenizer(tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary, pieces)


@lru_cache(maxsize=2)
def piece_level(path: str = PIECE_BPE) -> Tokenizer:
    """The vocabulary of a ``sentencepiece`` model, which puts a space in front of a text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    read = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    found = _tokenizer(lambda text: model.encode(text, num_threads=1), [read(i) for i in range(model.get_piece_size())])
    return found._replace(whole=any(b" " in p.lstrip(b" ") for p in found.pieces))


class Aligned(NamedTuple):
    """Tokens of pieces of text one after another: groups and links of ``a`` and ``b`` by places from 0."""

    a: np.ndarray
    b: np.ndarray
    group_of_a: np.ndarray
    group_of_b: np.ndarray
    piece_of_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray, piece_bytes: np.ndarray) -> Aligned:
    """Groups and links of the tokens ``a`` and ``b``, of so many bytes each, of pieces with ``piece_bytes`` bytes; a piece's end is a common one."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    first = np.searchsorted(b_end, a_end - a_len, "right")
    n = np.searchsorted(b_end, a_end, "left") - first + 1
    link_a = np.repeat(np.arange(len(a)), n)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n - first, n)
    return Aligned(a, b, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end), np.searchsorted(np.cumsum(piece_bytes), cuts), link_a, link_b)


@lru_cache(maxsize=4)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``n``, from the left, in rows with a place to spare, and how many there are."""
    words = [str(i).encode() for i in range(n)]
    width = len(words[-1]) + 1
    return np.frombuffer(b"".join(w.ljust(width) for w in words), np.uint8).reshape(n, width), np.array([len(w) for w in words])


def group_texts(x: Aligned, n_pieces: int) -> list[bytes]:
    """Each piece's groups as ``a1,a2|b1;a3|b2,b3``."""
    upto = lambda of, n: np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    n_groups, n = len(x.piece_of_group), len(x.a) + len(x.b)
    a_upto, b_upto = upto(x.group_of_a, n_groups), upto(x.group_of_b, n_groups)
    ids, ends = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[np.arange(len(x.a)) + b_upto[x.group_of_a]] = x.a
    ids[np.arange(len(x.b)) + a_upto[x.group_of_b + 1]] = x.b
    ends[a_upto[1:] + b_upto[:-1] - 1] = ord("|")
    ends[a_upto[1:] + b_upto[1:] - 1] = ord(";")
    digits, sizes = _digits(1 << int(ids.max(initial=1)).bit_length())
    size, chars = sizes[ids], digits[ids]
    chars[np.arange(n), size] = ends
    text = chars[np.arange(chars.shape[1]) <= size[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(size + 1)])[(a_upto + b_upto)[upto(x.piece_of_group, n_pieces)]].tolist()
    return [text[i : j - 1] for i, j in zip(at, at[1:])]


class Pieces:
    """Aligned pieces of text, each a place in the columns: ``good``, ``counts`` (n_a, n_b, n_groups, n_links), ``texts`` and ``pairs[starts[i]:starts[i + 1]]``, one pair of ids a link.

    Both vocabularies end a token wherever a space follows something else, so a text is the
    row of its pieces between such places, and a piece that comes again needn't be aligned again.
    """

    def __init__(self, first: Tokenizer, second: Tokenizer) -> None:
        self.first, self.second = first, second
        self.bits = len(second.pieces).bit_length()
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.good, self.counts = np.zeros(0, bool), np.zeros((0, 4), np.int64)
        self.texts: list[bytes] = []
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, pieces: list[str]) -> None:
        a, b, good = [], [], []
        last = {p for p in pieces if p[-1:].isspace()}  # a space after these would go on with theirs
        inner = [p for p in pieces if p not in last]
        for run in [inner[k : k + RUN_PIECES] for k in range(0, len(inner), RUN_PIECES)] + [[p] for p in last]:
            if self._tokens(run, a, b):
                good += [True] * len(run)
            else:
                good += [self._tokens([p], a, b) for p in run]
        flat_a, flat_b = _joined(a), _joined(b)
        names, right = [*inner, *last], np.array(good, bool)
        sizes = np.array([len(p.encode()) + 1 for p in names], np.int64)
        there = np.nonzero(right)[0]
        x = align(flat_a, flat_b, self.first.lengths[flat_a], self.second.lengths[flat_b], sizes[there])
        counts = np.zeros((len(names), 4), np.int64)
        for k, of in enumerate((x.group_of_a, x.group_of_b, slice(None), x.group_of_a[x.link_a])):
            counts[there, k] = np.bincount(x.piece_of_group[of], minlength=len(there))
        texts = dict(zip(there.tolist(), group_texts(x, len(there)), strict=True))
        self.place.update(zip(names, range(len(self.texts), len(self.texts) + len(names)), strict=True))
        self.texts += [texts.get(k, b"") for k in range(len(names))]
        self.good, self.counts = np.concatenate([self.good, right]), np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts[:, 3])])
        self.pairs = np.concatenate([self.pairs, flat_a[x.link_a] << self.bits | flat_b[x.link_b]])

    def _tokens(self, run: list[str], a: list, b: list) -> bool:
        """Appends the tokens of pieces, if their bytes are the pieces' own."""
        text = " ".join(run)
        x, y = self.first.encode(" " + text), self.second.encode(text)
        raw = (" " + text).encode()
        good = b"".join([self.first.pieces[i] for i in x]) == raw == b"".join([self.second.pieces[i] for i in y])
        if good:
            a.append(np.array(x, np.int64))
            b.append(np.array(y, np.int64))
        return good


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@lru_cache(maxsize=1)
def _known(byte_bpe: str, piece_bpe: str) -> Pieces:
    return Pieces(byte_level(byte_bpe), piece_level(piece_bpe))


_CUT = re.compile(r"(?<=\S) ")


def _cut(text: str) -> list[str]:
    """A text's pieces, without the space that each of them starts with; a last space stays with its piece."""
    pieces = _CUT.split(text)
    return pieces if pieces[-1] or len(pieces) < 2 else [*pieces[:-2], pieces[-2] + " "]


def _slice(ids: list, texts: list[str | None], known: Pieces) -> pa.RecordBatch:
    if len(known.texts) > MOST_PIECES or len(known.pairs) > MOST_LINKS:
        known.forget()
    whole = known.second.whole
    pieces = [([t] if whole else _cut(t)) if t else [] for t in texts]
    if new := set().union(*pieces) - known.place.keys():
        known.add(list(new))
    size = np.array([len(x) for x in pieces], np.int64)
    at = np.fromiter(map(known.place.__getitem__, chain.from_iterable(pieces)), np.int64, int(size.sum()))
    stop = np.cumsum(size)
    total = lambda v: np.diff(np.concatenate([np.zeros((1, *v.shape[1:]), np.int64), np.cumsum(v, 0)])[np.concatenate([[0], stop])], axis=0)
    there = (size > 0) & (total(~known.good[at]) == 0)
    counts = total(known.counts[at]) * there[:, None]
    listed = at.tolist()
    digests = [hashlib.sha256(b";".join([known.texts[k] for k in listed[j - n : j]])).hexdigest() if g else "" for j, n, g in zip(stop.tolist(), size.tolist(), there.tolist(), strict=True)]
    # one number a distinct (text, pair): the ids take what is left of 63 bits
    text_of = np.repeat(np.arange(len(texts)), size)
    n = known.counts[at, 3] * there[text_of]
    pair = known.pairs[np.repeat(known.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    width = known.bits + len(known.first.pieces).bit_length()
    keys, times = np.unique(np.repeat(text_of, n) << width | pair, return_counts=True)
    held = np.concatenate([[0], np.cumsum(np.bincount(keys >> width, minlength=len(texts)))])
    pair = (keys & (1 << width) - 1) >> known.bits << 32 | keys & (1 << known.bits) - 1
    links = pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int32())], ["pair", "n"]))
    columns = [pa.array(ids, pa.int64()), *[pa.array(counts[:, k]) for k in range(4)], pa.array(digests, pa.string()), links]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def linked_tokens(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``links``, the distinct pairs of linked ids (``a * SPREAD + b``) with their occurrences in the text.

    ``a`` are tokens of the byte-level vocabulary over a space and the text, ``b`` those of the
    piece vocabulary, which adds the space. A text that is null or empty, or whose tokens' bytes
    differ from it, has no tokens. Memory grows with the longest text, in some fifty times its bytes.
    """
    small_batches(docs.sparkSession)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(byte_bpe, piece_bpe)
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= SLICE_BYTES:
                    yield _slice(ids, texts, known)
                    ids, texts, size = [], [], 0
            if ids:
                yield _slice(ids, texts, known)

    return docs.select("doc_id", "text").mapInArrow(solve, SCHEMA)


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, count, best: how many texts hold each pair of ids linked, and whether that is the highest count of its first id.

    Counts are summed twice: first by (pair, salt of the task that read the text), then by pair,
    so a pair that every text holds comes from many tasks in ``SALTS`` parts.
    """
    salted = linked.select(F.explode("links.pair").alias("pair"), (F.spark_partition_id() % SALTS).alias("salt")).groupBy("pair", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("count"))
    first = Window.partitionBy(F.expr(f"pair div {SPREAD}"))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(first)).alias("best"))


def alignment_report(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    n_best: links whose pair is held by as many texts as any pair of its first id; count_sum: over
    links, the number of texts that hold their pair. Texts without tokens (see
    :func:`linked_tokens`) have zeros and an empty digest. Rows that repeat, or share an id or
    have none, each count as a text; extra columns are ignored; an empty table gives no rows.
    """
    linked = staged(linked_tokens(docs, byte_bpe, piece_bpe), "links")
    counts = staged(pair_counts(linked), "counts")
    own = ["__row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    flat = linked.withColumn("__row", F.monotonically_increasing_id()).select(*own, F.inline_outer("links"))
    met = flat.join(broadcast_if_small(counts), "pair", "left")
    n = F.col("n").cast("long")
    summed = met.groupBy(*own).agg(F.coalesce(F.sum(F.when(F.col("best"), n)), F.lit(0)).alias("n_best"), F.coalesce(F.sum(n * F.col("count")), F.lit(0)).alias("count_sum"))
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
