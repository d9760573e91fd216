"""Word shingles and MinHash signatures in numpy, over many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once; a longer text is hashed alone, piece by piece.
CHUNK_BYTES = 1 << 20
#: Shingles of a long text that are folded at once.
FOLD = 1 << 18

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunks(texts: list[bytes]) -> Iterator[list[int]]:
    """Indices of texts that go together."""
    some, held = [], 0
    for i, t in enumerate(texts):
        if some and held + len(t) > CHUNK_BYTES:
            yield some
            some, held = [], 0
        some.append(i)
        held += len(t) + 1
    if some:
        yield some


def _words(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, polynomial value and length of each run of bytes other than white space."""
    raw = np.frombuffer(joined, np.uint8)
    edge = np.diff(np.concatenate(([True], _IS_SPACE[raw], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    prefix = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * _powers(BASE, len(raw)))))
    return start, end, (prefix[end] - prefix[start]) * _powers(INVERSE, max(1, len(raw)))[start], (end - start).astype(U)


def _folded(word: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    h = np.full(len(at), length, U)
    for k in range(length):
        h = mixed(h * U(0x9E3779B97F4A7C15) + word[at + k])
    return h


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text of any length, in pieces of CHUNK_BYTES; a word may span pieces."""
    out: list[np.ndarray] = []
    value, length = U(0), 0  # of a word that the last piece left open
    for at in range(0, len(text), CHUNK_BYTES):
        piece = text[at : at + CHUNK_BYTES].lower()
        start, end, values, sizes = _words(piece)
        if length:
            if len(start) and start[0] == 0:
                with np.errstate(over="ignore"):
                    values[0] = value + values[0] * U(pow(BASE, length, 1 << 64))
                sizes[0] += U(length)
            else:
                out.append(mixed(np.array([value + U(0)]) + U(length)))
            value, length = U(0), 0
        if len(end) and end[-1] == len(piece) and at + CHUNK_BYTES < len(text):
            value, length = values[-1], int(sizes[-1])
            values, sizes = values[:-1], sizes[:-1]
        out.append(mixed(values + sizes))
    if length:
        out.append(mixed(np.array([value]) + U(length)))
    return np.concatenate(out) if out else np.zeros(0, U)


def long_set(text: bytes, n: int) -> np.ndarray:
    """The shingle set of one text of any length, sorted; takes about five times its bytes."""
    word = word_hashes(text)
    length = min(n, len(word))
    if not length:
        return np.zeros(0, U)
    h = np.empty(len(word) - length + 1, U)
    for at in range(0, len(h), FOLD):
        places = np.arange(at, min(at + FOLD, len(h)))
        h[places] = _folded(word, places, length)
    del word
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct n-word shingles of text i are hashes[ends[i - 1] : ends[i]], sorted.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A text of 1 to n - 1
    words has one shingle, its whole sequence.
    """
    if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
        h = long_set(texts[0], n)
        return h, np.array([len(h)])
    joined = b" ".join(t.lower() for t in texts)
    starts_of = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    start, _, values, sizes = _words(joined)
    word = mixed(values + sizes)
    doc = np.searchsorted(starts_of, start, "right") - 1
    counts = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), int)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]

    at = np.arange(max(0, len(word) - n + 1))
    at = at[doc[at] == doc[at + n - 1]] if len(at) else at
    parts, owners = [_folded(word, at, n)], [doc[at]]
    for length in range(1, n):
        short = np.flatnonzero(counts == length)
        parts.append(_folded(word, first[short], length))
        owners.append(short)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.cumsum(np.bincount(owner, minlength=len(texts))) if len(h) else np.zeros(len(texts), int)


def signatures(h: np.ndarray, ends: np.ndarray, n_hashes: int, seed: int = 5) -> np.ndarray:
    """MinHash values, one row a text that has shingles (in order)."""
    sizes = np.diff(np.concatenate(([0], ends)))
    starts = (ends - sizes)[sizes > 0]
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64) * U(2) + U(1)
    shifts = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)
    out = np.empty((len(starts), n_hashes), U)
    for k in range(n_hashes if len(starts) else 0):
        out[:, k] = np.minimum.reduceat(h * factors[k] + shifts[k], starts)
    return out


def band_hashes(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of ``rows`` values, keyed by the band."""
    n_bands = values.shape[1] // rows
    h = np.broadcast_to(np.arange(1, n_bands + 1, dtype=U), (len(values), n_bands)).copy()
    for k in range(rows):
        h = mixed(h * U(0x9E3779B97F4A7C15) + values[:, k : n_bands * rows : rows])
    return h.view(np.int64)


def short_signature(values: np.ndarray) -> np.ndarray:
    """One byte of each value: two equal values agree, others do in 1 of 256 cases."""
    return (mixed(values) & U(255)).astype(np.uint8)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted sets a and b have 100 |a & b| >= percent |a | b|."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
