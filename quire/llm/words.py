"""Vectorised hashing of words and word shingles over batches of texts."""

from __future__ import annotations

import ctypes
import hashlib
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_COEF = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts in order, and the text each belongs to."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, inverse = _power(len(data))
    total = np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)
    h = total[end - 1] - np.where(start > 0, total[start - 1], _U(0))
    h = mix(h * inverse[start] + (end - start).astype(np.uint64) * _COEF[7])
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    return h, np.searchsorted(ends, start, "right")


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle; without words empty."""
    h, of = word_hashes(texts)
    cut = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
    n = len(h) - k + 1
    if n > 0:
        s = h[:n] * _COEF[0]
        for i in range(1, k):
            s += h[i : i + n] * _COEF[i]
        s = mix(s)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif b > a:
            out.append(mix((h[a:b] * _COEF[: b - a]).sum(keepdims=True) + _U((b - a) * 0x5851F42D4C957F2D & (2**64 - 1))))
        else:
            out.append(h[:0])
    return out


def text_key(lowered: bytes) -> bytes | None:
    """A 128-bit digest of the word sequence; None without words."""
    words = lowered.split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


@lru_cache(1)
def _malloc_trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean(run):
    """run, a function over Arrow batches, that hands freed memory back to the system after each batch it yields.

    Workers live on between stages, and what one keeps is missing to the next one.
    """

    @wraps(run)
    def given_back(batches):
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
            if trim := _malloc_trim():
                trim(0)

    return given_back


def chunks(sizes: list[int], limit: int):
    """Ranges of neighbouring items of at most limit in all, one item at least."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)
