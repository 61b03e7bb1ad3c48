"""Vectorised work on the UTF-8 bytes of many texts at once: words, prefix polynomial hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are worked on in pieces of about this many bytes, whole documents each, so arrays stay small.
CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

IS_WS = np.zeros(256, dtype=bool)
IS_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**k and its inverse modulo 2**64, for k under n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 4096)
        factors = np.full((2, size), [[base], [pow(base, -1, 1 << 64)]], dtype=np.uint64)
        factors[:, 0] = 1
        _POWERS.clear()
        have = _POWERS[base] = tuple(np.cumprod(factors, axis=1))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """P with P[j] - P[i] = (hash of data[i:j]) * base**i."""
    up, _ = powers(len(data) + 1, base)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    _, down = powers(len(prefix), base)
    return (prefix[end] - prefix[start]) * down[start]


def chunks(lengths: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes each (one long document may have more)."""
    first, size = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if size and size + n > limit:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(lengths):
        yield first, len(lengths)


def pieces(data: np.ndarray, offsets: np.ndarray, margin: int, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int, int, bool]]:
    """Documents in chunks, a long one in pieces that overlap: first document, bytes, ends of documents in them, place of the
    first byte, own range in the piece, and whether another piece of the same document follows."""
    for a, b in chunks(np.diff(offsets), limit):
        first, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - first <= 2 * limit:
            yield a, data[first:end], offsets[a : b + 1] - first, first, 0, end - first, False
            continue
        for s in range(first, end, limit):
            e = min(s + limit, end)
            x, y = max(first, s - margin), min(end, e + margin)
            yield a, data[x:y], np.array([0, y - x]), x, s - x, e - x, e < end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; a word ends where its document does."""
    n = len(data)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3
    blank = IS_WS[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start, end = ~blank, ~blank
    start[1:] &= blank[:-1] | edge[1:n]
    end[:-1] &= blank[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


_C = [int(x) for x in mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)]


def word_hashes(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word; one long document is worked on in parts that end between words."""
    if len(offsets) == 2 and len(data) > 2 * limit:
        out, at = [], 0
        while at < len(data):
            end = at + limit
            while end < len(data):
                gap = np.flatnonzero(IS_WS[data[end : end + limit]])
                if len(gap):
                    end += int(gap[0])
                    break
                end += limit
            end = min(end, len(data))
            out.append(word_hashes(data[at:end], np.array([0, 0, end - at]))[0])
            at = end
        h = np.concatenate(out)
        return h, np.zeros(len(h), dtype=np.int64)
    s, e, doc = word_spans(data, offsets)
    return mix(span_hash(prefix_hash(data), s, e) + (e - s).astype(np.uint64) * np.uint64(_C[7])), doc


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word ``size``-shingles of each document (lower-cased data).

    A document with fewer words has its whole word sequence as one shingle; one without words has none.
    """
    h, doc = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])
    m = max(0, len(h) - size + 1)
    joined = np.zeros(m, dtype=np.uint64)
    for k in range(size):
        joined += h[k : k + m] * np.uint64(_C[k])
    joined = mix(joined)
    out = []
    for d in range(n_docs):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            own = sum((int(x) * _C[k] for k, x in enumerate(h[a:b].tolist())), (b - a) * _C[6]) & MASK
            out.append(mix(np.array([own], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def to_planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: high bytes of small numbers then compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)
