"""Words and shingles of Arrow text columns as NumPy hash arrays, without a Python object per word.

Used inside tasks only. Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts joined, and where each begins and ends (n + 1 offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def blocks(off: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of texts of ``limit`` bytes at most, or of one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and which bytes are white space."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return low, space


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), U64(0x9E3779B97F4A7C15) | U64(1), U64)
    p[0] = 1
    return np.cumprod(p, dtype=U64)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, and the n + 1 offsets of each text's words."""
    low, space = tables()
    b = low[data[off[0] : off[-1]]]
    o = off - off[0]
    word = ~space[b]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = o[:-1][o[:-1] < len(b)]
    start[heads] = word[heads]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    at = np.flatnonzero(word)
    lens = np.add.reduceat(word, starts, dtype=np.int64)
    first = np.cumsum(lens) - lens
    place = np.arange(len(at)) - np.repeat(first, lens)
    h = np.add.reduceat((b[at].astype(U64) + U64(1)) * powers(int(lens.max()))[place], first)
    return mix(h + lens.astype(U64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(starts, o)


def shingle_hashes(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words in each text and their n + 1 offsets; a shorter text is one run, an empty one none."""
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(soff[-1]), U64)
    if len(words) >= k:
        run = np.zeros(len(words) - k + 1, U64)
        for j in range(k):
            run += words[j : len(words) - k + 1 + j] * powers(k + 1)[j + 1]
        inside = np.arange(len(run)) + k <= np.repeat(woff[1:], n)[: len(run)]
        out[np.repeat(n >= k, count)] = mix(run[inside])
    for d in np.flatnonzero((n > 0) & (n < k)):
        h = np.array([n[d]], U64)
        for w in words[woff[d] : woff[d + 1]]:
            h = mix(h * U64(31) + w)
        out[soff[d]] = h[0]
    return out, soff


def shingle_sets(column: pa.Array, k: int, limit: int = 1 << 19) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sorted distinct shingle hashes of each text, block by block: the number of the first text, and the sets."""
    data, off = text_bytes(column)
    for i, j in blocks(off, limit):
        sh, soff = shingle_hashes(*word_hashes(data, off[i : j + 1]), k)
        yield i, [np.unique(sh[s:e]) for s, e in zip(soff[:-1], soff[1:], strict=True)]
