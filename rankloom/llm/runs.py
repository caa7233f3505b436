"""Runs of repeated words in texts, by internal pattern matching on a suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.common import bounded_batches

#: Words of texts that are searched side by side; a longer text is searched alone.
TOGETHER = 1 << 18


class Suffixes:
    """The suffix array of some symbols, and for each power of two h the place in it where the suffixes begin that share their
    first h symbols with a position's own."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.array = np.argsort(symbols, kind="stable").astype(np.int32)
        first = np.ones(n, bool)
        first[1:] = symbols[self.array[1:]] != symbols[self.array[:-1]]
        rank = np.empty(n, np.int32)
        rank[self.array] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.ranks, self.sizes = [rank], []
        h = 1
        while True:
            rank = self.ranks[-1]
            size = np.bincount(rank, minlength=n).astype(np.int32)
            self.sizes.append(size)
            # Only suffixes that share h symbols with another one are sorted on, by the next h symbols.
            shared = self.array[size[rank[self.array]] > 1].astype(np.int64)
            if not len(shared):
                break
            after = np.where(shared + h < n, rank[np.minimum(shared + h, n - 1)].astype(np.int64) + 1, 0)
            key = rank[shared].astype(np.int64) * (n + 1) + after
            order = np.argsort(key, kind="stable")
            shared, key = shared[order], key[order]
            group = rank[shared].astype(np.int64)
            heads = np.ones(len(group), bool)
            heads[1:] = group[1:] != group[:-1]
            slot = group + np.arange(len(group)) - np.maximum.accumulate(np.where(heads, np.arange(len(group)), 0))
            self.array[slot] = shared
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            finer = rank.copy()
            finer[shared] = np.maximum.accumulate(np.where(new, slot, 0))
            self.ranks.append(finer)
            h *= 2

    def common(self, a: np.ndarray, b: np.ndarray, backward: bool = False) -> np.ndarray:
        """How many symbols from (before, if ``backward``) two positions on are the same."""
        n, a, b = len(self.array), a.copy(), b.copy()
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            h, rank = 1 << k, self.ranks[k]
            x, y = (a - length - h, b - length - h) if backward else (a + length, b + length)
            inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
            length += h * (inside & (rank[np.clip(x, 0, n - 1)] == rank[np.clip(y, 0, n - 1)]))
        return length


class WaveletTree:
    """Values by position, bit after bit from the highest, those with a 0 before those with a 1: answers range successors."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least value above ``bound`` among those at ``low`` to ``high - 1``, or -1."""
        l, r, smaller = low.astype(np.int64), high.astype(np.int64), np.zeros(len(low), np.int64)
        above = bound.astype(np.int64) + 1
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            zl, zr = zeros[l], zeros[r]
            one = (above >> bit) & 1 == 1
            smaller += np.where(one, zr - zl, 0)
            l, r = np.where(one, zeros[-1] + l - zl, zl), np.where(one, zeros[-1] + r - zr, zr)
        there = smaller < high - low
        l, r, value, nth = low.astype(np.int64), high.astype(np.int64), np.zeros(len(low), np.int64), np.where(there, smaller, 0)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            zl, zr = zeros[l], zeros[r]
            one = nth >= zr - zl
            nth = np.where(one, nth - (zr - zl), nth)
            l, r = np.where(one, zeros[-1] + l - zl, zl), np.where(one, zeros[-1] + r - zr, zr)
            value |= one.astype(np.int64) << bit
        return np.where(there, value, -1)


def find_runs(symbols: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all maximal runs of at least ``least`` symbols and ``times`` (3 or more) periods, by start and period.

    A block of length b = 2^k begins at every multiple of b / 2. Its occurrences are an interval of the suffix array, and those
    at most b further on form an arithmetic progression, whose difference, the distance of the first, is the smallest period of what the
    block and that occurrence cover. A run with b / 2 < period <= b has 4 periods, so a block and its next occurrence lie in it,
    with at most 3.5 periods (of fewer times, blocks begin closer). Candidates are extended both ways as far as the period holds.
    """
    if len(symbols) < max(2, least):
        return (np.zeros(0, np.int64),) * 3
    s = Suffixes(symbols)
    tree = WaveletTree(s.array)
    starts, periods = [], []
    for k, (rank, size) in enumerate(zip(s.ranks, s.sizes, strict=True)):
        b = 1 << k
        at = np.arange(0, len(symbols), max(1, b // (2 if times > 3 else 8)))
        at = at[size[rank[at]] > 1]
        if len(at):
            begin = rank[at]
            p = tree.successor(begin, begin + size[begin], at) - at
            near = (p > b // 2) & (p <= b)
            starts.append(at[near]), periods.append(p[near])
    i, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, periods))
    before = s.common(i, i + p, backward=True)
    start, length = i - before, before + p + s.common(i, i + p)
    long = length >= np.maximum(least, times * p)
    found = np.unique(np.stack([start[long], p[long], length[long]], 1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def together(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of texts in portions of TOGETHER words, or of one longer text, with the number of each portion's first text."""
    first, held, n = 0, [], 0
    for t in texts:
        words = t.split()  # at bytes 9 to 13 and 32
        if held and n + len(words) > TOGETHER:
            yield first, held
            first, held, n = first + len(held), [], 0
        held.append(words)
        n += len(words)
    if held:
        yield first, held


RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, keep: list[str], text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """The columns ``keep``, ``runs`` and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are and numbered from 0. A run is a stretch of consecutive words with
    smallest period q, at least ``least`` words and ``times * q`` (``times``: 3 or more) long, that no neighbouring word extends keeping
    the period; ``runs`` has all, by start and period. ``collapsed`` is the words joined by one space, without those that some
    run has after its first period. A null or empty text, or one of white space, has no runs and collapses to an empty text. Repeated rows
    are rows of their own, an empty table stays empty, other columns go.

    Every text is searched whole in the task that reads it; nothing is shuffled. A text takes about a hundred bytes a word for each doubling
    of its longest repeat.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    bounded_batches(docs.sparkSession)
    shape = docs.select(*keep).schema
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).cast(pa.large_binary()).fill_null(b"").to_pylist()
            for first, docs_words in together(texts):
                size = np.array([len(w) for w in docs_words])
                begins, base, symbols = np.cumsum(size) - size, 0, []
                # Words of different texts are different symbols, so that nothing matches across texts.
                for words in docs_words:
                    known: dict[bytes, int] = {}
                    symbols.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
                    base += len(known)
                start, length, period = find_runs(np.concatenate(symbols), least, times)
                doc = np.searchsorted(begins + size, start, "right")
                covered = np.zeros(int(size.sum()) + 1, np.int64)
                np.add.at(covered, start + period, 1)
                np.add.at(covered, start + length, -1)
                stays = np.cumsum(covered)[:-1] == 0
                texts_out = []
                for words, at, n in zip(docs_words, begins, size, strict=True):
                    own = stays[at : at + n]
                    texts_out.append(b" ".join(words if own.all() else [words[j] for j in np.flatnonzero(own)]))
                offsets = np.searchsorted(doc, np.arange(len(docs_words) + 1))
                inner = pa.StructArray.from_arrays([pa.array(start - begins[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                rows = b.slice(first, len(docs_words))
                out = [*rows.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner).cast(kind), pa.array(texts_out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, [*keep, "runs", "collapsed"])

    return docs.select(*keep, docs[text_col].cast("string").alias("__text")).mapInArrow(search, f"{others + ', ' if others else ''}{RUNS}")
