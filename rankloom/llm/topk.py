"""Exact top-k search by MaxScore over impact postings, shard by shard, with a merge of the shards."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of a shard, and queries of a block: one task scores one block against one shard.
SHARD, BLOCK = 8192, 2048
#: Terms of a query that are probed before the candidates are checked against the threshold again.
PROBE = 4
#: Items of the highest impact in a query's largest terms that its first threshold is taken from, for each result asked for.
GUESS = 2


def matrix(table: pa.Table, width: int) -> np.ndarray:
    """Rows of the list column ``vector``, padded with zeros: a missing term adds nothing."""
    column = table.column("vector").combine_chunks()
    flat, off = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy())])
    out = np.zeros((len(column), width), np.int64)
    size = np.diff(off)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(off[:-1], size)] = flat
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[best(ids[some], scores[some], k)] if len(some) < len(ids) else np.lexsort((ids, descending(scores)))[:k]
    return np.lexsort((ids, descending(scores)))[:k]


def descending(scores: np.ndarray) -> np.ndarray:
    """Keys in reverse order; the least long has no negative."""
    return ~scores if scores.dtype == np.int64 else -scores


class Postings:
    """The items of a shard by term: a dimension with a sign. A posting list has the places of the items whose value in
    the dimension has the sign, the largest impact first, and those impacts."""

    def __init__(self, ids: np.ndarray, items: np.ndarray):
        self.ids, self.items, self.touched = ids, items, 0
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for t in range(items.shape[1]):
            order = np.argsort(-items[:, t], kind="stable")
            value = items[order, t]
            above, below = int((value > 0).sum()), int((value < 0).sum())
            self.lists[t, 1] = order[:above], value[:above]
            self.lists[t, -1] = order[len(order) - below :][::-1], value[len(order) - below :][::-1]

    def bound(self, t: int, w: int) -> int:
        """The most that a term adds to a score; its items are those of the weight's sign."""
        value = self.lists[t, 1 if w > 0 else -1][1]
        return w * value[0] if len(value) and w else 0

    def guess(self, w: np.ndarray, order: list[int], k: int) -> np.ndarray:
        """Places of the items of the highest impact in a query's two largest terms."""
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(self.lists[t, 1 if w[t] > 0 else -1][0][: GUESS * k + 1] for t in order[-2:] if w[t])]))

    def search(self, query: int, w: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best items, of those whose score is at least ``floor`` (None: of all), the query's own left out.

        Terms in order of their bounds are non-essential as long as their bounds sum to less than the threshold: an item
        that only they hold can't be in the result. The postings of the other, essential terms are traversed and
        give each item that they hold its score so far. Items that can reach the threshold are probed in what is
        left: the non-essential terms, highest bound first, and the values of the opposite sign, which only take away.
        The threshold is raised to the k-th of the scores that are complete.
        """
        kind, n, width = self.items.dtype, len(self.ids), self.items.shape[1]
        bounds = [self.bound(t, w[t]) for t in range(width)]
        order = sorted(range(width), key=bounds.__getitem__)
        first = self.guess(w, order, k)
        first = first[self.ids[first] != query]
        if len(first) >= k:
            # Beyond a long all scores are equal, so the threshold goes no higher.
            own = min(np.sort(self.items[first] @ w)[-k], 2**63 - 1)
            floor = own if floor is None else max(floor, own)
        total = list(accumulate(bounds[t] for t in order))
        spared = sum(b < floor for b in total) if floor is not None else 0
        acc, held = np.zeros(n, kind), np.zeros(n, bool)
        for t in order[spared:]:
            places, impact = self.lists[t, 1 if w[t] > 0 else -1] if w[t] else (np.zeros(0, np.int64), np.zeros(0, kind))
            acc[places] += w[t] * impact
            held[places] = True
            self.touched += len(places)
        # Without a threshold, or with one that is not above 0, items that hold none of the terms count too.
        if floor is None or floor <= 0:
            held[:] = True
        rest = total[spared - 1] if spared else 0
        live = np.flatnonzero(held & (self.ids != query))
        if floor is not None:
            live = live[acc[live] + rest >= floor]
        score = acc[live]
        essential = order[spared:]
        if essential:
            score = score + np.minimum(self.items[live][:, essential] * w[essential], 0).sum(1)
        left = spared
        while left or not essential:
            if floor is not None:
                ok = score + (total[left - 1] if left else 0) >= floor
                live, score = live[ok], score[ok]
            if not left:
                break
            terms = order[max(0, left - PROBE) : left]
            left = max(0, left - PROBE)
            score = score + self.items[live][:, terms] @ w[terms]
        if kind == object:
            score = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in score], np.int64)
        chosen = best(self.ids[live], score, k)
        return self.ids[live][chosen], score[chosen]


def exact_kind(queries: np.ndarray, items: np.ndarray) -> type:
    """Sums are exact: in doubles below 2^53, in 64-bit integers below 2^62, else in Python's integers."""
    largest = max(int(np.abs(queries).max(initial=0)), 1) * max(int(np.abs(items).max(initial=0)), 1) * max(1, items.shape[1])
    return np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 62 else object


def inputs(queries: pa.Table, items: pa.Table) -> tuple[np.ndarray, np.ndarray, Postings] | None:
    """Ids and vectors of a block's queries, and the postings of a shard."""
    if not queries.num_rows or not items.num_rows:
        return None
    width = max(int(pa.compute.max(pa.compute.list_value_length(t.column("vector"))).as_py()) for t in (queries, items))
    q, d = matrix(queries, width), matrix(items, width)
    kind = exact_kind(q, d)
    return queries.column("id").to_numpy(), q.astype(kind), Postings(items.column("id").to_numpy(), d.astype(kind))


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def result(qids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    return pa.table(
        [pa.array(np.repeat(qids, [len(i) for i, _ in found])), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]).astype(np.int64))],
        schema=FOUND,
    )


def guesser(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of a few items of each shard, which the threshold that all shards begin with is taken from."""

    def guess(queries: pa.Table, items: pa.Table) -> pa.Table:
        given = inputs(queries, items)
        if given is None:
            return FOUND.empty_table()
        qids, q, postings = given
        out = []
        for query, w in zip(qids, q, strict=True):
            order = sorted(range(len(w)), key=lambda t, w=w: postings.bound(t, w[t]))
            at = postings.guess(w, order, k)
            at = at[postings.ids[at] != query]
            score = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in postings.items[at] @ w], np.int64)
            chosen = best(postings.ids[at], score, k)
            out.append((postings.ids[at][chosen], score[chosen]))
        return result(qids, out)

    return guess


def searcher(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(queries: pa.Table, items: pa.Table) -> pa.Table:
        given = inputs(queries, items)
        if given is None:
            return FOUND.empty_table()
        qids, q, postings = given
        return result(qids, [postings.search(i, w, k, f) for i, w, f in zip(qids, q, queries.column("floor").to_pylist(), strict=True)])

    return search


def top_k(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best items by integer inner product.

    Both inputs have ``id`` (long) and ``vector`` (array<long>); missing dimensions are 0. A query's own id is
    no candidate; ties go to the smaller id. Fewer than k candidates are all returned. Rows with a null id or
    vector, or a null in the vector, take no part. A repeated query id counts once (its least vector); repeated
    item rows are items of their own. Scores beyond a long are its nearest value.

    Items are hashed into shards of SHARD rows and queries into blocks of BLOCK rows; each block meets each
    shard in one task, which builds the shard's postings and returns k rows a query at most. A first pass scores a
    few items of each shard, and the k-th best of all of them is the threshold that every shard begins with. A
    ranking by query with a limit before the shuffle merges the shards. Other columns don't matter; an empty table
    on either side gives no rows.
    """
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    queries = queries.select(F.col("id").cast("long"), F.col("vector").cast("array<long>")).where(whole).groupBy("id").agg(F.min("vector").alias("vector"))
    items = items.select(F.col("id").cast("long"), F.col("vector").cast("array<long>")).where(whole)
    shards, n_blocks = max(1, -(-items.count() // SHARD)), max(1, -(-queries.count() // BLOCK))
    spread = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    d = items.withColumn("shard", spread("id", shards, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    keys = ["shard", "block"]
    kinds = "query_id long, vec_id long, score long"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def met(queries: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        q = queries.withColumn("block", spread("id", n_blocks, 1)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        found = q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(work, kinds)
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    # Repeated items count each, so k rows are k items.
    guessed = met(queries, guesser(k)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    return met(queries.join(guessed, "id", "left"), searcher(k)).select("query_id", "rank", "vec_id", "score")
