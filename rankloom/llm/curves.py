"""Approximate nearest neighbours by shifted Hilbert curves through projections of the vectors.

Every curve projects the vectors by a rotation of its own, shifts them, and orders them along a Hilbert curve. Near vectors are near on
some of the curves, so a query is compared with the windows around its places on all of them, and what the windows find is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, discard, stored

#: Projected dimensions of a curve and bits of each; the bits of the key below them break ties by the vector's id.
DIMENSIONS, BITS, TIE = 12, 4, 15
#: Curves that every item is on.
CURVES = 24
#: Rows whose mean and deviation the grid is fitted to, and queries that windows are fitted to.
FITTED, TRIED = 4096, 192
#: Share of the true neighbours of those queries that the windows must hold.
TARGET = 0.95
#: Rows of a cell, a part of a curve that one task searches, where windows aren't wider; and cells of a curve at most.
CELL, MOST_CELLS = 8192, 8192


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits`` bits in each column: neighbours on the curve differ by one in one column.

    The columns are turned into the transposed index in place of a table of rotations: for each bit, from the highest, a column
    with the bit set inverts the lower bits of the first column, one without it exchanges them with the first column's.
    A Gray code over the columns follows.
    """
    x = [axes[:, i].astype(np.int64) for i in range(axes.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            inverted = -((x[i] >> b) & 1)
            swap = (x[0] ^ x[i]) & low & ~inverted
            x[0] = x[0] ^ swap ^ (inverted & low)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= -((x[-1] >> b) & 1) & ((1 << b) - 1)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for column in x:
            key = (key << 1) | (((column ^ flip) >> b) & 1)
    return key


class Grid:
    """The projections of all curves, fitted to a sample: each projected dimension spans five deviations, shifted by up to one step."""

    def __init__(self, sample: np.ndarray, seed: int):
        self.width, self.seed = sample.shape[1], seed
        self.mean = sample.mean(0) if len(sample) else np.zeros(self.width)
        centred = sample - self.mean
        self.spread = [np.maximum((centred @ self.turn(c).T).std(0) if len(sample) else 1.0, 1e-12) for c in range(CURVES)]

    def turn(self, curve: int) -> np.ndarray:
        """Orthonormal directions of a curve, and random ones where there are fewer dimensions than the curve has."""
        draw = np.random.default_rng([self.seed, curve]).standard_normal((max(self.width, 1), DIMENSIONS))
        return np.linalg.qr(draw)[0].T if self.width >= DIMENSIONS else draw.T[:, : self.width]

    def keys(self, vectors: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        shift = np.random.default_rng([self.seed, curve, 1]).random(DIMENSIONS)
        steps = ((vectors - self.mean) @ self.turn(curve).T / self.spread[curve] / 5 + 0.5) * ((1 << BITS) - 1) + shift
        places = hilbert(np.clip(np.floor(steps), 0, (1 << BITS) - 1).astype(np.int64), BITS)
        tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE)
        return (places << TIE) | tie.astype(np.int64)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column in double precision, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat, begins = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size) - size
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(begins, size)] = flat
    return out


def padded(vector: list[float], width: int) -> np.ndarray:
    return np.pad(np.array(vector, np.float64), (0, width - len(vector)))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added in the order of the dimensions."""
    total = np.zeros(len(vectors))
    for t in range(len(query)):
        total += (vectors[:, t] - query[t]) ** 2
    return np.sqrt(total)


def nearest(vectors: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the rows among the k nearest, ties of the last included."""
    off = vectors - query
    rough = np.einsum("ij,ij->i", off, off)
    near = np.arange(len(rough))
    if len(rough) > k:
        near = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] * (1 + 1e-9))
    exact = distances(vectors[near], query)
    if len(near) > k:
        ok = exact <= np.partition(exact, k - 1)[k - 1]
        near, exact = near[ok], exact[ok]
    return near, exact


def usable(rows: DataFrame, kind: str) -> DataFrame:
    """id and vector of the rows that take part; a repeated id counts once, with its least vector."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.select(F.col("id").cast("long"), F.col("vector").cast(f"array<{kind}>")).where("id IS NOT NULL AND vector IS NOT NULL")
    # Adding zero makes both zeros one.
    return rows.where(F.forall("vector", number) & F.exists("vector", lambda x: x != 0)).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast(kind)))


def points(rows: DataFrame, keep: int) -> DataFrame:
    """ids, vector: each distinct vector with its ``keep`` smallest ids. No other id of a vector can be in a result.

    Ids of a vector that many rows have are cut in 16 parts first, so they meet in no single task.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    part = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16))).withColumn("n", first("vector", "part")).where(F.col("n") <= keep)
    return part.withColumn("n", first("vector")).where(F.col("n") <= keep).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def true_neighbours(found: DataFrame, tried: list, width: int, k: int) -> list:
    """Rows (q, id, vector) of the ``k`` nearest points of a bounded list of queries, by comparing them with all points."""
    asked = np.array([padded(t.vector, width) for t in tried])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        for b in batches:
            m, firsts = matrix(b.column("vector"), width), pa.compute.list_element(b.column("ids"), 0).to_numpy(zero_copy_only=False)
            for q, v in enumerate(asked):
                places, far = nearest(m, v, k + 1)
                more = sorted(zip(far.tolist(), firsts[places].tolist(), places.tolist(), strict=True))[: k + 1]
                if len(best[q]) <= k or more[0][:2] < best[q][-1][:2]:
                    best[q] = sorted([*best[q], *((d, i, m[at]) for d, i, at in more)], key=lambda x: x[:2])[: k + 1]
        for q, rows in enumerate(best):
            if rows:
                far, ids, vectors = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.int32()), pa.array(ids), pa.array(far), pa.array([v.tolist() for v in vectors])], ["q", "id", "far", "vector"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))
    return found.mapInArrow(compare, "q int, id long, far double, vector array<double>").withColumn("n", rank).where(F.col("n") <= k + 1).collect()


def rank_gaps(found: DataFrame, grid: Grid, tried: list, near: list) -> np.ndarray:
    """For each pair of a tried query and a true neighbour, and each curve: how many points lie between them on the curve."""
    known: dict[int, int] = {}
    vectors, width = [], grid.width
    for r in [*tried, *near]:
        if known.setdefault(r.id, len(vectors)) == len(vectors):
            vectors.append(padded(r.vector, width))
    table, ids = np.array(vectors).reshape(-1, width), np.array(list(known), np.int64)
    keys = np.array([grid.keys(table, ids, c) for c in range(CURVES)])
    order = np.sort(keys, 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((len(order), order.shape[1] + 1), np.int64)
        for b in batches:
            m, first = matrix(b.column("vector"), width), pa.compute.list_element(b.column("ids"), 0).to_numpy(zero_copy_only=False)
            for c in range(len(order)):
                bins[c] += np.bincount(np.searchsorted(order[c], grid.keys(m, first, c), "right"), minlength=bins.shape[1])
        for c in range(len(order)):
            at = np.flatnonzero(bins[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(bins[c][at])], ["curve", "bin", "n"])

    below = np.zeros((len(order), order.shape[1] + 1), np.int64)
    for r in found.mapInArrow(count, "curve int, bin int, n long").groupBy("curve", "bin").agg(F.sum("n").alias("n")).collect():
        below[r.curve, r.bin] = r.n
    ranks = below.cumsum(1)
    place = np.array([ranks[c][np.searchsorted(order[c], keys[c])] for c in range(len(order))])
    pairs = [(known[tried[r.q].id], known[r.id]) for r in near if r.id != tried[r.q].id]
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return np.abs(place[:, a] - place[:, b])


def fitted_window(gaps: np.ndarray, least: int) -> int:
    """Rows on either side of a query: the fewest, ``least`` at least, with TARGET of the pairs in the window of some curve."""
    closest = np.sort(gaps.min(0))
    return max(least, int(closest[int(TARGET * (len(closest) - 1))]) + 1) if len(closest) else least


def nearest_neighbours(queries: DataFrame, items: DataFrame, k: int = 10, least_window: int = 256, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest items found of each query, by Euclidean distance, ties to smaller ids.

    Both inputs have ``id`` (long) and ``vector`` (an array of numbers); missing dimensions are 0. A query's own id is no
    candidate. Rows with a null id or vector, with a null or non-finite component, and vectors without a component other than 0
    take no part. A repeated id counts once, with its least vector; equal vectors are searched once and
    all their ids that can be in a result are returned. Fewer than k candidates are all found. Other columns don't matter; an
    empty table on either side gives no rows. Distances are those of the vectors themselves.

    Every item is on every curve. How many rows around a query are compared is fitted: for TRIED queries (those of
    least hash; a bound, not a share) the true neighbours are found by comparing them with all items, and windows are as
    wide as it takes to hold TARGET of those neighbours. Vectors that have no structure need wide windows, up to all rows, and get them. Curves are cut into cells of even size; a query goes to its cell and
    both beside it, so that windows cross the cuts.
    """
    spark = items.sparkSession
    bounded_batches(spark)
    kinds = [x.schema["vector"].dataType.elementType.simpleString() for x in (queries, items)]
    kind = "float" if kinds == ["float", "float"] else "double"
    asked = stored(usable(queries, kind), "asked")
    found = stored(points(usable(items, kind), k + 1), "points")
    n, width = found.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    shared = F.row_number().over(Window.partitionBy("vector", "part").orderBy("id"))
    lone = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16))).withColumn("n", shared).where("n = 1").groupBy("vector").agg(F.min("id").alias("id"))
    lone = stored(lone, "lone")
    width = max(1, width, lone.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0])
    sample = found.orderBy(F.xxhash64("vector")).limit(FITTED).select("vector").toArrow()
    grid = Grid(matrix(sample.column("vector"), width), seed)
    tried = lone.orderBy(F.xxhash64("vector")).limit(TRIED).collect()
    near = true_neighbours(found, tried, width, k) if n and tried else []
    window = fitted_window(rank_gaps(found, grid, tried, near), max(least_window, k + 1)) if near else least_window
    cells = max(1, min(MOST_CELLS, n // max(CELL, 4 * window)))

    def on_curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, first = matrix(b.column("vector"), width), pa.compute.list_element(b.column("ids"), 0).to_numpy(zero_copy_only=False)
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c, np.int32)), pa.array(grid.keys(m, first, c))], ["curve", "key"])

    cuts = np.zeros((CURVES, 0), np.int64)
    if cells > 1:
        shares = [i / cells for i in range(1, cells)]
        by_curve = found.mapInArrow(on_curves, "curve int, key long").groupBy("curve").agg(F.percentile_approx("key", shares, max(10_000, 20 * cells)).alias("cuts"))
        cuts = np.array([r.cuts for r in by_curve.orderBy("curve").collect()], np.int64)

    def placed(beside: bool):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, first = matrix(b.column("vector"), width), pa.compute.list_element(b.column("ids"), 0).to_numpy(zero_copy_only=False)
                for c in range(CURVES):
                    keys = grid.keys(m, first, c)
                    own = np.searchsorted(cuts[c], keys, "right")
                    for step in (-1, 0, 1) if beside else (0,):
                        at = np.flatnonzero((own + step >= 0) & (own + step < cells))
                        some = b.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array((own[at] + step).astype(np.int32)), pa.array(keys[at]), some.column("ids"), some.column("vector")], ["curve", "cell", "key", "ids", "vector"])

        return place

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            right = right.take(np.argsort(right.column("key").to_numpy(), kind="stable"))
            keys, m, lists = right.column("key").to_numpy(), matrix(right.column("vector"), width), right.column("ids").combine_chunks()
            size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat, begins = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            heads = pa.compute.list_element(left.column("ids").combine_chunks(), 0).to_numpy(zero_copy_only=False)
            for query, key, v in zip(heads, left.column("key").to_numpy(), matrix(left.column("vector"), width), strict=True):
                low = max(0, int(np.searchsorted(keys, key, "left")) - window)
                at, far = nearest(m[low : int(np.searchsorted(keys, key, "right")) + window], v, k + 1)
                for place, d in zip(at + low, far, strict=True):
                    ids = flat[begins[place] : begins[place] + size[place]]
                    out[0].append(np.full(len(ids), query)), out[1].append(ids), out[2].append(np.full(len(ids), d))
        joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2])], names=["asked", "vec_id", "score"])

    shape = f"curve int, cell int, key long, ids array<long>, vector array<{kind}>"
    q = lone.select(F.array("id").alias("ids"), "vector").mapInArrow(placed(True), shape)
    d = found.mapInArrow(placed(False), shape)
    hits = q.groupBy("curve", "cell").cogroup(d.groupBy("curve", "cell")).applyInArrow(search, "asked long, vec_id long, score double")
    once = hits.groupBy("asked", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("score", "vec_id"))
    kept = once.withColumn("n", rank).where(F.col("n") <= k + 1)
    lists = stored(kept.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("hits")), "hits")
    discard(found)
    # Each query vector's list goes to all queries that have the vector, in 16 parts.
    parts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part")
    answers = lists.join(lone, F.col("asked") == F.col("id")).select("vector", "hits", parts)
    each = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(answers, ["vector", "part"])
    own = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("id")), 1, k)
    ranked = each.select(F.col("id").alias("query_id"), F.posexplode(own).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id"), F.col("hit.score"))
