"""Near-duplicates by MinHash bands, odd-sketch estimates and exact confirmation on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, discard, stored
from rankloom.llm.textvec import U64, blocks, mix, powers, shingle_hashes, shingle_sets, text_bytes, word_hashes

#: MinHash rows of a band, and the chance that a pair of just the least similarity shares no band.
ROWS, MISS = 4, 4e-7
#: A sketch folds up to SAMPLES MinHash samples, the least hash of each of so many parts of the hash space, into BITS parity bits.
SAMPLES, BITS = 1 << 14, 2048
#: Standard deviations that sampling, and that a sketch's estimate, may be off by and a pair still be confirmed.
DEVIATIONS = 5.0
#: Members of a bucket compared in one task at once.
BLOCK = 2048
#: Bits of the filter that spares texts of uninvolved documents a shuffle; its table has FILTER / 64 rows at most.
FILTER = 1 << 22

SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, n_samples int, sketch array<long>"


def n_bands(percent: int) -> int:
    """Bands that keep the chance of a miss at MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def signer(k: int, count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) -> SIGNATURE with ``count`` bands."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]
        + [("bands", pa.list_(pa.int64())), ("n_samples", pa.int32()), ("sketch", pa.list_(pa.int64()))]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mix(np.arange(1, count * ROWS + 1, dtype=U64)) | U64(1)
        weights = powers(ROWS + 1)[1:]
        for batch in batches:
            ids = batch.column(0)
            data, off = text_bytes(batch.column(1))
            for i, j in blocks(off):
                sh, soff = shingle_hashes(*word_hashes(data, off[i : j + 1]), k)
                sets = [np.unique(sh[s:e]) for s, e in zip(soff[:-1], soff[1:], strict=True)]
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                bands = np.zeros((j - i, count), U64)
                sketch = np.zeros((j - i, BITS), np.uint8)
                samples = np.zeros(j - i, np.int32)
                s1, s2 = np.zeros(j - i, U64), np.zeros(j - i, U64)
                if len(full):
                    u = np.concatenate([sets[d] for d in full])
                    first = np.cumsum(size[full]) - size[full]
                    least = np.stack([np.minimum.reduceat(u * f, first) for f in factors], 1).reshape(len(full), count, ROWS)
                    bands[full] = mix((mix(least) * weights).sum(2, dtype=U64) + np.arange(count, dtype=U64))
                    s1[full] = np.add.reduceat(mix(u ^ U64(0xA5A5A5A5)), first)
                    s2[full] = np.add.reduceat(mix(u + U64(0x5851F42D4C957F2D)), first)
                    # Sets are sorted, so the first hash of each part (by its low bits) is the part's least.
                    part = np.repeat(np.arange(len(full)), size[full]) * SAMPLES + (u & U64(SAMPLES - 1)).astype(np.int64)
                    part, least_at = np.unique(part, return_index=True)
                    bit = (mix(u[least_at] ^ U64(0x2545F4914F6CDD1D)) & U64(BITS - 1)).astype(np.int64)
                    sketch[full] = (np.bincount(part // SAMPLES * BITS + bit, minlength=len(full) * BITS) & 1).reshape(len(full), BITS)
                    samples[full] = np.bincount(part // SAMPLES, minlength=len(full))
                packed = np.packbits(sketch, axis=1).view(np.int64)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists(bands.view(np.int64)), pa.array(samples), lists(packed)],
                    schema=schema,
                )

    return sign


def confirmer(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, text_a, text_b) -> the (a, b) whose full sets are similar."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            right = shingle_sets(batch.column(3), k, 0)
            for (i, (a,)), (_, (b,)) in zip(shingle_sets(batch.column(2), k, 0), right, strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return confirm


NUMPY = SimpleNamespace(exp=np.exp, sqrt=np.sqrt, least=np.minimum)
COLUMNS = SimpleNamespace(exp=F.exp, sqrt=F.sqrt, least=lambda a, x: F.least(F.lit(a) if isinstance(a, float) else a, x))


def allowed(percent: int, na, nb, sa, sb, m: SimpleNamespace):
    """The most MinHash samples that two sets of at least the similarity differ by, from their sizes and numbers of samples.

    The parts of the hash space that the union fills hold the same least hash in both sets with the chance of
    their similarity. How many parts are filled follows from the union's size, and from how many the sets fill; the
    samples are drawn without replacement, so of small sets nearly all is known. Whatever is drawn, samples differ by no
    more than the sets do and by the elements that are no samples.
    """
    like = percent / 100
    union = (na + nb) / (1 + like)
    empty = m.exp(-union / SAMPLES)
    filled = SAMPLES * (1 - empty)
    seen = (sa + sb) / (SAMPLES * (2 - m.exp(-na / SAMPLES) - m.exp(-nb / SAMPLES)))
    same = like * filled * seen
    spread = same * (1 - like) * m.least(1.0, 2 * (1 - filled / union)) + 0.3 * like**2 * SAMPLES * empty * (1 - (1 + union / SAMPLES) * empty)
    return m.least(sa + sb - 2 * (same - DEVIATIONS * m.sqrt(spread + 0.1)), (na + nb) * (1 - like) / (1 + like) + (na - sa) + (nb - sb) + 1e-6)


def crosser(percent: int, best: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, node, component, n_shingles, n_samples, sketch), sorted by key -> pairs (a, b) of a key.

    Pairs of different components whose sketches allow the similarity; with ``best`` only each node's best.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(node: np.ndarray, comp: np.ndarray, n: np.ndarray, samples: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, BLOCK // 16)
        for lo in range(0, len(node), step):
            rows = slice(lo, lo + step)
            odd = np.zeros((len(node[rows]), len(node)), np.int32)
            for w in range(sketch.shape[1]):
                odd += np.bitwise_count(sketch[rows, w][:, None] ^ sketch[:, w][None])
            both = samples[rows][:, None] + samples[None]
            most = allowed(percent, n[rows][:, None], n[None], samples[rows][:, None], samples[None], NUMPY)
            left = np.maximum(1 - 2 * odd / BITS, 1 / BITS)
            apart = -BITS / 2 * np.log(left)
            error = DEVIATIONS * np.sqrt(np.maximum(BITS / 4 * (1 - left**2) - apart * left**2, 0)) / left
            small, large = np.minimum(n[rows][:, None], n[None]), np.maximum(n[rows][:, None], n[None])
            # A sketch's bits never differ at more places than the samples it folds.
            ok = (odd <= most) & (apart - error <= most) & (comp[rows][:, None] != comp[None]) & (100 * small >= percent * large)
            score = 1 - apart / both
            if best:
                i = np.flatnonzero(ok.any(1))
                j = np.where(ok, score, -9)[i].argmax(1)
            else:
                i, j = np.nonzero(ok)
            i = i + lo
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def runs(final: bool) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            last = len(cuts) - 1 if final else len(cuts) - 2
            cols = [table.column(c).to_numpy() for c in (1, 2, 3, 4)]
            flat = table.column(5).combine_chunks().flatten().to_numpy().reshape(len(key), BITS // 64).view(U64)
            found = [p for s, e in zip(cuts[:last], cuts[1 : last + 1], strict=True) for p in pairs(*(c[s:e] for c in cols), flat[s:e])]
            held[:] = [] if final else table.slice(cuts[last]).to_batches()
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(a):
                    ab = np.unique(np.stack([a, b], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], schema=schema)

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                yield from runs(False)
                rows = sum(b.num_rows for b in held)
        yield from runs(True)

    return cross


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' full shingle sets reach the similarity."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    words = ends.select(slot("id").alias("h")).groupBy(F.expr("h div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h % 64))")).alias("bits"))
    texts = docs.withColumn("h", slot("doc_id")).join(F.broadcast(words), F.expr("h div 64 = w"))
    texts = texts.where("(shiftrightunsigned(bits, int(h % 64)) & 1L) = 1L").select("doc_id", "text")
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(confirmer(k, percent), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes with links (a, b): the least node reachable, by minimum labels and pointer jumping."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b"), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        least = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        new = least.join(jump, "to").select("node", "component", F.least("to", "jump").alias("new"))
        old, new = labels, stored(new, "labels")
        discard(old)
        labels = new.select("node", F.col("new").alias("component"))
        if new.where("new != component").isEmpty():
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Two documents are linked where their sets of ``k``-word shingles have 100 * intersection >= percent * union.
    component_id is the least doc_id reachable by links, and the document that has it is kept. An empty set
    is linked with nothing. Rows that share a doc_id are one document. Null ids: linked with nothing,
    component_id null, kept.

    One representative stands for all documents of equal sets. Representatives meet in MinHash bands; a pair of
    just the least similarity shares none with the chance MISS. MinHash samples are folded into odd sketches,
    and the XOR of two estimates how many samples differ; a pair whose estimate is more than DEVIATIONS standard
    deviations of both sampling and estimate too large is not confirmed. The members of a band are first tried
    with two leaders of it; then all pairs of a band that leaders left in different components are estimated,
    in blocks of rows, first each member's best, then all that remain. Every link is confirmed on full sets. No
    bucket's pairs are all emitted, none is cut; what is estimated grows with the square of those members of
    a band that no leader joined. Very long texts are one set each; an empty table gives no rows; other
    columns don't matter.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(docs.mapInArrow(signer(k, n_bands(percent)), SIGNATURE), "signatures")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    copies = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    copies = stored(copies, "copies")
    first = usable.dropDuplicates(["doc_id", "s1", "s2"]).join(copies, ["s1", "s2"]).where("doc_id = node")
    nodes = stored(first.select("node", "copies", "n_shingles", "n_samples", "bands", "sketch"), "nodes")

    members = nodes.select("node", "copies", "n_shingles", F.explode("bands").alias("key"))
    leader = F.struct("node", "n_shingles")
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.max_by(leader, F.struct("copies", -F.col("node"))).alias("l1"), F.min_by(leader, F.struct(F.xxhash64("key", "node"), "node")).alias("l2")
    )
    buckets = stored(buckets.where("m > 1"), "buckets")
    met = members.join(buckets, "key").select("node", "n_shingles", F.explode(F.array("l1", "l2")).alias("l"))
    alike = F.least("n_shingles", "l.n_shingles") * 100 >= F.greatest("n_shingles", "l.n_shingles") * percent
    led = met.where((F.col("node") != F.col("l.node")) & alike).select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()
    sides = nodes.select("node", "n_samples", "sketch")
    sized = nodes.select("node", "n_shingles", "n_samples", "sketch")
    led = led.join(sized.toDF("a", "xa", "na", "sa"), "a").join(sized.toDF("b", "xb", "nb", "sb"), "b")
    tried = stored(led.where(alike_sketches(percent)).select("a", "b"), "tried")
    same_id = copies.groupBy("node").count().where("count > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    links = stored(confirmed(docs, tried, k, percent).unionByName(same_id), "confirmed")

    for best in (True, False):
        labels = components(links)
        others = members.join(buckets, "key").where("node != l1.node and node != l2.node").select("key", "m", "node", "n_shingles")
        others = others.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = others.groupBy("key").agg(F.count(F.lit(1)).alias("left"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        mixed = mixed.where("lo < hi").select("key", F.expr(f"int((left + {BLOCK - 1}) div {BLOCK})").alias("n_blocks"))
        others = others.join(mixed, "key").withColumn("block", F.expr("int(pmod(xxhash64(node, 3), n_blocks))"))
        others = others.withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
        task = F.when(F.col("n_blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        rows = others.select(task.alias("key"), "node", "component", "n_shingles").join(sides, "node")
        rows = rows.select("key", "node", "component", "n_shingles", "n_samples", "sketch").repartition("key").sortWithinPartitions("key")
        found = rows.mapInArrow(crosser(percent, best), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        found = stored(found, "found")
        if found.isEmpty():
            continue
        tried = tried.unionByName(found)
        fewer, links = links, stored(links.unionByName(confirmed(docs, found, k, percent)), "confirmed")
        discard(fewer, labels)
    labels = components(links)
    discard(nodes, buckets, tried, links)

    of = copies.join(labels, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(of, ["s1", "s2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.select("doc_id", "n_shingles", F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def alike_sketches(percent: int) -> Column:
    """Whether the sketches (sizes xa and xb, samples na and nb, bits sa and sb) allow the similarity; as in ``crosser``."""
    odd = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = allowed(percent, *map(F.col, ("xa", "xb", "na", "nb")), COLUMNS)
    left = F.greatest(1 - 2 * odd / BITS, F.lit(1 / BITS))
    apart = -BITS / 2 * F.log(left)
    error = DEVIATIONS * F.sqrt(F.greatest(BITS / 4 * (1 - left * left) - apart * left * left, F.lit(0.0))) / left
    return (odd <= most) & (apart - error <= most)
