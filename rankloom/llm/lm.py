"""A bigram language model by deleted interpolation, counted and applied without a row per token."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, discard, stored
from rankloom.llm.textvec import U64, blocks, mix, text_bytes, word_hashes

#: One training document of DELETED is held out from the counts that mixture weights are learned with.
DELETED = 10
#: Context-frequency buckets: 0 for contexts never seen, then powers of two.
BUCKETS = 48
#: The hash that stands for the end of a text.
END = U64(0x123456789ABCDEF)
#: Tokens of a block, whose words and bigrams are counted and asked for together, and bytes of text for each group of counts.
BLOCK, GROUP_BYTES = 1_250_000, 16 << 20
#: Expectation-maximisation ends when no weight moves by more than this, or after so many rounds.
MOVES, ROUNDS = 1e-4, 60


def pack(a: np.ndarray) -> bytes:
    """An array's bytes by their significance, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(b: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1).T.tobytes(), kind)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(b, kind), dtype=kind)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts with END after each text, and the number of tokens of each text."""
    parts = [word_hashes(data, off[i : j + 1]) for i, j in blocks(off)]
    t = np.concatenate([np.insert(words, woff[1:], END) for words, woff in parts])
    return t, np.concatenate([np.diff(woff) + 1 for _, woff in parts])


def contexts(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each token; a text follows an end."""
    before = np.concatenate([[END], t[:-1]])
    before[np.cumsum(n) - n] = END
    return before


def pair_keys(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bigrams that end at each token."""
    return mix(contexts(t, n) * U64(0x9E3779B97F4A7C15) + t)


def by_group(keys: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """The groups of some keys, and where the keys of each are, in order."""
    group = (mix(keys) % U64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, order[cuts[p] : cuts[p + 1]]


def block_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    """(fold, held_out, id, text) -> blocks of rows of BLOCK tokens or of one longer text: number, the other columns, tokens, tokens of each row.

    Deleted rows (fold 2) are in blocks of their own, with odd numbers. Where blocks end depends on the rows
    of their kind and on nothing else, so a second pass over some of the kinds gives the same blocks.
    """
    base = TaskContext.get().partitionId() << 32
    held: dict[int, list] = {0: [], 1: []}
    size, number = [0, 0], [0, 0]

    def flush(kind: int) -> tuple[int, pa.Table, np.ndarray, np.ndarray]:
        rows, t, n = zip(*held[kind], strict=True)
        held[kind], size[kind], number[kind] = [], 0, number[kind] + 1
        return base | (2 * (number[kind] - 1) + kind), pa.concat_tables(rows), np.concatenate(t), np.concatenate(n)

    for batch in batches:
        odd = batch.column(0).to_numpy() == 2
        for kind in (0, 1):
            part = pa.Table.from_batches([batch]).filter(pa.array(odd if kind else ~odd))
            if not part.num_rows:
                continue
            rest = part.select([0, 1, 2])
            data, off = text_bytes(part.column(3))
            t, n = tokens(data, off)
            ends = np.cumsum(n)
            i = 0
            while i < len(n):
                before = int(ends[i - 1]) if i else 0
                j = max(i + (0 if size[kind] else 1), int(np.searchsorted(ends, before + BLOCK - size[kind], "right")))
                if j > i:
                    held[kind].append((rest.slice(i, j - i), t[before : ends[j - 1]], n[i:j]))
                    size[kind] += int(ends[j - 1]) - before
                if j < len(n):
                    yield flush(kind)
                i = j
    for kind in (0, 1):
        if held[kind]:
            yield flush(kind)


#: Of a block: its distinct words (even groups) or bigrams (odd groups) of one group, and how often its training rows, kept and deleted, have them.
REQUESTS = pa.schema([("g", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("kept", pa.binary()), ("deleted", pa.binary())])
REQUESTS_SQL = "g int, block long, keys binary, kept binary, deleted binary"


def requester(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(fold, held_out, id, text) -> REQUESTS."""

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, t, n in block_texts(batches):
            fold = np.repeat(rows.column(0).to_numpy(), n)
            for kind, every in enumerate((t, pair_keys(t, n))):
                keys, nth = np.unique(every, return_inverse=True)
                kept, deleted = (np.bincount(nth[fold == f], minlength=len(keys)).astype(np.uint32) for f in (1, 2))
                parts = [{"g": 2 * p + kind, "block": block, "keys": pack_sorted(keys[at]), "kept": pack(kept[at]), "deleted": pack(deleted[at])} for p, at in by_group(keys, groups)]
                yield pa.RecordBatch.from_pylist(parts, REQUESTS)

    return request


#: Of a block: a hash of the words or bigrams it asked a group for, and their corpus counts in the order asked. Of a group of words
#: (block -1): its distinct training words, and its kept and deleted training tokens.
ANSWERS = pa.schema([("g", pa.int32()), ("block", pa.int64()), ("asked", pa.int64()), ("kept", pa.binary()), ("deleted", pa.binary()), ("distinct", pa.int64()), ("n_kept", pa.int64()), ("n_deleted", pa.int64())])
ANSWERS_SQL = "g int, block long, asked long, kept binary, deleted binary, distinct long, n_kept long, n_deleted long"


def digest(keys: np.ndarray) -> int:
    """A 63-bit hash of some keys in their order."""
    return int((mix(keys) * (U64(2) * np.arange(len(keys), dtype=U64) + U64(1))).sum(dtype=U64) >> U64(1))


def answer(table: pa.Table) -> pa.Table:
    """REQUESTS of a group -> ANSWERS."""
    asked, kept, deleted = [], [], []
    for r in table.select(["keys", "kept", "deleted"]).to_pylist():
        asked.append(unpack_sorted(r["keys"], np.uint64))
        kept.append(unpack(r["kept"], np.uint32))
        deleted.append(unpack(r["deleted"], np.uint32))
    cuts = np.cumsum([0, *map(len, asked)])
    keys, nth = np.unique(np.concatenate(asked), return_inverse=True)
    # Sums of whole numbers in doubles are exact below 2^53.
    k, d = (np.bincount(nth, np.concatenate(x), len(keys)).astype(np.int64) for x in (kept, deleted))
    g = table.column("g")[0].as_py()
    rows = []
    for block, s, e in zip(table.column("block").to_pylist(), cuts[:-1], cuts[1:], strict=True):
        rows.append({"g": g, "block": block, "asked": digest(keys[nth[s:e]]), "kept": pack(k[nth[s:e]]), "deleted": pack(d[nth[s:e]])})
    if g % 2 == 0:
        rows.append({"g": g, "block": -1, "distinct": int((k + d > 0).sum()), "n_kept": int(k.sum()), "n_deleted": int(d.sum())})
    return pa.Table.from_pylist(rows, ANSWERS)


#: Of a block: its rows, its distinct words and its tokens as numbers of them.
BLOCKS = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("tokens", pa.binary()), ("id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64()))])
BLOCKS_SQL = "block long, keys binary, tokens binary, id array<long>, held_out array<boolean>, n_tokens array<long>"


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, held_out, id, text) -> BLOCKS."""
    for block, rows, t, n in block_texts(batches):
        words, nth = np.unique(t, return_inverse=True)
        row = {"block": block, "keys": pack_sorted(words), "tokens": pack(nth.astype(np.uint32)), "id": rows.column(2).to_pylist(), "held_out": rows.column(1).to_pylist(), "n_tokens": n.tolist()}
        yield pa.RecordBatch.from_pylist([row], BLOCKS)


def counted(rows: pa.Table, answers: pa.Table, groups: int, columns: list[str]) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """BLOCKS and ANSWERS of a block -> its row, and of each token the count of the token, of the one before and of the
    bigram, summed over ``columns``."""
    (row,) = rows.to_pylist()
    by_g = {r["g"]: (r["asked"], sum(unpack(r[c], np.int64) for c in columns)) for r in answers.select(["g", "asked", *columns]).to_pylist()}

    def counts_of(keys: np.ndarray, kind: int) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for p, at in by_group(keys, groups):
            asked, found = by_g.get(2 * p + kind, (None, ()))
            if len(found) != len(at) or asked != digest(keys[at]):
                raise RuntimeError("The texts came in another order when read again; store them first.")
            out[at] = found
        return out

    words, nth, n = unpack_sorted(row["keys"], np.uint64), unpack(row["tokens"], np.uint32), np.array(row["n_tokens"])
    of_words = counts_of(words, 0)
    pairs, which = np.unique(pair_keys(words[nth], n), return_inverse=True)
    # The end stands before the first token of a text, and each text has one.
    before = np.concatenate([[0], of_words[nth[:-1]]])
    before[np.cumsum(n) - n] = of_words[np.searchsorted(words, END)]
    return row, of_words[nth], before, counts_of(pairs, 1)[which]


def bucket_of(context_count: np.ndarray) -> np.ndarray:
    """0 for 0, 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.where(context_count > 0, np.minimum(np.floor(np.log2(np.maximum(context_count, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def probability(weights: np.ndarray, pair: np.ndarray, before: np.ndarray, count: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """Of each token, given the one before: relative frequencies of the bigram and of the token, and one over all words, mixed by the context's bucket.

    The probabilities of all training words and of one for all other words are 1 together.
    """
    w = weights[bucket_of(before)]
    return w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * count / max(total, 1) + w[:, 2] / (distinct + 1)


def tallier(groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Blocks of deleted rows -> (before, pair, count, n): their tokens by the kept counts of context, bigram and token."""

    def tally(rows: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = np.zeros((0, 3), np.int64)
        n = np.zeros(0, np.int64)
        if rows.num_rows:
            _, count, before, pair = counted(rows, answers, groups, ["kept"])
            kinds, n = np.unique(np.stack([before, pair, count], 1), axis=0, return_counts=True)
        return pa.table([*(pa.array(kinds[:, c]) for c in range(3)), pa.array(n)], names=["before", "pair", "count", "n"])

    return tally


def learn_weights(tallies: DataFrame, total: int, distinct: int) -> np.ndarray:
    """The weights of bigram, token and uniform probability by bucket (BUCKETS x 3) that make the deleted rows likeliest.

    Expectation-maximisation over the counts themselves: in each round one aggregation sums, by bucket, what
    share of each token every part explains. A context never seen has no bigrams. Buckets without deleted tokens
    take the weights of all buckets together.
    """
    bucket = F.when(F.col("before") > 0, F.least(F.floor(F.log2("before")) + 1, F.lit(BUCKETS - 1))).otherwise(0).cast("int")
    parts = [F.col("pair") / F.greatest("before", F.lit(1)), F.col("count") / max(total, 1), F.lit(1 / (distinct + 1))]
    rows = stored(tallies.groupBy("before", "pair", "count").agg(F.sum("n").alias("n")).select(bucket.alias("bucket"), "n", *(p.alias(f"p{i}") for i, p in enumerate(parts))), "tallies")
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(ROUNDS):
        shares = [F.get(F.array(*map(F.lit, weights[:, i].tolist())), F.col("bucket")) * F.col(f"p{i}") for i in range(3)]
        summed = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * s / sum(shares[1:], shares[0])).alias(f"s{i}") for i, s in enumerate(shares))).collect()
        if not summed:
            break
        new = np.tile(np.array([sum(r[f"s{i}"] for r in summed) for i in range(3)]) / sum(r["n"] for r in summed), (BUCKETS, 1))
        new[0] = (0, new[0, 1] / max(new[0, 1:].sum(), 1e-300), new[0, 2] / max(new[0, 1:].sum(), 1e-300))
        for r in summed:
            new[r["bucket"]] = [r[f"s{i}"] / r["n"] for i in range(3)]
        # No part's weight falls to 0, where a token it alone explains would be impossible.
        new[1:] = np.maximum(new[1:], 1e-9)
        new[0, 1:] = np.maximum(new[0, 1:], 1e-9)
        new /= new.sum(1, keepdims=True)
        moved, weights = np.abs(new - weights).max(), new
        if moved < MOVES:
            break
    discard(rows)
    return weights


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scorer(groups: int, weights: np.ndarray, total: int, distinct: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block and its answers -> a row for each of its documents."""

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return SCORES.empty_table()
        row, count, before, pair = counted(rows, answers, groups, ["kept", "deleted"])
        n = np.array(row["n_tokens"])
        doc = np.repeat(np.arange(len(n)), n)
        log = np.log10(probability(weights, pair, before, count, total, distinct))
        add = lambda x: np.bincount(doc, x, len(n))
        base = add(np.log10(count + 1.0)) - n * np.log10(total + distinct + 1.0)
        return pa.table([pa.array(row["id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(n), pa.array(add(count > 0).astype(np.int64)), pa.array(base), pa.array(add(log))], schema=SCORES)

    return score


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """Scores of all documents (doc_id, held_out, n_tokens, n_known, base_score, score), and the model's figures.

    Tokens are words with A-Z lower-cased and an end after each text. The probability of a token mixes the
    relative frequencies of its bigram and of itself and the uniform probability, with weights by the bucket of
    the context's frequency. The weights are learned by expectation-maximisation on the counts of the documents
    held out from training counts (one of DELETED by hash of id and text); the final relative frequencies use all
    training documents. Words of no training text share one place beside the training words. base_score is
    add-one unigram.

    Texts are read in blocks. A block sends its distinct words and bigrams with its own counts to hashed groups,
    which add up the counts of all blocks and send each block back what it asked for, so a frequent word or
    bigram is one entry a block, no table of words is broadcast, and groups grow in number with the bytes of
    text. Words and bigrams are told apart by 64-bit hashes. The blocks are made a second time from the texts,
    rather than stored, to meet the answers; rows that come in another order then are an error (files don't), which
    a hash of what each block asked for tells, whatever the texts' lengths.

    Null texts are empty (one token, the end), as are all texts of white space. Null ids are kept. Rows are kept
    apart, repeated ids too. An empty table gives no rows; without training documents all tokens are unknown.
    Other columns don't matter.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.select(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    groups = max(8, -(-size // GROUP_BYTES))
    deleted = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("deleted")), F.lit(DELETED)) == 0
    fold = F.when(~training, 0).when(deleted, 2).otherwise(1).cast("int")
    texts = docs.select(fold.alias("fold"), (~training).alias("held_out"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    requests = texts.mapInArrow(requester(groups), REQUESTS_SQL).repartition(groups, "g")
    answers = stored(requests.groupBy("g").applyInArrow(answer, ANSWERS_SQL), "answers")
    figures = answers.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "n_kept", "n_deleted"))).first()
    distinct, total = figures["distinct"], figures["n_kept"] + figures["n_deleted"]

    def with_answers(some: DataFrame, blocks_: DataFrame, parts: int):
        rows = some.mapInArrow(block_rows, BLOCKS_SQL).repartition(parts, "block")
        return rows.groupBy("block").cogroup(blocks_.select("g", "block", "asked", "kept", "deleted").repartition(parts, "block").groupBy("block"))

    odd = with_answers(texts.where("fold = 2"), answers.where("block % 2 = 1"), max(8, groups // DELETED))
    weights = learn_weights(odd.applyInArrow(tallier(groups), "before long, pair long, count long, n long"), figures["n_kept"], distinct)
    every = with_answers(texts, answers.where("block >= 0"), groups)
    scores = every.applyInArrow(scorer(groups, weights, total, distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scores, {"train_tokens": total, "distinct": distinct, "kept_tokens": figures["n_kept"], "weights": weights.tolist()}
