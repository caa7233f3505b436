"""Phrases of two and three words that occur together more than their parts would suggest, counted by stripes."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, stored

#: Words that a task counts before it sends its stripes.
CHUNK = 1_000_000
#: A word that is one of this many words or more has its stripe cut into parts of about that share.
HOT = 1000
#: Punctuation and line ends part pieces; a byte that no UTF-8 text has marks them.
MARK = b"\xff"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + MARK * 10)


class Chunk:
    """Words of some texts by language, as numbers; 0 ends a piece."""

    def __init__(self):
        self.words: dict[bytes, int] = {MARK: 0}
        self.numbers: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        words = text.translate(FOLD).replace(MARK, b" \xff ").split()
        known = self.words
        numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        self.numbers.setdefault(lang, []).append(np.append(numbers, 0))
        self.size += len(words) + 1

    def languages(self) -> Iterator[tuple[str, np.ndarray]]:
        for lang, parts in self.numbers.items():
            yield lang, np.concatenate(parts)

    def vocabulary(self) -> list[bytes]:
        return [b"", *list(self.words)[1:]]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """The texts of a task, about CHUNK words at a time; a longer text is a chunk of its own."""
    chunk = Chunk()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            if text:
                chunk.add(lang, text)
            if chunk.size >= CHUNK:
                yield chunk
                chunk = Chunk()
    if chunk.size:
        yield chunk


def frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the words with half of a hot word's share or more, and (no word) how many words it has.

    Half the occurrences of a hot word, at least, lie in such chunks.
    """
    for chunk in chunks(batches):
        n = np.bincount(np.concatenate([x for _, x in chunk.languages()]), minlength=len(chunk.words))[1:]
        many = np.flatnonzero(n * 2 * HOT >= n.sum())
        words = list(chunk.words)[1:]
        yield pa.RecordBatch.from_arrays([pa.array([None, *(words[i].decode() for i in many)]), pa.array([n.sum(), *n[many]])], ["word", "n"])


def parts_of(hot: dict[str, int]):
    """A task's stripes. A stripe belongs to a first word: for each pair of the words that follow it, how often they do.

    A piece that ends gives empty words, so that all counts of a stripe sum to those of its word, and all with one second word to
    those of the pair. Entries are ``second third``, joined by commas, which no word has. Stripes of hot words are cut by
    a hash of the entry.
    """
    shares = {w.encode(): n for w, n in hot.items()}

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = chunk.vocabulary()
            v, parts, hashes = len(words), np.array([shares.get(w, 1) for w in words]), np.array([crc32(w) for w in words], np.int64)
            vocabulary = pa.array(words, pa.binary()).cast(pa.string())
            for lang, numbers in chunk.languages():
                at = np.flatnonzero(numbers)
                second = numbers[at + 1]
                third = np.where(second > 0, numbers[np.minimum(at + 2, len(numbers) - 1)], 0)
                pairs, pair = np.unique(numbers[at] * v + second, return_inverse=True)
                entries, n = np.unique(pair * v + third, return_counts=True)
                pair, third = entries // v, entries % v
                first, second = pairs[pair] // v, pairs[pair] % v
                part = (hashes[second] * 31 + hashes[third]) % parts[first]
                order = np.lexsort((part, first))
                first, second, third, part, n = (x[order] for x in (first, second, third, part, n.astype("<u4")))
                begins = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (part[1:] != part[:-1])])) if len(first) else np.zeros(0, np.int64)
                ends = np.append(begins[1:], len(first))
                # Portions keep a batch small.
                for low in range(0, len(begins), 2000):
                    b, e = begins[low : low + 2000], ends[low : low + 2000]
                    inside, offsets = slice(b[0], e[-1]), np.append(b, e[-1]) - b[0]
                    texts = pc.binary_join_element_wise(vocabulary.take(pa.array(second[inside])), vocabulary.take(pa.array(third[inside])), " ")
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts)
                    counts = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((offsets * 4).astype("<i4").tobytes()), pa.py_buffer(n[inside].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b)), vocabulary.take(pa.array(first[b])), pa.array(part[b].astype(np.int32)), pc.binary_join(lists, ","), counts], ["lang", "word", "part", "entries", "counts"])

    return stripes


KEY = ["lang", "word", "part"]


def merger(least: int, hot: set[str]):
    """Adds up stripes of one key, which follow each other, element by element; at most one key's elements are kept from batch to batch.

    From a merged stripe come its word's total, the totals of its second words and its elements: (lang, a, b, c, n), with null for no
    word. Totals of pairs and elements are left out below ``least``, totals of pairs only where the stripe isn't cut.
    """
    many = pa.array(sorted(hot), pa.string())

    def merged(rows: pa.Table) -> pa.Table:
        return rows.group_by([*KEY, "entry"]).aggregate([("n", "sum")]).rename_columns([*KEY, "entry", "n"])

    def counts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        both = pc.split_pattern(rows.column("entry").combine_chunks(), " ", max_splits=1)
        rows = rows.append_column("b", pc.list_element(both, 0)).append_column("c", pc.list_element(both, 1))
        none = lambda n: pa.nulls(n, pa.string())
        words = rows.group_by(["lang", "word"]).aggregate([("n", "sum")])
        pairs = rows.filter(pc.not_equal(rows.column("b"), "")).group_by(["lang", "word", "b"]).aggregate([("n", "sum")])
        pairs = pairs.filter(pc.or_(pc.greater_equal(pairs.column("n_sum"), least), pc.is_in(pairs.column("word"), many)))
        triples = rows.filter(pc.and_(pc.not_equal(rows.column("c"), ""), pc.greater_equal(rows.column("n"), least)))
        for t, b, c in ((words, None, None), (pairs, "b", None), (triples, "b", "c")):
            n = t.column("n" if c else "n_sum")
            out = pa.table([t.column("lang"), t.column("word"), t.column(b) if b else none(len(t)), t.column(c) if c else none(len(t)), n], ["lang", "a", "b", "c", "n"])
            yield from out.to_batches(max_chunksize=20_000)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            entries = pc.split_pattern(batch.column("entries"), ",")
            at = pc.list_parent_indices(entries)
            n = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4").astype(np.int64)
            rows = pa.table([*(batch.column(k).take(at) for k in KEY), pc.list_flatten(entries), pa.array(n)], [*KEY, "entry", "n"])
            held = merged(rows if held is None else pa.concat_tables([held, rows]))
            last = [batch.column(k)[batch.num_rows - 1] for k in KEY]
            own = pc.and_(pc.and_(pc.equal(held.column("lang"), last[0]), pc.equal(held.column("word"), last[1])), pc.equal(held.column("part"), last[2]))
            yield from counts(held.filter(pc.invert(own)))
            held = held.filter(own)
        if held is not None:
            yield from counts(held)

    return merge


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, a, b, c, n: how often words (b and c null), and pairs (c null) and triples of words found ``least`` times or more, occur."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    # Only how stripes are cut depends on these counts; a word that isn't hot may be among them, up to twice as many are.
    words = {r.word: r.n for r in texts.mapInArrow(frequent_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = words.pop(None, 0)
    hot = {w: -(-n * 2 * HOT // total) for w, n in words.items() if n * 2 * HOT > total}
    stripes = texts.mapInArrow(parts_of(hot), "lang string, word string, part int, entries string, counts binary")
    together = stripes.repartition(*KEY).sortWithinPartitions(*KEY)
    found = together.mapInArrow(merger(least, set(hot)), "lang string, a string, b string, c string, n long")
    whole = found.groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n"))
    return whole.where((F.col("n") >= least) | F.col("b").isNull())


def collocations(docs: DataFrame, least: int = 10, covered_percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two and three words.

    Texts, A-Z lower-cased, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``; a phrase
    lies within a piece. A null ``lang`` is ``und``. A candidate occurs a >= ``least`` times. Cut in two parts that occur l and r times
    (all phrases of a text count, overlapping ones too) it scores floor(1000000 * a * a / (l * r)), of the cut
    where that is least, the first of equals. A candidate goes if a longer candidate, itself going or not, holds it
    and has ``covered_percent`` of its occurrences or more. n counts the language's words. Ranks go by score, then a, descending, then
    phrase. Null and empty texts have no phrases; repeated rows count each; other columns don't matter; an empty table gives no rows.

    Tasks count stripes (see ``parts_of``) over CHUNK words before anything is shuffled, and stripes are added up by word;
    words' and pairs' totals, extensions and the maxima that decide on subsumption all come from the merged stripes.
    """
    counts = stored(phrase_counts(docs, least), "phrases")
    words = counts.where("b IS NULL").select("lang", "a", "n")
    pairs = counts.where("b IS NOT NULL AND c IS NULL").select("lang", "a", "b", F.col("n").alias("f"))
    triples = counts.where("c IS NOT NULL").select("lang", "a", "b", "c", F.col("n").alias("f"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    word = lambda key, name: words.select("lang", F.col("a").alias(key), F.col("n").alias(name))
    pair = lambda x, y, name: pairs.select("lang", F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(name))
    # In decimals: counts below 10^15 give products below 10^37.
    number = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    scored = lambda l, r: F.expr(f"({number('f')} * {number('f')} * CAST(1000000 AS DECIMAL(7,0))) div ({number(l)} * {number(r)})")

    # A longer candidate holds a pair as its beginning or as its end.
    longest = triples.select("lang", "a", "b", "f").unionByName(triples.select("lang", F.col("b").alias("a"), F.col("c").alias("b"), "f"))
    longest = longest.groupBy("lang", "a", "b").agg(F.max("f").alias("longest"))
    two = pairs.join(longest, ["lang", "a", "b"], "left").where(F.coalesce(F.col("longest") * 100 < F.col("f") * covered_percent, F.lit(True)))
    two = two.join(word("a", "l"), ["lang", "a"]).join(word("b", "r"), ["lang", "b"])
    two = two.select("lang", F.concat_ws(" ", "a", "b").alias("phrase"), F.col("f").alias("a"), "l", "r", scored("l", "r").alias("score"))
    three = triples.join(word("a", "l1"), ["lang", "a"]).join(pair("b", "c", "r1"), ["lang", "b", "c"]).join(pair("a", "b", "l2"), ["lang", "a", "b"]).join(word("c", "r2"), ["lang", "c"])
    three = three.withColumn("s1", scored("l1", "r1")).withColumn("s2", scored("l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    three = three.select("lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), F.col("f").alias("a"), pick("l1", "l2", "l"), pick("r1", "r2", "r"), pick("s1", "s2", "score"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # The best of 64 parts of a language first, so no task gets the best of each task before.
    best = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", rank("part")).where(F.col("rank") <= top).withColumn("rank", rank().cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
