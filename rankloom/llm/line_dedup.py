"""Line deduplication by hash-range runs, with packed keep bitmaps instead of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import WHITE, ascii_lower, stored

#: Parts that a line key is split into, so that a very common line is streamed by several tasks.
SALTS = 64
#: Ranges that leading bits of hashes are cut into; a partition takes neighbouring ones.
RANGES = 1 << 16
#: Keys of more documents than HOT are joined by salted parts. Which keys these are is told by a bit filter on
#: hashes, whose table has FILTER / 64 rows at most.
HOT, FILTER = 500, 1 << 22


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed keep bitmaps of the documents that lose lines: doc_id, text_hash, n_dropped, words.

    ``words`` is an array of longs: bit i % 64 of word i / 64 is 1 where line i stays. Documents that keep
    all lines have no row. A line is dropped where its key (``line_key``) has ``min_chars`` code points or
    more and is found in ``min_docs`` documents or more; with ``keep_first`` the first occurrence, by
    document and position, stays.

    128-bit key hashes are range-partitioned with a salt from the document, so that a key with a third of all
    lines is spread over tasks, and sorted by document and position; each task streams its runs, marking the
    first line that a document adds to a run. Hashes are uniform, so their leading bits cut even ranges and no
    pass over the texts draws bounds; a salt shifts a key by its share of all ranges. The marks are summed by key
    with map-side combining. Common keys are then joined back to the lines; those of more than HOT documents are
    in SALTS parts, each met by the lines of some documents.

    Rows that agree in id and text are one document. Null texts are one empty line; null ids are one id.
    """
    doc = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    lines = doc.select("doc_id", "text_hash", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line")))
    # Lines that can't be dropped get a hash of their own place, so that they never meet in one task.
    counts = F.char_length("key") >= min_chars
    lines = lines.select(
        "doc_id",
        "text_hash",
        "pos",
        F.when(counts, F.xxhash64("key")).otherwise(F.xxhash64("text_hash", "doc_id", "pos")).alias("h1"),
        F.when(counts, F.xxhash64(F.lit(7), "key")).alias("h2"),
    )
    salted = lines.where("h2 is not null").withColumn("salt", F.pmod("text_hash", F.lit(SALTS)).cast("int"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nth = F.pmod(F.shiftrightunsigned("h1", 48) + F.col("salt") * (RANGES // SALTS), F.lit(RANGES))
    ranged = salted.withColumn("part", F.floor(nth * parts / RANGES).cast("int")).repartitionById(parts, "part")
    run = Window.partitionBy("part", "h1", "h2", "salt").orderBy("doc_id", "text_hash", "pos")
    before = F.lag(F.struct("doc_id", "text_hash")).over(run)
    marked = ranged.withColumn("fresh", before.isNull() | ~before.eqNullSafe(F.struct("doc_id", "text_hash")))
    place = F.struct("doc_id", "text_hash", "pos")
    common = (
        marked.where("fresh")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(place).alias("first"))
        .where(F.col("n_docs") >= min_docs)
    )
    common = stored(common, "common-lines")
    slot = F.pmod("h1", F.lit(FILTER))
    hot = common.where(F.col("n_docs") > HOT).select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits"))

    def flagged(df: DataFrame) -> DataFrame:
        df = df.withColumn("slot", slot).join(F.broadcast(hot), F.expr("slot div 64 = w"), "left")
        return df.withColumn("hot", F.expr("coalesce(shiftrightunsigned(bits, int(slot % 64)) & 1L, 0L) = 1L")).drop("slot", "w", "bits")

    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    common = flagged(common).withColumn("salt", F.explode(every)).drop("hot")
    lines = flagged(lines).withColumn("salt", F.when(F.col("hot"), F.pmod("text_hash", F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    decided = lines.join(common, ["h1", "h2", "salt"], "left")
    stays = F.col("n_docs").isNull()
    if keep_first:
        stays = stays | place.eqNullSafe(F.col("first"))
    bit = F.when(stays, F.expr("shiftleft(1L, pos % 64)")).otherwise(F.lit(0).cast("long"))
    words = (
        decided.select("doc_id", "text_hash", F.expr("pos div 64").alias("word"), F.expr("pos % 64 + 1").alias("nth"), bit.alias("bit"))
        .groupBy("doc_id", "text_hash", "word")
        .agg(F.bit_or("bit").alias("bits"), F.max("nth").alias("lines"))
        .withColumn("lost", F.col("lines") - F.bit_count("bits"))
    )
    packed = words.groupBy("doc_id", "text_hash").agg(
        F.sum("lost").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("packed")
    )
    return packed.where("n_dropped > 0").select("doc_id", "text_hash", "n_dropped", F.col("packed.bits").alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents and columns, with __kept_text, __n_lines and __n_dropped; a null text stays null."""
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("n_dropped").alias("__lost"), F.col("words").alias("__words"))
    docs = docs.withColumn("__text_hash", F.xxhash64(F.col(id_col), F.col(text_col)))
    on = (F.col("__text_hash") == F.col("__hash")) & F.col(id_col).eqNullSafe(F.col("__id"))
    joined = docs.join(marks.hint("shuffle_hash"), on, "left").drop("__id", "__hash", "__text_hash")
    lines = F.split(F.col(text_col), "\n")
    kept = F.expr(f"filter(split(`{text_col}`, '\\n'), (x, i) -> (shiftrightunsigned(get(__words, int(i div 64)), i % 64) & 1L) = 1L)")
    return (
        joined.withColumn("__kept_text", F.when(F.col("__words").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .withColumn("__n_lines", F.coalesce(F.size(lines), F.lit(1)).cast("long"))
        .withColumn("__n_dropped", F.coalesce(F.col("__lost"), F.lit(0)).cast("long"))
        .drop("__lost", "__words")
    )


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated lines dropped from ``text_col`` and all other columns as they were.

    A document all of whose lines are dropped keeps its row with an empty text.
    """
    marks = keep_bitmaps(docs, min_docs, keep_first, id_col=id_col, text_col=text_col)
    out = apply_bitmaps(docs, marks, id_col, text_col)
    return out.withColumn(text_col, F.col("__kept_text")).select(*docs.columns)
