"""A corpus pipeline of five of the operators, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import WHITE, stored
from rankloom.llm.bpe import encode
from rankloom.llm.decontam import find_contamination
from rankloom.llm.langid import identify, learn
from rankloom.llm.line_dedup import apply_bitmaps, keep_bitmaps
from rankloom.llm.neardup import near_duplicates
from rankloom.llm.queries import fold, word_tokenizer


def whole_rows(docs: DataFrame) -> DataFrame:
    """All columns as one, whatever their names, beside the text to be scanned."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text").alias("__scanned"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, with the predicted one as their ``lang``; texts that are null or without a letter go.

    The languages are learned from labelled documents of three of four folds. Without any, no document has a
    language. Repeated rows are kept, other columns stay as they are, an empty table stays empty.
    """
    samples = learn(docs.where(fold(4) != 2))
    found = identify(whole_rows(docs), samples, text_col="__scanned").where(F.col("lang_pred") != "und")
    return found.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col("__row").getField(c).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first only; n_chars follows the text.

    Documents that lost lines and have none but blank ones left go, so ten or more copies leave one row.
    Documents that lost nothing stay, without words too. Null texts stay null; rows that agree in id and text are one
    document and keep or lose their lines together; an empty table stays empty.
    """
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, keep_first=True))
    emptied = (F.col("__n_dropped") > 0) & (F.btrim("__kept_text", F.lit(WHITE)) == "")
    out = out.where(~emptied).withColumn("text", F.col("__kept_text")).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The least doc_id stays. Null and empty texts and null ids have no duplicates and stay; rows of one id stay or go
    together; an empty table stays empty.
    """
    gone = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than 5 % lie in passages of benchmark items. Null and empty texts and repeated rows stay; an empty table stays empty."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(whole_rows(docs), items, text_col="__scanned", keep=["__row"])
    return found.where("not contaminated").select("__row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text; a null text is empty. Repeated rows are kept."""
    return encode(docs.select("doc_id", "lang", "source", "text"), word_tokenizer(), digests=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: SQL can express neither the language model of the first stage nor the encoding of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each over what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
