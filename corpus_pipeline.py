"""A corpus pipeline: drops toxic documents and those without a language, keeps one of each group of near copies, cuts repeated passages, and packs what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes every stage's rows and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import crf_langid, packing, simhash, substring, toxicity
from twinfold.llm.common import written
from twinfold.llm.queries import vocabulary


#: Ids of copies up to which they are broadcast; they are joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Mean posterior of its language below which a document is rejected.
LEAST_LANGUAGE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose score says label 1 (0.5 or more); null and empty texts are judged like any other."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(spark, model)(F.col("text")) < 0.5)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no language (``und``: null texts and those without a letter) and those of which no language holds LEAST_LANGUAGE of the words (mean posterior)."""
    found = crf_langid.scored_language_column(spark, crf_langid.fit(docs))(F.col("text"))
    return docs.where(F.when(found["lang"] != "und", found["score"]).otherwise(-1.0) >= LEAST_LANGUAGE)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more); of rows that share that id, all stay."""
    gone, _ = written(simhash.near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words cut from text; n_chars follows."""
    cut = substring.without_repeats(docs)
    return cut.select([F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in cut.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_copies", keep_one_of_copies), ("repeats", cut_repeats), ("packing", pack)]
ORACLE_SQL = None  # trained models, hashing and a tokenizer: held against brute force in the tests


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
