"""The training-corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All stages but the last return the columns of their input, whatever other ones it has. Texts of any length are read
whole, repeated rows are rows of one document, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import language_id, line_dedup, mixing, packing, simhash_dedup
from corpusmill.llm.common import Table, dropped_after

#: Some stages have no SQL: the model of language ID, the search for near duplicates and the cube method aren't relational.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language, by a model fitted on a bounded sample of the input's labelled texts.

    Null and empty texts have no language and go; rows with a null id stay. See ``language_id.keep_known``.
    """
    return language_id.keep_known(docs, language_id.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages, and drops documents of which at most blank lines are left; ``n_chars`` follows the text.

    Null and empty texts, and rows with a null id, stay as they are. See ``line_dedup.dedup_lines``.
    """
    cut = line_dedup.dedup_lines(docs)
    kept = cut.where((F.col("removed_lines") == 0) | F.rlike("text", F.lit(line_dedup.WORD)))
    chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by id, of each group of near duplicates: five-word shingles, similarity 0.8.

    Null and empty texts, and rows with a null id, stay; rows of one id stay or go together.
    """
    return simhash_dedup.drop_near_duplicates(docs, words=5, similarity=0.8)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once, or up to three times.

    Rows with a null id are kept once; a null source is a source of its own.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; null and empty texts are a piece of one end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        # What a stage wrote on its way goes as soon as its result is written.
        with dropped_after(spark) as kept:
            table = Table(stage(spark, docs, sf_dir))
            kept.add(table.path)
        docs = table.df
    return STAGES[-1][1](spark, docs, sf_dir)
