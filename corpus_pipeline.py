"""Documents to training tokens: language ID, near duplicates, repeated passages, source mix, token ids.

Rows with a null or empty text, or one without letters, have no language and go in the first stage.  A null source is a
source of its own, a null id an id like others.  Of rows that are alike, also in all columns, the second stage keeps one; rows
that share an id but have unlike texts are rows like others.  A text whose passages all repeat elsewhere becomes empty and
stays.  Columns that documents has besides (with any name that doesn't begin with two underscores) go through all stages but
the last unchanged.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphward.llm import jaccard_join, language_id, sentencepiece_codec, source_mix, substring_dedup
from glyphward.llm.common import stage_table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the classifier, fitted on a bounded sample of these rows, is sure of."""
    return language_id.keep_accepted(docs, language_id.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that similar pairs connect."""
    return jaccard_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, passages that occur more than once cut out."""
    return substring_dedup.remove(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's weight draws them."""
    if "copy_no" not in docs.columns:
        return source_mix.mix(docs).drop("copy_no")
    # a column of that name is the documents' own
    drawn = source_mix.mix(docs.withColumnRenamed("copy_no", "own_copy_no__"))
    return drawn.drop("copy_no").withColumnRenamed("own_copy_no__", "copy_no").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("source_mix", mixed),
    ("sentencepiece", token_ids),
]
#: SQL can't express the fitted classifier of the first stage or the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
