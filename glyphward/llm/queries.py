"""The ten operators applied to their whole tables with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import cap_filters, html_extract, jaccard_join, language_id, lm_score, media, sentencepiece_codec, source_mix, substring_dedup, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.build(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.intervals(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy_no")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(media.rendered_pages(_table(spark, sf_dir, "pages")), "page_id", "jpeg")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.similar(_table(spark, sf_dir, "embeddings"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_events", *[F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "ce_diff")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (op1_language_id, op2_token_store, op3_substring_dedup, op4_jaccard_join, op5_source_mix)
    ours += (op6_html_extract, op7_media, op8_sentencepiece, op9_embedding_dedup, op10_lm_score)
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": substring_dedup.oracle(),
        "op4_jaccard_join": jaccard_join.oracle(),
        "op5_source_mix": source_mix.oracle(),
        "op9_embedding_dedup": cap_filters.oracle(),
        "op10_lm_score": lm_score.oracle(),
    }
