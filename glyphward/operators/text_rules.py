"""Rules over text: invisible, private-use and direction-changing characters; phrases that substitutions change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from glyphward.functions import text as T, unicode as U
from glyphward.schema import DEFAULTS, Thresholds

from .findings import counted_findings


def hygiene(units: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """UNICODE.* of (doc_id, text).  Texts without any such character are passed over by one search."""
    some = units.filter(F.col("text").rlike(U.ANY))
    counts = some.select("doc_id", *[U.count_class(F.col("text"), p).alias(n) for n, p in (("pua", U.PUA), ("zero", U.ZERO_WIDTH), ("bidi", U.BIDI))])
    return counted_findings(
        counts,
        [
            ("UNICODE.PUA", F.col("pua"), t.pua_chars, None),
            ("UNICODE.ZERO_WIDTH", F.col("zero"), 1, None),
            ("UNICODE.BIDI_OVERRIDE", F.col("bidi"), 1, None),
        ],
    )


def sentence_table(units: DataFrame) -> DataFrame:
    """doc_id, sentence_ord (from 0), sentence."""
    return units.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_ord", "sentence"))


def phrases(units: DataFrame, presumed: Column, t: Thresholds = DEFAULTS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first ``t.phrases`` sentences of a document that the substitution changes.  ``presumed`` is over ``sentence``."""
    table = units.select(*[c for c in units.columns if c != "text"], F.posexplode(T.sentences(F.col("text"))).alias("sentence_ord", "sentence"))
    changed = table.withColumn("presumed", presumed).filter("presumed <> sentence")
    line = W.partitionBy(*keys).orderBy("sentence_ord")
    return changed.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= t.phrases).select(*keys, "sentence_ord", F.col("sentence").alias("extracted"), "presumed")
