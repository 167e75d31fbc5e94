"""Rules over text runs of word-processor documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphward.functions import colour as C
from glyphward.schema import DEFAULTS, Thresholds

from .findings import counted_findings


def run_findings(runs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """DOCX.INVISIBLE_TEXT_COLOR, DOCX.TINY_TEXT and DOCX.HIDDEN_VANISH of runs (doc_id, run_ord, text, color, sz, highlight,
    shd_fill, n_vanish).  Characters that are no white space count; ``sample`` is the first such run's text."""
    chars = F.length(F.regexp_replace("text", r"(?U)\s", ""))
    white = C.is_near_white(F.col("color"), t.near_white_luma) & ~C.run_background_shows(F.col("highlight"), F.col("shd_fill")) & (chars > 0)
    tiny = (F.col("sz") > 0) & (F.col("sz") < t.tiny_half_points) & (chars > 0)
    per = runs.groupBy("doc_id").agg(
        F.sum(F.when(white, chars).otherwise(0)).alias("white"),
        F.min_by("text", F.when(white, F.col("run_ord"))).alias("white_text"),
        F.sum(F.when(tiny, chars).otherwise(0)).alias("tiny"),
        F.min_by("text", F.when(tiny, F.col("run_ord"))).alias("tiny_text"),
        F.sum("n_vanish").alias("vanish"),
    )
    return counted_findings(
        per,
        [
            ("DOCX.INVISIBLE_TEXT_COLOR", F.col("white"), t.hidden_chars, F.substring("white_text", 1, 80)),
            ("DOCX.TINY_TEXT", F.col("tiny"), t.hidden_chars, F.substring("tiny_text", 1, 80)),
            ("DOCX.HIDDEN_VANISH", F.col("vanish"), 1, None),
        ],
    )


def body_text(runs: DataFrame) -> DataFrame:
    """doc_id, text: runs in order, a line per paragraph."""
    lines = runs.groupBy("doc_id", "para_ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ord", "text"))), lambda r: r["text"]), "").alias("line")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_ord", "line"))), lambda r: r["line"]), "\n")
    return lines.groupBy("doc_id").agg(joined.alias("text"))


def embedded_faces(font_table: DataFrame, rels: DataFrame) -> DataFrame:
    """font_table (doc_id, rid, family, slot, key) with the part each relationship names (doc_id, rid, target)."""
    path = F.regexp_replace("target", "^/", "")
    return font_table.join(rels, ["doc_id", "rid"]).withColumn("part", F.when(path.startswith("word/"), path).otherwise(F.concat(F.lit("word/"), path))).drop("target")
