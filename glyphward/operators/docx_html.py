"""A word-processor document as one page of HTML that brings its own fonts, for a renderer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphward.functions import text as T

_SLOTS = {"bold": ";font-weight:bold", "italic": ";font-style:italic", "boldItalic": ";font-weight:bold;font-style:italic"}


def font_faces(programs: DataFrame) -> DataFrame:
    """doc_id, css: a @font-face rule for each program (doc_id, font_ord, family, slot, program), in order."""
    style = F.lit("")
    for slot, css in _SLOTS.items():
        style = F.when(F.col("slot") == slot, css).otherwise(style)
    rule = F.concat(F.lit("@font-face{font-family:"), T.css_string(F.col("family")), F.lit(";src:url("), T.data_uri(F.col("program"), "font/ttf"), F.lit(")"), style, F.lit("}"))
    each = F.collect_list(F.struct("font_ord", rule.alias("rule")))
    return programs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(each), lambda x: x["rule"]), "\n").alias("css"))


def pages(runs: DataFrame, programs: DataFrame) -> DataFrame:
    """doc_id, html of runs (doc_id, para_ord, run_ord, text, family, bold, italic, color, sz) and font programs: a paragraph
    each, a span for each run with text, styled as the run is."""
    c = F.col
    style = F.concat(
        F.coalesce(F.concat(F.lit("font-family:"), T.css_string(c("family")), F.lit(";")), F.lit("")),
        F.when(c("bold"), "font-weight:bold;").otherwise(""),
        F.when(c("italic"), "font-style:italic;").otherwise(""),
        F.when(c("color").rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("color:#"), "color", F.lit(";"))).otherwise(""),
        F.when(c("sz") > 0, F.concat(F.lit("font-size:"), (c("sz") / 2).cast("decimal(9,1)").cast("string"), F.lit("pt;"))).otherwise(""),
    )
    quoted = F.replace(T.html_escape(style), F.lit('"'), F.lit("&quot;"))
    span = F.when(F.length("text") > 0, F.concat(F.lit('<span style="'), quoted, F.lit('">'), T.html_escape(c("text")), F.lit("</span>"))).otherwise("")
    spans = runs.select("doc_id", "para_ord", "run_ord", span.alias("span"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("run_ord", "span"))), lambda x: x["span"])
    lines = spans.groupBy("doc_id", "para_ord").agg(F.concat(F.lit("<p>"), F.array_join(line, ""), F.lit("</p>")).alias("p"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("para_ord", "p"))), lambda x: x["p"])
    whole = lines.groupBy("doc_id").agg(F.array_join(body, "\n").alias("body")).join(font_faces(programs), "doc_id", "left")
    head = F.concat(F.lit('<!doctype html>\n<meta charset="utf-8">\n<style>'), F.coalesce("css", F.lit("")), F.lit("</style>\n"))
    return whole.select("doc_id", F.concat(head, "body").alias("html"))
