"""Fonts and glyph mappings within a document: outlines reached from several letters, garbled maps, subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from glyphward.functions import text as T, unicode as U
from glyphward.functions.letters import latin_letter, legit_table
from glyphward.schema import DEFAULTS, FINDING_COLUMNS, Thresholds

from .findings import as_findings, finding_columns


def type0_mappings(tounicode: DataFrame, cid_gid: DataFrame, outlines: DataFrame) -> DataFrame:
    """ToUnicode (doc_id, font_ord, code, cp) through CID to GID (gid 0 is no glyph) to outlines (.., gid, outline_hash)."""
    key = ["doc_id", "font_ord"]
    found = tounicode.join(cid_gid.filter("gid <> 0").withColumnRenamed("cid", "code"), [*key, "code"]).join(outlines, [*key, "gid"])
    return found.select(*key, F.lit("tounicode").alias("source"), F.lit(0).alias("subtable_ord"), "cp", "gid", "outline_hash")


def identity_cid_gid(tounicode: DataFrame) -> DataFrame:
    return tounicode.select("doc_id", "font_ord", F.col("code").alias("cid"), F.col("code").alias("gid")).filter("cid <= 65535").distinct()


def letter_mappings(glyph_map: DataFrame) -> DataFrame:
    """doc_id, outline_hash and lower-case letter of every mapping from a Latin letter (``letter``, a character)."""
    mapped = glyph_map.filter("outline_hash is not null").withColumn("letter", latin_letter(F.col("letter")))
    return mapped.filter("letter is not null").select("doc_id", "outline_hash", "letter")


def in_document(mappings: DataFrame, letters: DataFrame) -> DataFrame:
    """Only mappings of letters that the document's text has."""
    return mappings.join(letters, ["doc_id", "letter"], "left_semi")


def collisions(mappings: DataFrame) -> DataFrame:
    """doc_id, truth, lie, n: per outline the most frequent letter is the truth (of equals the lowest), every other one that may
    not look the same is a lie."""
    n = mappings.groupBy("doc_id", "outline_hash", "letter").agg(F.count(F.lit(1)).alias("n"))
    line = W.partitionBy("doc_id", "outline_hash").orderBy(F.desc("n"), F.ascii("letter"))
    ranked = n.withColumn("truth", F.first("letter").over(line)).filter("letter <> truth")
    pairs = ranked.withColumn("a_cp", F.ascii("truth")).withColumn("b_cp", F.ascii("letter"))
    # legit pairs are a fixed table of a few thousand rows
    lies = pairs.join(F.broadcast(legit_table(mappings.sparkSession)), ["a_cp", "b_cp"], "left_anti")
    return lies.groupBy("doc_id", "truth", F.col("letter").alias("lie")).agg(F.sum("n").alias("n"))


def substitution_map(pairs: DataFrame) -> DataFrame:
    """doc_id, lie, truth: per lie the most frequent truth, of equals the lowest."""
    best = F.max(F.struct("n", (-F.ascii("truth")).alias("o"), "truth")).alias("best")
    return pairs.groupBy("doc_id", "lie").agg(best).select("doc_id", "lie", F.col("best.truth").alias("truth"))


def uniform_shift(pairs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id, shift of documents where nearly all ASCII pairs lie the same distance apart: an encoding, not a forgery."""
    ascii_pairs = pairs.filter(F.col("truth").rlike("^[a-z]$") & F.col("lie").rlike("^[a-z]$"))
    n = ascii_pairs.groupBy("doc_id", (F.ascii("truth") - F.ascii("lie")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    # of equals the smallest shift
    best = n.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("shift")).alias("o"))).alias("b"), F.sum("n").alias("total"))
    out = best.select("doc_id", (-F.col("b.o")).alias("shift"), F.col("b.n").alias("n"), "total")
    return out.filter((F.col("shift") != 0) & (F.col("n") >= t.shift_count) & (F.col("n") >= t.shift_share * F.col("total"))).select("doc_id", "shift", "n")


def replacement_findings(pairs: DataFrame, kind: str = "PDF", t: Thresholds = DEFAULTS) -> DataFrame:
    """GLYPH_SEMANTIC_REPLACEMENT per pair; of a PDF whose pairs are a uniform shift one FONT_ENCODING_ARTIFACT instead."""
    if kind != "PDF":
        return as_findings(pairs, f"{kind}.GLYPH_SEMANTIC_REPLACEMENT", F.col("n"), F.concat("lie", F.lit("→"), "truth"))
    # both rules in one pass: what uniform_shift aggregates, as windows over the pairs
    ascii_pair = F.col("truth").rlike("^[a-z]$") & F.col("lie").rlike("^[a-z]$")
    doc, by_shift = W.partitionBy("doc_id"), W.partitionBy("doc_id", "shift")
    seen = pairs.withColumn("shift", F.when(ascii_pair, F.ascii("truth") - F.ascii("lie")))
    seen = seen.withColumn("k", F.count("shift").over(by_shift)).withColumn("total", F.count("shift").over(doc))
    seen = seen.withColumn("best", F.max(F.when(F.col("shift").isNotNull(), F.struct("k", (-F.col("shift")).alias("o")))).over(doc))
    shifted = F.coalesce((F.col("best.o") != 0) & (F.col("best.k") >= t.shift_count) & (F.col("best.k") >= t.shift_share * F.col("total")), F.lit(False))
    seen = seen.withColumn("shifted", shifted).withColumn("row", F.row_number().over(doc.orderBy("truth", "lie"))).filter("not shifted or row = 1")
    lie = finding_columns("PDF.GLYPH_SEMANTIC_REPLACEMENT", F.col("n"), F.concat("lie", F.lit("→"), "truth"))
    code = finding_columns("PDF.FONT_ENCODING_ARTIFACT", F.col("best.k"), (-F.col("best.o")).cast("string"))
    return seen.select("doc_id", *[F.when(F.col("shifted"), y).otherwise(x).alias(name) for x, y, name in zip(lie, code, FINDING_COLUMNS[1:])])


def garbled_tounicode(entries: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """PDF.TOUNICODE_GARBLED of (doc_id, font_ord, base_name, dst_hex)."""
    per = entries.groupBy("doc_id", "font_ord", "base_name").agg(F.sum(U.pua_units(F.col("dst_hex"))).alias("n"))
    bad = per.filter((F.col("n") >= t.garbled) & ~T.is_math_or_symbol_font(F.col("base_name")))
    return as_findings(bad, "PDF.TOUNICODE_GARBLED", F.col("n"), None, F.concat(F.lit("font "), "base_name"))


def tounicode_map(entries: DataFrame, cap: int = 4097) -> DataFrame:
    """doc_id, font_ord, code, cp of bfchar (code_lo = code_hi) and bfrange entries; the first UTF-16 unit counts."""
    first = F.conv(F.substring("dst_hex", 1, 4), 16, 10).cast("int")
    codes = F.sequence(F.col("code_lo"), F.least(F.col("code_hi"), F.col("code_lo") + cap - 1))
    out = entries.filter("code_hi >= code_lo").withColumn("code", F.explode(codes))
    return out.select("doc_id", "font_ord", "code", (first + F.col("code") - F.col("code_lo")).alias("cp"))


def many_subsets(fonts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """PDF.MANY_SUBSETS of (doc_id, base_name)."""
    tagged = fonts.select("doc_id", T.font_family(F.col("base_name")).alias("family"), T.subset_tag(F.col("base_name")).alias("tag")).filter("tag is not null")
    n = tagged.groupBy("doc_id", "family").agg(F.countDistinct("tag").alias("n")).filter(F.col("n") >= t.subset_tags)
    return as_findings(n, "PDF.MANY_SUBSETS", F.col("n"), None, F.concat(F.lit("family "), "family"))


def custom_differences(fonts: DataFrame) -> DataFrame:
    """PDF.CUSTOM_DIFFERENCES of (doc_id, base_name, has_differences)."""
    return as_findings(fonts.filter("has_differences"), "PDF.CUSTOM_DIFFERENCES", F.lit(1), None, F.concat(F.lit("font "), "base_name"))


def cmap_shares(cmap: DataFrame) -> DataFrame:
    """doc_id, font_ord, n_cps, n_pua of (doc_id, font_ord, cp)."""
    return cmap.groupBy("doc_id", "font_ord").agg(F.count(F.lit(1)).alias("n_cps"), F.sum(U.is_pua(F.col("cp")).cast("long")).alias("n_pua"))


def pua_cmaps(fonts: DataFrame, cmap: DataFrame, pristine: DataFrame | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """FONT.PUA_CMAP: fonts (doc_id, font_ord, family, full, postscript) that map mostly private-use code points, if they are no
    symbol fonts and no registry holds them as they are (``pristine``: doc_id, font_ord)."""
    per = cmap_shares(cmap).filter((F.col("n_cps") >= t.cmap_size) & (F.col("n_pua") / F.col("n_cps") > t.cmap_pua_ratio))
    bad = fonts.join(per, ["doc_id", "font_ord"])
    bad = bad.filter(~F.coalesce(T.is_symbol_family(F.coalesce("family", "full", "postscript")), F.lit(False)))
    if pristine is not None:
        bad = bad.join(pristine, ["doc_id", "font_ord"], "left_anti")
    return as_findings(bad, "FONT.PUA_CMAP", F.col("n_pua"), F.coalesce("family", "full", "postscript"))


def unreadable_fonts(faces: DataFrame) -> DataFrame:
    """DOCX.FONT_UNREADABLE of (doc_id, part, parsed)."""
    return as_findings(faces.filter("not parsed"), "DOCX.FONT_UNREADABLE", F.lit(1), None, F.concat(F.lit("embedded font "), "part"))
