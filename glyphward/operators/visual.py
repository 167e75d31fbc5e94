"""Extracted text against what a renderer and a reader saw: divergence, missing words, votes on glyphs, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphward.functions import text as T
from glyphward.functions.align import word_mismatches
from glyphward.functions.letters import latin_letter, legit_table
from glyphward.schema import DEFAULTS, Thresholds

from .findings import as_findings


def page_divergence(pairs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(doc_id, page, extracted, visual) to doc_id, page, similarity, diverges."""
    p = pairs.select("doc_id", "page", T.words(F.col("extracted")).alias("e"), T.words(F.col("visual")).alias("v"))
    p = p.withColumn("similarity", T.jaccard(F.col("e"), F.col("v")))
    return p.select("doc_id", "page", "similarity", ((F.size("v") >= t.divergence_words) & (F.col("similarity") < t.divergence)).alias("diverges"))


def mean_similarity(pages: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id, similarity (mean over pages), diverges (any page) of ``page_divergence``, as ``verdicts`` takes them."""
    return pages.groupBy("doc_id").agg(F.avg("similarity").alias("similarity"), F.bool_or("diverges").alias("diverges"))


def missing(pairs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id, page, words: words extracted that the reader didn't see, of pages that have any."""
    return pairs.select("doc_id", "page", T.missing_words(F.col("extracted"), F.col("visual"), t.missing_words).alias("words")).filter(F.size("words") > 0)


def hidden_confirmed(pairs: DataFrame, suspects: DataFrame, kind: str = "PDF", t: Thresholds = DEFAULTS) -> DataFrame:
    """HIDDEN_TEXT_CONFIRMED of suspected documents (doc_id) with enough missing words over their pages."""
    asked = missing(pairs.join(suspects.select("doc_id").distinct(), "doc_id", "left_semi"), t)
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page", "words"))), lambda x: x["words"])
    per = asked.groupBy("doc_id").agg(F.array_distinct(F.flatten(pages)).alias("words")).filter(F.size("words") >= t.missing_confirmed)
    return as_findings(per, f"{kind}.HIDDEN_TEXT_CONFIRMED", F.size("words"), F.array_join(F.slice("words", 1, 20), " "))


def substitutions(pairs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id, page, e, v: words replaced by clearly different ones."""
    apart = pairs.filter(~F.col("extracted").eqNullSafe(F.col("visual")))  # equal texts have none
    found = apart.select("doc_id", "page", F.explode(word_mismatches("extracted", "visual")).alias("p")).select("doc_id", "page", "p.e", "p.v")
    return found.filter(T.is_real_substitution(F.col("e"), F.col("v"), t.substitution))


def divergence_confirmed(subs: DataFrame, suspects: DataFrame, kind: str = "PDF") -> DataFrame:
    per = subs.join(suspects.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(F.concat("e", F.lit("→"), "v"))), 1, 6), " ").alias("s")
    )
    return as_findings(per, f"{kind}.RENDER_DIVERGENCE_CONFIRMED", F.col("n"), F.col("s"))


def best_readings(phrases: DataFrame, readings: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """phrases (doc_id, phrase_ord, extracted, presumed) with the reader's sentence (doc_id, sentence_ord, sentence) that is most
    like either form, the last of equals; null under ``t.phrase_match``."""
    p = phrases.withColumn("we", T.words(F.col("extracted"))).withColumn("wp", T.words(F.col("presumed")))
    r = readings.withColumn("wr", T.words(F.col("sentence")))
    scored = p.join(r, "doc_id").withColumn("score", F.greatest(T.jaccard(F.col("wp"), F.col("wr")), T.jaccard(F.col("we"), F.col("wr"))))
    best = scored.groupBy("doc_id", "phrase_ord").agg(F.max(F.struct("score", "sentence_ord", "sentence")).alias("b"))
    out = phrases.join(best, ["doc_id", "phrase_ord"], "left")
    return out.withColumn("ocr", F.when(F.col("b.score") >= t.phrase_match, F.col("b.sentence"))).drop("b")


def verdicts(docs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id, verdict of (doc_id, has_collision, canonical, diverges, similarity); null where nothing is in question."""
    of_reader = F.when(F.col("diverges"), "Confirmed").when(F.col("similarity") >= t.refuted, "Refuted")
    verdict = of_reader.when(F.col("canonical"), "Confirmed").otherwise("Unconfirmed")
    return docs.select("doc_id", F.when(F.col("has_collision"), verdict).alias("verdict"))


def refute(findings: DataFrame, verdict: DataFrame) -> DataFrame:
    """findings with the glyph replacement rules of refuted documents lowered to Info."""
    gone = verdict.filter("verdict = 'Refuted'").select("doc_id", F.lit(True).alias("refuted"))
    low = F.coalesce("refuted", F.lit(False)) & F.col("rule").contains("GLYPH_SEMANTIC_REPLACEMENT")
    out = findings.join(gone, "doc_id", "left")
    out = out.withColumn("severity", F.when(low, "Info").otherwise(F.col("severity"))).withColumn("severity_rank", F.when(low, 0).otherwise(F.col("severity_rank")))
    return out.drop("refuted")


def glyph_votes(reads: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id, font_ord, gid, drawn: the letter that a strict majority of confident reads (letter, confidence) of a glyph gives."""
    sure = reads.filter((F.col("confidence") >= t.ocr_confidence) & F.col("letter").rlike(r"^\p{IsAlphabetic}$"))
    key = ["doc_id", "font_ord", "gid"]
    n = sure.groupBy(*key, F.lower("letter").alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*key).agg(F.max(F.struct("n", "letter")).alias("b"), F.sum("n").alias("total"))
    return best.filter(F.col("b.n") * 2 > F.col("total")).select(*key, F.col("b.letter").alias("drawn"))


def specimen_lies(votes: DataFrame, claims: DataFrame) -> DataFrame:
    """doc_id, drawn, claimed, n of claims (doc_id, font_ord, gid, claimed) that the vote contradicts."""
    both = votes.join(claims.withColumn("claimed", latin_letter(F.col("claimed"))), ["doc_id", "font_ord", "gid"])
    both = both.withColumn("drawn", latin_letter(F.col("drawn"))).filter("drawn <> claimed")
    odd = both.withColumn("a_cp", F.ascii("drawn")).withColumn("b_cp", F.ascii("claimed"))
    odd = odd.join(F.broadcast(legit_table(votes.sparkSession)), ["a_cp", "b_cp"], "left_anti")  # fixed table
    return odd.groupBy("doc_id", "drawn", "claimed").agg(F.count(F.lit(1)).alias("n"))


def specimen_findings(lies: DataFrame, kind: str = "PDF") -> DataFrame:
    return as_findings(lies, f"{kind}.GLYPH_SEMANTIC_REPLACEMENT_OCR", F.col("n"), F.concat("claimed", F.lit("→"), "drawn"))


def glyph_clusters(images: DataFrame, reads: DataFrame) -> DataFrame:
    """GLYPH.SEMANTIC_REPLACEMENT of glyph images (doc_id, image_hash, claimed): images that two or more letters claim; the truth
    is the letter read from the image (reads: image_hash, letter) if claimed, else the most frequent claim."""
    n = images.filter(F.col("claimed").rlike(r"^\p{IsAlphabetic}$")).groupBy("doc_id", "image_hash", "claimed").agg(F.count(F.lit(1)).alias("n"))
    n = n.join(reads.select("image_hash", F.lower("letter").alias("read")), "image_hash", "left")
    own = F.coalesce((F.lower("claimed") == F.col("read")).cast("int"), F.lit(0))
    best = n.groupBy("doc_id", "image_hash").agg(F.max(F.struct(own.alias("own"), "n", (-F.ascii("claimed")).alias("o"), "claimed")).alias("b"), F.count(F.lit(1)).alias("claims"))
    lies = n.join(best.filter("claims >= 2"), ["doc_id", "image_hash"]).filter(F.col("claimed") != F.col("b.claimed"))
    lies = lies.withColumn("truth", F.col("b.claimed")).withColumn("a_cp", F.ascii(F.lower("truth"))).withColumn("b_cp", F.ascii(F.lower("claimed"))).filter("a_cp <> b_cp")
    lies = lies.join(F.broadcast(legit_table(images.sparkSession)), ["a_cp", "b_cp"], "left_anti")  # fixed table
    per = lies.groupBy("doc_id", "truth", "claimed").agg(F.sum("n").alias("n"))
    return as_findings(per, "GLYPH.SEMANTIC_REPLACEMENT", F.col("n"), F.concat("claimed", F.lit("→"), "truth"))


def glyph_statistics(images: DataFrame) -> DataFrame:
    """doc_id, total, distinct_images, ambiguous."""
    per = images.groupBy("doc_id", "image_hash").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("claimed").rlike(r"^\p{IsAlphabetic}$"), F.col("claimed"))).alias("k")
    )
    return per.groupBy("doc_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_images"), F.sum((F.col("k") >= 2).cast("long")).alias("ambiguous"))


def to_escalate(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """PDF and DOCX documents (doc_id, format) without a glyph replacement finding: those whose glyphs are worth reading."""
    known = findings.filter(F.col("rule").contains("GLYPH_SEMANTIC_REPLACEMENT")).select("doc_id").distinct()
    return docs.filter(F.col("format").isin("pdf", "docx")).join(known, "doc_id", "left_anti")
