"""Embedded fonts against a registry of fonts as published."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .findings import as_findings


def identify(fonts: DataFrame, registry: DataFrame) -> DataFrame:
    """doc_id, font_ord, status of fonts (doc_id, font_ord, file_sha, cmap_sha, postscript, family, full).

    Pristine: a registry file has the same hash.  Else the first of postscript, family and full name that the registry knows
    (under any of its three names) decides: KnownVariant if a face of that name has the same character map, otherwise
    KnownButCmapModified.  Else Unidentified.
    """
    shas = registry.select("file_sha").filter("file_sha is not null").distinct().withColumn("pristine", F.lit(True))
    names = registry.select(F.explode(F.array("postscript", "family", "full")).alias("name"), F.col("cmap_sha").alias("known_cmap"))
    names = names.filter("name is not null").select(F.lower("name").alias("name"), "known_cmap").distinct()
    claims = fonts.select("doc_id", "font_ord", "cmap_sha", F.posexplode(F.array("postscript", "family", "full")).alias("o", "name")).withColumn("name", F.lower("name"))
    hit = claims.join(names, "name").groupBy("doc_id", "font_ord", "o").agg(F.bool_or(F.coalesce(F.col("cmap_sha") == F.col("known_cmap"), F.lit(False))).alias("same"))
    first = hit.groupBy("doc_id", "font_ord").agg(F.min_by("same", "o").alias("same"))
    out = fonts.select("doc_id", "font_ord", "file_sha").join(shas, "file_sha", "left").join(first, ["doc_id", "font_ord"], "left")
    status = F.when(F.col("pristine"), "Pristine").when(F.col("same"), "KnownVariant").when(~F.col("same"), "KnownButCmapModified").otherwise("Unidentified")
    return out.select("doc_id", "font_ord", status.alias("status"))


def family_outlines(faces: DataFrame, outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(honest, drawn): which (family, cp, hash) exist in any style, and per (family, hash) the first code point by face and cp."""
    all_ = outlines.join(faces.select("face_ord", F.lower("family").alias("family")), "face_ord").filter("family is not null")
    honest = all_.select("family", "cp", "outline_hash").distinct()
    drawn = all_.groupBy("family", "outline_hash").agg(F.min(F.struct("face_ord", "cp")).alias("m")).select("family", "outline_hash", F.col("m.cp").alias("drawn_cp"))
    return honest, drawn


def canonical_substitutions(claims: DataFrame, honest: DataFrame, drawn: DataFrame) -> DataFrame:
    """doc_id, claimed_cp, drawn_cp of claims (doc_id, family, claimed_cp, outline_hash): the registry's font of that family draws
    this outline, but for another character.  An unknown family or outline proves nothing."""
    mine = claims.withColumn("family", F.lower("family"))
    lies = mine.join(honest.withColumnRenamed("cp", "claimed_cp"), ["family", "claimed_cp", "outline_hash"], "left_anti")
    return lies.join(drawn, ["family", "outline_hash"]).filter("drawn_cp <> claimed_cp").select("doc_id", "claimed_cp", "drawn_cp").distinct()


def canonical_findings(substitutions: DataFrame, suspects: DataFrame, kind: str = "PDF") -> DataFrame:
    """CANONICAL_TAMPER_CONFIRMED of documents that the outline rules suspect (doc_id)."""
    per = substitutions.join(suspects.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return as_findings(per, f"{kind}.CANONICAL_TAMPER_CONFIRMED", F.col("n"))


def registry_counts(faces: DataFrame, cmap: DataFrame) -> DataFrame:
    """face_ord, cmap_len."""
    return faces.select("face_ord").join(cmap.groupBy("face_ord").agg(F.count(F.lit(1)).alias("cmap_len")), "face_ord", "left").na.fill(0, ["cmap_len"])
