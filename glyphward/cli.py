"""``python -m glyphward.cli scan PATH...`` and ``build-registry --fonts-dir DIR --out FILE``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphward.functions import text as T
from glyphward.functions.letters import latin_letter
from glyphward.operators import docx_rules, glyphs, html_rules, painter, registry, text_rules
from glyphward.operators.findings import gate, union
from glyphward.plans import report
from glyphward.plans.scratch import staged
from glyphward.sources import docx, fonts, html, pdf, registry_json


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, path, format, content; formats no decoder reads are null."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.select(F.xxhash64("path").alias("doc_id"), "path", T.format_of(F.col("path")).alias("format"), "content")


_SCALAR = "cp between 1 and 1114111 and cp not between 55296 and 57343"


def character(cp: str) -> Column:
    """The character of a column of code points (scalar values only)."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def font_rules(kind: str, faces: DataFrame, cmap: DataFrame, own: DataFrame, mappings: DataFrame, words: DataFrame, known: tuple[DataFrame, DataFrame] | None):
    """(findings, phrases, verdicts) of embedded fonts: ``own`` has each font's letters and outlines, ``mappings`` all (doc_id,
    outline_hash, letter) that the text reaches; ``known`` are a registry's faces and outlines."""
    pairs = glyphs.collisions(mappings)
    found = [glyphs.replacement_findings(pairs, kind)]
    lies = pairs if kind != "PDF" else pairs.join(glyphs.uniform_shift(pairs), "doc_id", "left_anti")
    subs = glyphs.substitution_map(lies).withColumn("verdict", F.lit("Unconfirmed"))
    pristine = None
    if known is not None:
        pristine = registry.identify(faces, known[0]).filter("status = 'Pristine'")
        claims = own.join(faces.select("doc_id", "font_ord", "family"), ["doc_id", "font_ord"]).select("doc_id", "family", F.col("cp").alias("claimed_cp"), "outline_hash")
        drawn = registry.canonical_substitutions(claims, *registry.family_outlines(*known)).join(lies.select("doc_id").distinct(), "doc_id", "left_semi")
        found.append(registry.canonical_findings(drawn, lies, kind))
        sure = drawn.select("doc_id", F.lower(character("claimed_cp")).alias("lie"), F.lower(character("drawn_cp")).alias("truth"))
        sure = sure.groupBy("doc_id", "lie").agg(F.min("truth").alias("truth")).withColumn("verdict", F.lit("Confirmed"))
        subs = subs.join(sure.select("doc_id"), "doc_id", "left_anti").unionByName(sure)
    found.append(glyphs.pua_cmaps(faces, cmap, pristine))
    swaps = subs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("lie", "truth"))).alias("swaps"), F.first("verdict").alias("verdict"))
    phrases = text_rules.phrases(words.join(swaps.drop("verdict"), "doc_id"), T.apply_column_map(F.col("sentence"), F.col("swaps")))
    return union(*found), phrases, swaps.select("doc_id", "verdict")


def pdf_font_rules(pdfs: DataFrame, to: DataFrame, page_runs: DataFrame, known):
    faces, cmap, own, outlines, cids = (pdf.table_of(pdfs, k) for k in ("faces", "cmap", "glyphs", "outlines", "cid_gid"))
    codes = glyphs.tounicode_map(to).join(faces.filter("type0").select("doc_id", "font_ord", "own_cid_map"), ["doc_id", "font_ord"])
    cids = cids.unionByName(glyphs.identity_cid_gid(codes.filter("not own_cid_map")))
    reached = glyphs.type0_mappings(codes, cids, outlines).select("doc_id", "cp", "outline_hash").unionByName(own.select("doc_id", "cp", "outline_hash"))
    mappings = glyphs.letter_mappings(reached.filter(_SCALAR).withColumn("letter", character("cp")))
    runs = page_runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "op_ord", "text"))).alias("r"))
    return font_rules("PDF", faces, cmap, own, mappings, runs.select("doc_id", F.array_join("r.text", " ").alias("text")), known)


def docx_font_rules(packages: DataFrame, words: DataFrame, known):
    faces, cmap, own = (docx.table_of(packages, k) for k in ("faces", "cmap", "glyphs"))
    letters = words.select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).select("doc_id", latin_letter(F.col("c")).alias("letter")).filter("letter is not null").distinct()
    mappings = glyphs.letter_mappings(own.filter(_SCALAR).withColumn("letter", character("cp")))
    found, phrases, verdicts = font_rules("DOCX", faces.filter("parsed"), cmap, own, glyphs.in_document(mappings, letters), words, known)
    return union(found, glyphs.unreadable_fonts(faces)), phrases, verdicts


def scan_errors(files: DataFrame) -> DataFrame:
    """doc_id, error of files (doc_id, format, content) that no decoder reads, that can't be read, or not to their end."""
    unknown = files.filter("format is null").select("doc_id", F.lit("unsupported format").alias("error"))
    return unknown.unionByName(pdf.read_errors(files.filter("format = 'pdf'"))).unionByName(docx.read_errors(files.filter("format = 'docx'")))


def metadata(files: DataFrame) -> DataFrame:
    """doc_id, title, author, created, modified, producer of files that say anything about themselves; dates tidied."""
    of_pdf = pdf.read_table(files.filter("format = 'pdf'"), "metadata")
    of_pdf = of_pdf.select("doc_id", "title", "author", *[T.tidy_pdf_date(F.col(c)).alias(c) for c in ("created", "modified")], "producer")
    of_docx = docx.read_metadata(files.filter("format = 'docx'"))
    return of_pdf.unionByName(of_docx.select("doc_id", "title", F.col("creator").alias("author"), "created", "modified", F.col("application").alias("producer")))


def fonts_examined(files: DataFrame) -> DataFrame:
    """doc_id, n: fonts that a scan looks at, the font objects of a PDF and the embedded faces of a package that can be read."""
    of_pdf = pdf.read_table(files.filter("format = 'pdf'"), "fonts").groupBy("doc_id").count()
    of_docx = docx.read_faces(files.filter("format = 'docx'"), "faces").filter("parsed").groupBy("doc_id").count()
    return of_pdf.unionByName(of_docx).withColumnRenamed("count", "n")


def default_fonts_dir() -> str:
    """Where this system keeps its fonts."""
    if os.environ.get("WINDIR"):
        return os.path.join(os.environ["WINDIR"], "Fonts")
    return next((d for d in ("/usr/share/fonts", "/System/Library/Fonts") if os.path.isdir(d)), "/usr/share/fonts")


def scan(files: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Findings of files (doc_id, format, content); ``known`` as registry_json.load gives it."""
    return examine(files, known)[0]


def examine(files: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, phrases that replaced glyphs change, and verdicts of files (doc_id, format, content)."""
    pages = files.filter("format = 'html'").select("doc_id", F.decode("content", "UTF-8").alias("html"))
    read = html.read_pages(pages)
    packages = staged(docx.decode(files.filter("format = 'docx'"), ("runs", "faces", "glyphs", "cmap")), "docx", "kind")
    runs = docx.table_of(packages, "runs").withColumn("run_ord", F.col("part_ord") * 1_000_000 + F.col("run_ord"))
    words = docx_rules.body_text(runs)
    pdfs = staged(pdf.decode(files.filter("format = 'pdf'")), "pdf", "kind")
    page_runs, regions, media, pdf_fonts, to = (pdf.table_of(pdfs, k) for k in ("runs", "regions", "media", "fonts", "tounicode"))
    tallies = painter.page_tallies(painter.with_background(page_runs, regions, media), painter.image_coverage(regions.filter("is_image"), media), media)
    in_pdf, pdf_phrases, pdf_verdicts = pdf_font_rules(pdfs, to, page_runs, known)
    in_docx, docx_phrases, docx_verdicts = docx_font_rules(packages, words, known)
    found = union(
        in_pdf,
        in_docx,
        text_rules.hygiene(read.select("doc_id", F.col("dom_text").alias("text"))),
        html_rules.style_findings(read),
        html_rules.webfont_findings(read),
        text_rules.hygiene(words),
        docx_rules.run_findings(runs),
        painter.visibility_findings(tallies),
        glyphs.many_subsets(pdf_fonts),
        glyphs.custom_differences(pdf_fonts),
        glyphs.garbled_tounicode(to),
    )
    return found, pdf_phrases.unionByName(docx_phrases), pdf_verdicts.unionByName(docx_verdicts)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphward")
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan")
    s.add_argument("paths", nargs="+")
    s.add_argument("--format-out", choices=("human", "json"), default="human")
    s.add_argument("--registry", help="file or folder of a font registry")
    b = commands.add_parser("build-registry")
    b.add_argument("--fonts-dir", default=default_fonts_dir())
    b.add_argument("--out", required=True)
    b.add_argument("--slim", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("glyphward").getOrCreate()
    if args.command == "build-registry":
        faces, skipped = fonts.build_registry(spark, args.fonts_dir)
        registry_json.save(faces, args.out, args.slim)
        print(f"{registry_json.load(spark, args.out)[0].count()} faces, {skipped.count()} files skipped")
        return 0
    files = load_files(spark, args.paths)
    found, phrases, verdicts = examine(files, registry_json.load(spark, args.registry) if args.registry else None)
    found = found.persist()
    table = report.reports(files.filter("format is not null"), found, phrases, verdicts)
    print(report.as_text(table) if args.format_out == "human" else "\n".join(r["report"] for r in report.as_json(table).toLocalIterator()))
    for r in scan_errors(files).join(files.select("doc_id", "path"), "doc_id").toLocalIterator():
        print(f"not read whole: {r['path']}: {r['error']}", file=sys.stderr)
    return int(gate(found).first()["exit_code"])


if __name__ == "__main__":
    sys.exit(main())
