"""Queries whose input are files: packages, PDF files and fonts written from the tables, decoded again, and judged by the rules.

Each document becomes a file that holds its whole text.  What is hidden, forged or broken in it follows from its id, the same
in SQL.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphward import cli
from glyphward.functions import text as T
from glyphward.operators import registry
from glyphward.operators.docx_html import pages as docx_html_pages
from glyphward.sources import docx, fonts, pdf, registry_json
from glyphward.sources.batches import slices
from glyphward.sources.synthetic import write_font, write_pdf

from .queries import query, table
from .scratch import scratch_dir

_KEY = "{00112233-4455-6677-8899-AABBCCDDEEFF}"
HONEST = write_font({c: c for c in "abcdefgh"}, "Tiny")
FORGED = write_font({c: "b" if c == "d" else c for c in "abcdefgh"}, "Tiny")
SYMBOLS = write_font({chr(0xE000 + k): chr(97 + k % 8) for k in range(20)}, "Runes")


def file_batches(write):
    """What a task does with batches of documents: a few at a time become files."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([write(r) for r in some.to_pylist()], pa.binary())], names=["doc_id", "content"])

    return run


def _files(docs: DataFrame, write) -> DataFrame:
    """doc_id, content of documents (doc_id, text, source, lang)."""
    return docs.select("doc_id", "text", "source", "lang").mapInArrow(file_batches(write), "doc_id long, content binary")


def _spread(docs: DataFrame) -> DataFrame:
    """Documents in equal parts for all cores, however few and uneven the parts of the stored table are: writing and decoding a
    file takes a core much longer than sending its text.  With a number, as without one the parts are joined until there is
    about one for each core, and one more than that takes all of them twice as long."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("doc_id", "text", "source", "lang").repartition(n, "doc_id")


def write_docx(r: dict) -> bytes:
    i = r["doc_id"]
    runs = [
        {"para_ord": k, "text": line, "color": "FFFFFF" if i % 4 == 0 else "112233", "sz": 7 if i % 5 == 0 else 22, "n_vanish": int(i % 7 == 0 and k == 0)}
        for k, line in enumerate((r["text"] or "").split("\n"))
    ]
    program = FORGED if i % 3 == 0 else HONEST if i % 3 == 1 else SYMBOLS
    embedded = [("Tiny", _KEY, program)] + ([("Broken", "", b"nothing")] if i % 10 == 9 else [])
    core = {"title": r["source"], "creator": r["lang"]} if i % 2 else {}
    return docx.write_package(runs, embedded, core)


def write_page(r: dict) -> bytes:
    i = r["doc_id"]
    lines = [{"text": x, "render_mode": 3 if i % 4 == 0 else 0, "size": 1 if i % 5 == 0 else 12, "fill": (1, 1, 1) if i % 6 == 1 else (0, 0, 0)} for x in (r["text"] or "").split("\n")]
    info = {"Title": f"{r['source']} (ä)", "Author": r["lang"], "CreationDate": f"D:202401{1 + i % 28:02d}103005"} if i % 2 else {}
    program = FORGED if i % 3 == 0 else HONEST if i % 3 == 1 else SYMBOLS
    return write_pdf(lines, garbled=5 if i % 7 == 0 else 2, differences=i % 8 == 0, subsets=6 if i % 9 == 0 else 3, program=program, info=info)


def docx_files(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """Packages of the documents that a condition picks: the others are not written."""
    return _files(_spread(table(spark, sf_dir, "documents").filter(which)), write_docx).withColumn("format", F.lit("docx"))


def pdf_files(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """PDF files of the documents that a condition picks: the others are not written."""
    return _files(_spread(table(spark, sf_dir, "documents").filter(which)), write_page).withColumn("format", F.lit("pdf"))


_LINES = "line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM documents)"


@query(
    f"""WITH {_LINES} SELECT doc_id, o::INTEGER AS para_ord, text, CASE WHEN doc_id % 4 = 0 THEN 'FFFFFF' ELSE '112233' END AS color,
  CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 22 END::INTEGER AS sz, (doc_id % 7 = 0 AND o = 0)::INTEGER AS n_vanish FROM line"""
)
def docx_decode(spark, sf_dir):
    """Runs, paragraphs and run properties of packages, as written."""
    return docx.read_runs(docx_files(spark, sf_dir)).select("doc_id", "para_ord", "text", "color", F.col("sz").cast("int").alias("sz"), F.col("n_vanish").cast("int").alias("n_vanish"))


@query(
    f"""WITH {_LINES} SELECT doc_id, o::INTEGER AS line_ord, text, (CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 0 END)::INTEGER AS render_mode,
  (2 * length(text))::BIGINT AS nbytes, (doc_id % 6 = 1) AS white, (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 12 END)::DOUBLE AS size FROM line WHERE text <> ''"""
)
def pdf_decode(spark, sf_dir):
    """Shown text of PDF pages through the fonts' ToUnicode maps, with mode, size and colour."""
    runs = pdf.read_table(pdf_files(spark, sf_dir), "runs").filter("text <> ''")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ord", "line")).filter("line <> ''")
    # a run is named by its place among the lines that show anything
    from pyspark.sql import Window as W

    runs = runs.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("op_ord")))
    lines = lines.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("line_ord"))).drop("line")
    return runs.join(lines, ["doc_id", "k"]).select("doc_id", "line_ord", "text", "render_mode", "nbytes", (F.col("fill")[0] > 0.5).alias("white"), F.col("eff_size").alias("size"))


_MARKS = r"""facts AS (
  SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\s\p{Z}]', '', 'g')) AS chars, length(replace(coalesce(text, ''), chr(10), '')) AS shown,
    regexp_matches(lower(text), 'b') AND regexp_matches(lower(text), 'd') AS both_letters,
    len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]')) AS pua,
    len(regexp_extract_all(text, '[\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]')) AS zero,
    len(regexp_extract_all(text, '[\x{202A}-\x{202E}\x{2066}-\x{2069}]')) AS bidi FROM documents)"""


@query(
    f"""WITH {_MARKS}
SELECT doc_id, 'DOCX.INVISIBLE_TEXT_COLOR' AS rule, 'High' AS severity, chars::BIGINT AS n FROM facts WHERE doc_id % 4 = 0 AND chars >= 4
UNION ALL SELECT doc_id, 'DOCX.TINY_TEXT', 'High', chars FROM facts WHERE doc_id % 5 = 0 AND chars >= 4
UNION ALL SELECT doc_id, 'DOCX.HIDDEN_VANISH', 'Medium', 1 FROM facts WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 'DOCX.FONT_UNREADABLE', 'Low', 1 FROM facts WHERE doc_id % 10 = 9
UNION ALL SELECT doc_id, 'DOCX.GLYPH_SEMANTIC_REPLACEMENT', 'High', 1 FROM facts WHERE doc_id % 3 = 0 AND both_letters
UNION ALL SELECT doc_id, 'DOCX.CANONICAL_TAMPER_CONFIRMED', 'High', 1 FROM facts WHERE doc_id % 3 = 0 AND both_letters
UNION ALL SELECT doc_id, 'FONT.PUA_CMAP', 'High', 20 FROM facts WHERE doc_id % 3 = 2
UNION ALL SELECT doc_id, 'UNICODE.PUA', 'High', pua FROM facts WHERE pua >= 4
UNION ALL SELECT doc_id, 'UNICODE.ZERO_WIDTH', 'Medium', zero FROM facts WHERE zero > 0
UNION ALL SELECT doc_id, 'UNICODE.BIDI_OVERRIDE', 'Medium', bidi FROM facts WHERE bidi > 0"""
)
def docx_scan(spark, sf_dir):
    """All rules over packages with obfuscated fonts, forged, honest, private-use or broken, against a registry."""
    return cli.scan(docx_files(spark, sf_dir), known_fonts(spark)).select("doc_id", "rule", "severity", "n")


@query(
    f"""WITH {_MARKS}
SELECT doc_id, 'PDF.INVISIBLE_RENDER_MODE' AS rule, 'Medium' AS severity, (2 * shown)::BIGINT AS n FROM facts WHERE doc_id % 4 = 0 AND 2 * shown >= 4
UNION ALL SELECT doc_id, 'PDF.TINY_TEXT', 'Medium', 2 * shown FROM facts WHERE doc_id % 5 = 0 AND 2 * shown >= 4
UNION ALL SELECT doc_id, 'PDF.CUSTOM_DIFFERENCES', 'Info', 1 FROM facts WHERE doc_id % 8 = 0
UNION ALL SELECT doc_id, 'PDF.MANY_SUBSETS', 'Medium', 6 FROM facts WHERE doc_id % 9 = 0
UNION ALL SELECT doc_id, 'PDF.TOUNICODE_GARBLED', 'High', 5 FROM facts WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 'PDF.GLYPH_SEMANTIC_REPLACEMENT', 'High', 1 FROM facts WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'PDF.CANONICAL_TAMPER_CONFIRMED', 'High', 1 FROM facts WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'FONT.PUA_CMAP', 'High', 20 FROM facts WHERE doc_id % 3 = 2
UNION ALL SELECT doc_id, 'PDF.INVISIBLE_TEXT_COLOR', 'Medium', 2 * shown FROM facts WHERE doc_id % 6 = 1 AND doc_id % 4 <> 0 AND 2 * shown >= 4"""
)
def pdf_scan(spark, sf_dir):
    """All rules over PDF files with hidden, tiny and white text, odd fonts and embedded programs, against a registry."""
    return cli.scan(pdf_files(spark, sf_dir), known_fonts(spark)).select("doc_id", "rule", "severity", "n")


def _uri(data: bytes) -> str:
    import base64

    return base64.b64encode(data).decode()


@query(
    f"""WITH {_LINES}, p AS (
  SELECT doc_id, o, CASE WHEN text = '' THEN '<p></p>' ELSE '<p><span style="color:#' || CASE WHEN doc_id % 4 = 0 THEN 'FFFFFF' ELSE '112233' END || ';font-size:' || CASE WHEN doc_id % 5 = 0 THEN '3.5' ELSE '11.0' END
    || 'pt;">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span></p>' END AS p FROM line)
SELECT doc_id, '<!doctype html>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<style>@font-face{{font-family:''Tiny'';src:url(data:font/ttf;base64,'
  || CASE doc_id % 3 WHEN 0 THEN '{_uri(FORGED)}' WHEN 1 THEN '{_uri(HONEST)}' ELSE '{_uri(SYMBOLS)}' END || ')}}</style>' || chr(10) || string_agg(p, chr(10) ORDER BY o) AS html FROM p GROUP BY doc_id"""
)
def docx_html(spark, sf_dir):
    """Packages as pages of HTML with their fonts."""
    files = docx_files(spark, sf_dir)
    return docx_html_pages(docx.read_runs(files), docx.read_programs(files))


def font_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a font per document with its letters a to z; every third draws b for d."""

    def write(r):
        letters = sorted(set((r["text"] or "").lower()) & set("abcdefghijklmnopqrstuvwxyz"))
        return write_font({c: "b" if c == "d" and r["doc_id"] % 3 == 0 else c for c in letters}, f"Doc{r['doc_id']}") if letters else b"no letters"

    return _files(table(spark, sf_dir, "documents"), write).select(F.concat(F.lit("Doc"), F.col("doc_id").cast("string")).alias("path"), "content")


_FONT_LETTERS = """letter AS (
  SELECT DISTINCT doc_id, c FROM (SELECT doc_id, unnest(string_split(lower(text), '')) AS c FROM documents) WHERE c BETWEEN 'a' AND 'z' AND regexp_matches(c, '^[a-z]$')
), glyph AS (
  SELECT doc_id, c, CASE WHEN c = 'd' AND doc_id % 3 = 0 THEN 'b' ELSE c END AS drawn FROM letter)"""


@query(f"WITH {_FONT_LETTERS} SELECT 'Doc' || doc_id AS family, ascii(c)::INTEGER AS cp, min(ascii(c)) OVER (PARTITION BY doc_id, drawn)::INTEGER AS first_cp FROM glyph")
def font_glyphs(spark, sf_dir):
    """Character maps and outlines of TrueType files: each code point, and the first one of the same outline."""
    from pyspark.sql import Window as W

    glyphs = fonts.read_fonts(font_files(spark, sf_dir)).select("family", F.inline("cps"))
    return glyphs.select("family", "cp", F.min("cp").over(W.partitionBy("family", "outline_hash")).alias("first_cp"))


@query(f"WITH {_FONT_LETTERS} SELECT 'Doc' || doc_id AS family, count(*)::BIGINT AS cmap_len, count(DISTINCT drawn)::BIGINT AS n_outlines FROM glyph GROUP BY doc_id")
def registry_round_trip(spark, sf_dir):
    """Fonts to a registry file and back."""
    import uuid

    path = f"{scratch_dir(spark)}/registry-{uuid.uuid4().hex}"
    registry_json.save(fonts.read_fonts(font_files(spark, sf_dir)), path)
    faces, outlines = registry_json.load(spark, path)
    per = outlines.groupBy("face_ord").agg(F.countDistinct("outline_hash").alias("n_outlines"))
    return faces.join(per, "face_ord").select("family", "cmap_len", "n_outlines")


def known_fonts(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Faces and outlines of the honest font, as a registry holds them."""
    face = fonts.parse_faces(HONEST)[0]
    row = [(0, face["family"], face.get("full"), face.get("postscript"), face["file_sha"], face["cmap_sha"])]
    faces = spark.createDataFrame(row, "face_ord long, family string, full string, postscript string, file_sha string, cmap_sha string")
    return faces, spark.createDataFrame([(0, cp, h) for cp, h in face["outlines"].items()], "face_ord long, cp int, outline_hash long")


@query(
    """SELECT doc_id, source || CASE WHEN doc_id % 4 = 1 THEN ' (ä)' ELSE '' END AS title, lang AS author,
  CASE WHEN doc_id % 4 = 1 THEN '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || ' 10:30:05' END AS created FROM documents WHERE doc_id % 2 = 1"""
)
def file_metadata(spark, sf_dir):
    """Document information of PDF files (ids 1 modulo 4) and packages (ids 3 modulo 4); files without any have no row."""
    files = pdf_files(spark, sf_dir, "doc_id % 4 < 2").unionByName(docx_files(spark, sf_dir, "doc_id % 4 >= 2"))
    return cli.metadata(files).select("doc_id", "title", "author", "created")


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'unsupported format' WHEN 1 THEN 'ValueError' ELSE 'BadZipFile' END AS error FROM documents WHERE doc_id % 5 < 3"""
)
def scan_errors(spark, sf_dir):
    """Files of no known format, PDF files and packages cut short; whole files have no error."""
    whole = pdf_files(spark, sf_dir, "doc_id % 5 = 3").unionByName(docx_files(spark, sf_dir, "doc_id % 5 = 4"))
    ids = table(spark, sf_dir, "documents").select("doc_id", F.lit(b"cut").alias("content"))
    kind = F.when(F.col("doc_id") % 5 == 1, "pdf").when(F.col("doc_id") % 5 == 2, "docx")
    broken = ids.filter("doc_id % 5 < 3").withColumn("format", kind)
    return cli.scan_errors(whole.unionByName(broken)).select("doc_id", F.regexp_extract("error", "^([^:]+)", 1).alias("error"))


@query("SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 2 + CASE WHEN doc_id % 9 = 0 THEN 6 ELSE 3 END ELSE 1 END)::BIGINT AS n FROM documents")
def fonts_examined(spark, sf_dir):
    files = pdf_files(spark, sf_dir, "doc_id % 2 = 0").unionByName(docx_files(spark, sf_dir, "doc_id % 2 = 1"))
    return cli.fonts_examined(files)


@query(f"WITH {_FONT_LETTERS} SELECT 'Doc' || doc_id AS family, count(*)::BIGINT AS cmap_len FROM glyph GROUP BY doc_id")
def registry_counts(spark, sf_dir):
    faces = fonts.read_fonts(font_files(spark, sf_dir)).withColumn("face_ord", F.xxhash64("path"))
    counts = registry.registry_counts(faces, faces.select("face_ord", F.inline("cps")))
    return faces.select("face_ord", "family").join(counts, "face_ord").select("family", "cmap_len")


@query(
    r"""SELECT doc_id, lower(nullif(regexp_extract(text, '\pL', 0), '')) AS first_letter, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:16], ' ') AS snippet
FROM documents WHERE text IS NOT NULL"""
)
def text_heads(spark, sf_dir):
    """First letters and first words of texts."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.nullif(T.first_letter(F.col("text")), F.lit("")).alias("first_letter"), T.first_words(F.col("text")).alias("snippet"))
