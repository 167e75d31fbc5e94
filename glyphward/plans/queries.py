"""The engine's rules as whole-table queries over the driver's tables, and the same in DuckDB SQL.

The tables hold no forged documents, so each query first derives its input from a table, with the same deterministic
tampering in both languages: characters added to texts, style sheets to pages, and font, paint or run tables made from
ids, letters and turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphward.functions import text as T
from glyphward.functions.letters import latin_letter
from glyphward.operators import docx_rules, findings, glyphs, html_rules, ocr, painter, registry, text_rules, visual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHORT = ["doc_id", "rule", "severity", "severity_rank", "category", "n"]

# ------------------------------------------------------------ texts


def tampered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    some = lambda k, c: F.when(F.col("doc_id") % k == 0, c).otherwise("")
    pua = F.repeat(F.lit(""), (F.col("doc_id") % 7).cast("int"))
    return docs.withColumn("text", F.concat("text", some(11, pua), some(13, F.lit("​")), some(17, F.lit("‮"))))


_TEXTS = """tampered AS (
  SELECT doc_id, text || CASE WHEN doc_id % 11 = 0 THEN repeat(chr(57344), (doc_id % 7)::INT) ELSE '' END
    || CASE WHEN doc_id % 13 = 0 THEN chr(8203) ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN chr(8238) ELSE '' END AS text FROM documents
), hits AS (
  SELECT doc_id, len(regexp_extract_all(text, '[\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{FFFFD}\\x{100000}-\\x{10FFFD}]')) AS pua,
    len(regexp_extract_all(text, '[\\x{200B}-\\x{200D}\\x{2060}-\\x{2064}\\x{FEFF}\\x{00AD}]')) AS zero,
    len(regexp_extract_all(text, '[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]')) AS bidi FROM tampered
), text_findings AS (
  SELECT doc_id, 'UNICODE.PUA' AS rule, 'High' AS severity, 3 AS severity_rank, 'UnicodeHygiene' AS category, pua::BIGINT AS n FROM hits WHERE pua >= 4
  UNION ALL SELECT doc_id, 'UNICODE.ZERO_WIDTH', 'Medium', 2, 'UnicodeHygiene', zero::BIGINT FROM hits WHERE zero > 0
  UNION ALL SELECT doc_id, 'UNICODE.BIDI_OVERRIDE', 'Medium', 2, 'UnicodeHygiene', bidi::BIGINT FROM hits WHERE bidi > 0
)"""


@query(f"WITH {_TEXTS} SELECT * FROM text_findings")
def text_hygiene(spark, sf_dir):
    return text_rules.hygiene(tampered_texts(spark, sf_dir)).select(*_SHORT)


@query(
    r"""SELECT letter, count(*)::BIGINT AS n FROM (SELECT lower(unnest(string_split(text, ''))) AS letter FROM documents)
WHERE regexp_matches(letter, '^\p{Latin}$') AND regexp_matches(letter, '^\pL$') GROUP BY 1"""
)
def letter_histogram(spark, sf_dir):
    letters = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    return letters.select(latin_letter(F.col("c")).alias("letter"), "k").filter("letter is not null").groupBy("letter").agg(F.sum("k").alias("n"))


_SENTENCES = r"""list_filter(list_transform(regexp_extract_all(text, '[^.!?;\n\r]*[.!?;\n\r]|[^.!?;\n\r]+$'),
  lambda x: trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'))), lambda x: x <> '')"""
_SENTENCE_TABLE = rf"""s AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents), sentence AS (
  SELECT doc_id, o - 1 AS sentence_ord, CASE WHEN length(x) > 400 THEN substr(x, 1, 400) || '…' ELSE x END AS sentence
  FROM (SELECT doc_id, unnest(ss) AS x, generate_subscripts(ss, 1) AS o FROM s))"""


@query(f"WITH {_SENTENCE_TABLE} SELECT doc_id, sentence_ord::INTEGER AS sentence_ord, sentence FROM sentence")
def sentence_split(spark, sf_dir):
    return text_rules.sentence_table(table(spark, sf_dir, "documents"))


@query(
    f"""WITH {_SENTENCE_TABLE}, changed AS (
  SELECT *, translate(sentence, 'kwKW', 'xvXV') AS presumed, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_ord) AS r
  FROM sentence WHERE translate(sentence, 'kwKW', 'xvXV') <> sentence)
SELECT doc_id, sentence_ord::INTEGER AS sentence_ord, sentence AS extracted, presumed FROM changed WHERE r <= 100"""
)
def phrase_diffs(spark, sf_dir):
    return text_rules.phrases(table(spark, sf_dir, "documents").select("doc_id", "text"), T.apply_map(F.col("sentence"), {"k": "x", "w": "v"}))


# ------------------------------------------------------------ pages

_CSS = ".x{opacity:0.5;display:none;left:-9999px}.y::after{content:'z'}@font-face{src:url(https://a.example/f.woff)}@font-face{src:url('data:font/x')}"


def tampered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    added = F.when(F.col("doc_id") % 5 == 0, F.concat("html", F.lit(f"<style>{_CSS}</style>"))).when(
        F.col("doc_id") % 5 == 1, F.concat("html", F.lit('<p style="visibility:hidden;font-size:0px">a</p>'))
    )
    return pages.select("doc_id", html_rules.css_text(F.coalesce(added, F.col("html"))).alias("css"))


_CSS_SQL = rf"""page AS (
  SELECT page_id AS doc_id, CASE page_id % 5 WHEN 0 THEN html || '<style>{_CSS.replace("'", "''")}</style>'
    WHEN 1 THEN html || '<p style="visibility:hidden;font-size:0px">a</p>' ELSE html END AS html FROM pages
), css AS (
  SELECT doc_id, array_to_string(list_concat(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1),
    regexp_extract_all(html, '(?is)<[a-z][^>]*\sstyle\s*=\s*["'']([^"'']*)["'']', 1)), chr(10)) AS css FROM page
), pattern(rule, severity, severity_rank, sample, p) AS (VALUES
  {", ".join(f"('HTML.HIDDEN_STYLE', 'Medium', 2, '{k}', '{p}')" for k, p in html_rules.CLOAKING.items())},
  ('HTML.CSS_CONTENT_INJECTION', 'Low', 1, NULL, 'content\s*:\s*["'']')
)"""
_CSS_COUNTS = "\n".join(
    f"  {'UNION ALL ' if i else ''}SELECT doc_id, '{rule}' AS rule, '{sev}' AS severity, {rank} AS severity_rank, 'HiddenContent' AS category, "
    f"{label} AS sample, len(regexp_extract_all(css, '{p}'))::BIGINT AS n FROM css"
    for i, (rule, sev, rank, label, p) in enumerate(
        [("HTML.HIDDEN_STYLE", "Medium", 2, f"'{k}'", p) for k, p in html_rules.CLOAKING.items()]
        + [("HTML.CSS_CONTENT_INJECTION", "Low", 1, "NULL", html_rules.CONTENT.replace('\\"', '"').replace("'", "''"))]
    )
)
_CSS_SQL = _CSS_SQL[: _CSS_SQL.index(", pattern(")]


@query(f"WITH {_CSS_SQL}, found AS (\n{_CSS_COUNTS}\n) SELECT * FROM found WHERE n > 0")
def html_cloaking(spark, sf_dir):
    return html_rules.style_findings(tampered_pages(spark, sf_dir)).select(*_SHORT, "sample")


@query(
    rf"""WITH {_CSS_SQL}, body AS (SELECT doc_id, unnest(regexp_extract_all(css, '(?is)@font-face\s*\{{([^}}]*)\}}', 1)) AS b FROM css),
url AS (SELECT doc_id, trim(unnest(regexp_extract_all(b, 'url\(\s*[''"]?([^''")]+)[''"]?\s*\)', 1))) AS t FROM body)
SELECT doc_id, 'HTML.REMOTE_WEBFONT' AS rule, 'Info' AS severity, 0 AS severity_rank, 'FontIntegrity' AS category, 1::BIGINT AS n, t AS sample
FROM url WHERE regexp_matches(t, '^(https?:)?//')
UNION ALL SELECT doc_id, 'HTML.DATAURI_WEBFONT', 'Info', 0, 'FontIntegrity', 1, NULL FROM url WHERE starts_with(t, 'data:')
UNION ALL SELECT doc_id, 'HTML.FONTFACE_COUNT', 'Info', 0, 'Structural', count(*), NULL FROM body GROUP BY doc_id"""
)
def html_webfonts(spark, sf_dir):
    return html_rules.webfont_findings(tampered_pages(spark, sf_dir)).select(*_SHORT, "sample")


def _all_findings(spark, sf_dir):
    pages = tampered_pages(spark, sf_dir)
    return findings.union(text_rules.hygiene(tampered_texts(spark, sf_dir)), html_rules.style_findings(pages), html_rules.webfont_findings(pages))


_ALL = f"""{_TEXTS}, {_CSS_SQL}, found AS (
{_CSS_COUNTS}
), body AS (SELECT doc_id, unnest(regexp_extract_all(css, '(?is)@font-face\\s*\\{{([^}}]*)\\}}', 1)) AS b FROM css), every AS (
  SELECT doc_id, severity, severity_rank, category FROM text_findings UNION ALL SELECT doc_id, severity, severity_rank, category FROM found WHERE n > 0
  UNION ALL SELECT doc_id, 'Info', 0, 'FontIntegrity' FROM body UNION ALL SELECT DISTINCT doc_id, 'Info', 0, 'Structural' FROM body
)"""


@query(f"WITH {_ALL} SELECT category, severity, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM every GROUP BY ROLLUP (category, severity)")
def findings_rollup(spark, sf_dir):
    return findings.rollup(_all_findings(spark, sf_dir))


@query(f"WITH {_ALL} SELECT coalesce(max(severity_rank) >= 3, false)::INTEGER AS exit_code FROM every")
def gate_exit_code(spark, sf_dir):
    return findings.gate(_all_findings(spark, sf_dir))


# ------------------------------------------------------------ letters and fonts


def document_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    each = docs.select("doc_id", "source", F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("letter"))
    return each.filter(F.col("letter").rlike("^[a-z]$"))


def tampered_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each letter twice on its own outline; the third mapping lies in some documents."""
    letters = document_letters(spark, sf_dir).withColumn("subtable_ord", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    own = F.ascii("letter")
    lie = F.when((F.col("doc_id") % 17 == 0) & (F.col("letter") == "d"), F.ascii(F.lit("m"))).when((F.col("doc_id") % 17 == 0) & (F.col("letter") == "r"), F.ascii(F.lit("n")))
    lie = lie.when(F.col("doc_id") % 19 == 0, own - 2).otherwise(own)
    return letters.withColumn("outline_hash", F.when(F.col("subtable_ord") == 2, lie).otherwise(own).cast("long"))


_LETTERS = """letter AS (
  SELECT DISTINCT doc_id, source, letter FROM (SELECT doc_id, source, unnest(string_split(lower(text), '')) AS letter FROM documents) WHERE regexp_matches(letter, '^[a-z]$')
)"""
_PAIRS = f"""{_LETTERS}, mapping AS (
  SELECT doc_id, letter, CASE WHEN k < 2 THEN ascii(letter) WHEN doc_id % 17 = 0 AND letter = 'd' THEN ascii('m') WHEN doc_id % 17 = 0 AND letter = 'r' THEN ascii('n')
    WHEN doc_id % 19 = 0 THEN ascii(letter) - 2 ELSE ascii(letter) END AS h FROM letter CROSS JOIN (VALUES (0), (1), (2)) t(k)
), n AS (SELECT doc_id, h, letter, count(*) AS n FROM mapping GROUP BY 1, 2, 3
), ranked AS (SELECT *, first_value(letter) OVER (PARTITION BY doc_id, h ORDER BY n DESC, ascii(letter)) AS truth FROM n
), pair AS (
  SELECT doc_id, truth, letter AS lie, sum(n)::BIGINT AS n FROM ranked
  WHERE letter <> truth AND NOT (letter IN ('i', 'l') AND truth IN ('i', 'l')) GROUP BY 1, 2, 3
), shifts AS (SELECT doc_id, ascii(truth) - ascii(lie) AS shift, count(*) AS n FROM pair GROUP BY 1, 2
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, shift) AS r, sum(n) OVER (PARTITION BY doc_id) AS total FROM shifts
), shifted AS (SELECT doc_id, shift, n FROM best WHERE r = 1 AND shift <> 0 AND n >= 8 AND n >= 0.8 * total)"""


def _pairs(spark, sf_dir):
    return glyphs.collisions(glyphs.letter_mappings(tampered_glyphs(spark, sf_dir)))


@query(f"WITH {_PAIRS} SELECT * FROM pair")
def glyph_collisions(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(
    f"""WITH {_PAIRS}, r AS (SELECT doc_id, lie, truth, row_number() OVER (PARTITION BY doc_id, lie ORDER BY n DESC, ascii(truth)) AS r FROM pair)
SELECT doc_id, lie, truth FROM r WHERE r = 1"""
)
def substitution_map(spark, sf_dir):
    return glyphs.substitution_map(_pairs(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT doc_id, shift::INTEGER AS shift, n FROM shifted")
def uniform_shift(spark, sf_dir):
    return glyphs.uniform_shift(_pairs(spark, sf_dir))


@query(
    f"""WITH {_PAIRS}
SELECT doc_id, 'PDF.GLYPH_SEMANTIC_REPLACEMENT' AS rule, 'High' AS severity, 3 AS severity_rank, 'FontIntegrity' AS category, n, lie || '→' || truth AS sample
FROM pair WHERE doc_id NOT IN (SELECT doc_id FROM shifted)
UNION ALL SELECT doc_id, 'PDF.FONT_ENCODING_ARTIFACT', 'Info', 0, 'Structural', n, shift::VARCHAR FROM shifted"""
)
def glyph_replacement(spark, sf_dir):
    return glyphs.replacement_findings(_pairs(spark, sf_dir)).select(*_SHORT, "sample")


def tampered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as one run, white or tiny in some documents."""
    d = F.col("doc_id")
    white, small = F.when(d % 23 == 0, "FFFFFF").otherwise("000000"), F.when(d % 29 == 0, 7).otherwise(22)
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        d, F.lit(0).alias("run_ord"), "text", white.alias("color"), small.alias("sz"), none.alias("highlight"), none.alias("shd_fill"), F.when(d % 31 == 0, 1).otherwise(0).alias("n_vanish")
    )


@query(
    rf"""WITH {_TEXTS}, {_PAIRS}, run AS (
  SELECT doc_id, length(regexp_replace(text, '[\s\p{{Z}}]', '', 'g')) AS chars FROM documents
), every AS (
  SELECT doc_id, severity_rank, category FROM text_findings
  UNION ALL SELECT doc_id, 3, 'FontIntegrity' FROM pair WHERE doc_id NOT IN (SELECT doc_id FROM shifted)
  UNION ALL SELECT doc_id, 0, 'Structural' FROM shifted
  UNION ALL SELECT doc_id, 3, 'HiddenContent' FROM run WHERE doc_id % 23 = 0 AND chars >= 4
  UNION ALL SELECT doc_id, 3, 'HiddenContent' FROM run WHERE doc_id % 29 = 0 AND chars >= 4
  UNION ALL SELECT doc_id, 2, 'HiddenContent' FROM run WHERE doc_id % 31 = 0
), per AS (
  SELECT doc_id, max(severity_rank) AS m, count(*) AS n, bool_or(category = 'FontIntegrity' AND severity_rank >= 3) AS f, bool_or(category = 'HiddenContent' AND severity_rank >= 2) AS h
  FROM every GROUP BY 1)
SELECT d.doc_id, coalesce(m < 3, true) AS ok, coalesce(f, false) AS defaced, coalesce(h, false) AS hidden_text,
  CASE m WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' WHEN 0 THEN 'Info' END AS max_severity, coalesce(n, 0)::BIGINT AS n_findings
FROM documents d LEFT JOIN per USING (doc_id)"""
)
def assess_documents(spark, sf_dir):
    """Texts, glyph mappings and runs of every document, judged together."""
    found = findings.union(
        text_rules.hygiene(tampered_texts(spark, sf_dir)), glyphs.replacement_findings(_pairs(spark, sf_dir)), docx_rules.run_findings(tampered_runs(spark, sf_dir))
    )
    return findings.assess(table(spark, sf_dir, "documents"), found)


_REGISTRY = """face AS (SELECT source AS family, row_number() OVER (ORDER BY source) AS face_ord FROM (SELECT DISTINCT source FROM documents)),
alphabet AS (SELECT unnest(range(97, 123)) AS cp), outline AS (SELECT face_ord, family, cp, cp * 31 AS h FROM face CROSS JOIN alphabet),
claim AS (SELECT doc_id, source AS family, ascii(letter) AS claimed_cp, CASE WHEN doc_id % 17 = 0 AND letter = 'd' THEN ascii('m') ELSE ascii(letter) END * 31 AS h FROM letter),
tamper AS (
  SELECT DISTINCT c.doc_id, c.claimed_cp, d.drawn_cp FROM claim c
  JOIN (SELECT family, h, arg_min(cp, face_ord * 1000 + cp) AS drawn_cp FROM outline GROUP BY 1, 2) d USING (family, h)
  WHERE NOT EXISTS (SELECT 1 FROM outline o WHERE o.family = c.family AND o.cp = c.claimed_cp AND o.h = c.h) AND drawn_cp <> claimed_cp)"""


@query(f"WITH {_LETTERS}, {_REGISTRY} SELECT * FROM tamper")
def canonical_tamper(spark, sf_dir):
    letters = document_letters(spark, sf_dir)
    faces = table(spark, sf_dir, "documents").select(F.col("source").alias("family")).distinct().withColumn("face_ord", F.xxhash64("family"))
    outlines = faces.select("face_ord", F.explode(F.sequence(F.lit(97), F.lit(122))).alias("cp")).withColumn("outline_hash", F.col("cp") * 31)
    drawn = F.when((F.col("doc_id") % 17 == 0) & (F.col("letter") == "d"), F.lit(109)).otherwise(F.ascii("letter"))
    claims = letters.select("doc_id", F.col("source").alias("family"), F.ascii("letter").alias("claimed_cp"), (drawn * 31).alias("outline_hash"))
    return registry.canonical_substitutions(claims, *registry.family_outlines(faces, outlines))


@query(
    """WITH f AS (
  SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN source ELSE doc_id::VARCHAR END) AS file_sha, md5(CASE WHEN doc_id % 5 < 3 THEN source ELSE doc_id::VARCHAR END) AS cmap_sha,
    CASE WHEN doc_id % 7 = 0 THEN 'Nowhere' ELSE source END AS family FROM documents
), g AS (SELECT DISTINCT source FROM documents)
SELECT doc_id, 0 AS font_ord, CASE WHEN file_sha IN (SELECT sha256(source) FROM g) THEN 'Pristine' WHEN family NOT IN (SELECT source FROM g) THEN 'Unidentified'
  WHEN cmap_sha = md5(family) THEN 'KnownVariant' ELSE 'KnownButCmapModified' END AS status FROM f"""
)
def identify_fonts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    pick = lambda k, f: f(F.when(F.col("doc_id") % 5 < k, F.col("source")).otherwise(F.col("doc_id").cast("string")))
    fonts = docs.select(
        "doc_id", F.lit(0).alias("font_ord"), pick(1, lambda c: F.sha2(c, 256)).alias("file_sha"), pick(3, F.md5).alias("cmap_sha"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("Unknown")).alias("postscript"), F.when(F.col("doc_id") % 7 == 0, "Nowhere").otherwise(F.col("source")).alias("family"),
        F.lit(None).cast("string").alias("full"),
    )
    s = F.col("source")
    known = docs.select("source").distinct().select(
        F.sha2(s, 256).alias("file_sha"), F.md5(s).alias("cmap_sha"), F.concat(s, F.lit("-Regular")).alias("postscript"), s.alias("family"), F.concat(s, F.lit(" Regular")).alias("full")
    )
    return registry.identify(fonts, known)


@query(
    """SELECT doc_id, 'PDF.MANY_SUBSETS' AS rule, 'Medium' AS severity, 2 AS severity_rank, 'Structural' AS category, (3 + doc_id % 4)::BIGINT AS n, 'family ' || source AS location
FROM documents WHERE 3 + doc_id % 4 >= 5"""
)
def subset_fonts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    fonts = docs.withColumn("i", F.explode(F.sequence(F.lit(0), (F.lit(2) + F.col("doc_id") % 4).cast("int"))))
    return glyphs.many_subsets(fonts.select("doc_id", F.concat(F.repeat(F.expr("char(65 + i)"), F.lit(6)), F.lit("+"), "source").alias("base_name"))).select(*_SHORT, "location")


@query(
    """SELECT doc_id, 'PDF.TOUNICODE_GARBLED' AS rule, 'High' AS severity, 3 AS severity_rank, 'FontIntegrity' AS category, least(5, doc_id % 6 + 1)::BIGINT AS n, 'font Times' AS location
FROM documents WHERE doc_id % 6 >= 3 AND doc_id % 16 <> 0"""
)
def garbled_tounicode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    hexadecimal = F.when(F.col("i") <= F.col("doc_id") % 6, F.concat(F.format_string("%04X", F.col("i") + 0xE000), F.lit("0041"))).otherwise("D83DDE0000")
    name = F.when(F.col("doc_id") % 16 == 0, "CMEX10").otherwise("Times")
    return glyphs.garbled_tounicode(docs.select("doc_id", F.lit(0).alias("font_ord"), name.alias("base_name"), hexadecimal.alias("dst_hex"))).select(*_SHORT, "location")


@query(
    """SELECT doc_id, 'FONT.PUA_CMAP' AS rule, 'High' AS severity, 3 AS severity_rank, 'FontIntegrity' AS category, (doc_id % 20)::BIGINT AS n, source AS sample
FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 20 > 10 AND doc_id % 5 <> 0"""
)
def pua_cmaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).alias("font_ord"))
    none = F.lit(None).cast("string")
    fonts = docs.withColumn("family", F.when(F.col("doc_id") % 3 == 0, "Wingdings").otherwise(F.col("source"))).withColumn("full", none).withColumn("postscript", none)
    cmap = docs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("cp", F.when(F.col("i") < F.col("doc_id") % 20, F.col("i") + 0xE000).otherwise(F.col("i") + 65))
    pristine = docs.filter("doc_id % 5 = 0").select("doc_id", "font_ord")
    return glyphs.pua_cmaps(fonts, cmap.select("doc_id", "font_ord", "cp"), pristine).select(*_SHORT, "sample")


# ------------------------------------------------------------ page paint and runs


def page_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """runs, regions, images and media boxes made from conversations: a turn is a run."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text").filter("text is not null").distinct()
    t, key = F.col("turn"), ["doc_id", "page"]
    colour = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    runs = turns.select(
        "doc_id", (t % 2).alias("page"), (t * 10 + 5).alias("op_ord"), F.octet_length("text").cast("long").alias("nbytes"), "text",
        F.when(t % 7 == 3, None).when(t % 5 == 0, colour(1, 1, 1)).when(t % 5 == 1, colour(0.2, 0.2, 0.8)).otherwise(colour(0, 0, 0)).alias("fill"),
        F.when((t % 3 == 2) | (F.col("doc_id") % 9 == 0), 3).otherwise(0).alias("render_mode"), F.when(t % 4 == 3, 1.0).otherwise(10.0).alias("eff_size"),
        (t * 337 % 600 + 5).cast("double").alias("cx"), (t * 491 % 780 + 5).cast("double").alias("cy"), t.alias("turn"),
    )
    regions = runs.filter("turn % 2 = 0 or turn % 3 = 0").select(
        *key, (F.col("op_ord") - 7).alias("op_ord"), F.lit(0).alias("rect_ord"), (F.col("cx") - 300).alias("x0"), (F.col("cy") - 300).alias("y0"),
        (F.col("cx") + 300).alias("x1"), (F.col("cy") + 300).alias("y1"), F.when(F.col("turn") % 4 == 2, None).otherwise(colour(0.21, 0.2, 0.8)).alias("colour"),
    )
    media = runs.select(*key).distinct().select(*key, *[F.lit(float(v)).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 612), ("y1", 792))])
    images = media.filter("doc_id % 9 = 0").select(*key, "x0", "y0", F.lit(590.0).alias("x1"), F.lit(700.0).alias("y1"))
    return runs, regions, images, media


_PAGES = """turns AS (SELECT DISTINCT conv_id AS doc_id, turn, text FROM conversations WHERE text IS NOT NULL), runs AS (
  SELECT doc_id, turn % 2 AS page, turn * 10 + 5 AS op_ord, strlen(text) AS nbytes, turn,
    CASE WHEN turn % 7 = 3 THEN NULL WHEN turn % 5 = 0 THEN [1.0, 1.0, 1.0]::DOUBLE[] WHEN turn % 5 = 1 THEN [0.2, 0.2, 0.8]::DOUBLE[] ELSE [0.0, 0.0, 0.0]::DOUBLE[] END AS fill,
    CASE WHEN turn % 3 = 2 OR doc_id % 9 = 0 THEN 3 ELSE 0 END AS render_mode, CASE WHEN turn % 4 = 3 THEN 1.0 ELSE 10.0 END AS eff_size,
    (turn * 337 % 600 + 5)::DOUBLE AS cx, (turn * 491 % 780 + 5)::DOUBLE AS cy FROM turns
), regions AS (
  SELECT doc_id, page, op_ord - 7 AS op_ord, cx - 300 AS x0, cy - 300 AS y0, cx + 300 AS x1, cy + 300 AS y1,
    CASE WHEN turn % 4 = 2 THEN NULL ELSE [0.21, 0.2, 0.8]::DOUBLE[] END AS colour FROM runs WHERE turn % 2 = 0 OR turn % 3 = 0
), top AS (
  SELECT r.doc_id, r.page, r.op_ord, g.colour, row_number() OVER (PARTITION BY r.doc_id, r.page, r.op_ord ORDER BY g.op_ord DESC) AS k
  FROM runs r JOIN regions g ON r.doc_id = g.doc_id AND r.page = g.page AND g.op_ord < r.op_ord AND r.cx BETWEEN g.x0 AND g.x1 AND r.cy BETWEEN g.y0 AND g.y1
  WHERE (g.x1 - g.x0) * (g.y1 - g.y0) <= 0.9 * 612 * 792
), backed AS (
  SELECT r.*, CASE WHEN t.k IS NULL THEN [1.0, 1.0, 1.0]::DOUBLE[] ELSE t.colour END AS background FROM runs r
  LEFT JOIN top t ON t.k = 1 AND r.doc_id = t.doc_id AND r.page = t.page AND r.op_ord = t.op_ord
), cells AS (
  SELECT DISTINCT doc_id, page FROM runs WHERE doc_id % 9 = 0
), coverage AS (
  SELECT doc_id, page, ((floor(590 / 612.0 * 40) + 1) * (floor(700 / 792.0 * 40) + 1))::DOUBLE / 1600.0::DOUBLE AS coverage FROM cells
), tally AS (
  SELECT b.doc_id, b.page, sum(nbytes)::BIGINT AS total, coalesce(sum(nbytes) FILTER (render_mode IN (3, 7)), 0)::BIGINT AS invisible,
    coalesce(sum(nbytes) FILTER (eff_size < 1.5), 0)::BIGINT AS tiny,
    coalesce(sum(nbytes) FILTER (render_mode NOT IN (3, 7) AND abs(fill[1] - background[1]) < 0.08 AND abs(fill[2] - background[2]) < 0.08
      AND abs(fill[3] - background[3]) < 0.08), 0)::BIGINT AS camouflaged, coalesce(max(c.coverage), 0.0)::DOUBLE AS coverage,
    coalesce(least((max(cx) FILTER (render_mode = 3) - min(cx) FILTER (render_mode = 3)) / 612.0::DOUBLE,
      (max(cy) FILTER (render_mode = 3) - min(cy) FILTER (render_mode = 3)) / 792.0::DOUBLE), 0.0)::DOUBLE AS spread
  FROM backed b LEFT JOIN coverage c USING (doc_id, page) GROUP BY 1, 2
), judged AS (
  SELECT *, invisible > 0 AND coverage >= 0.7 AND invisible / total >= 0.7 AND spread >= 0.5 AS is_scan FROM tally
)"""


def _tallies(spark, sf_dir):
    runs, regions, images, media = page_tables(spark, sf_dir)
    return painter.page_tallies(painter.with_background(runs, regions, media), painter.image_coverage(images, media), media)


@query(f"WITH {_PAGES} SELECT doc_id, page, op_ord, background FROM backed")
def text_backgrounds(spark, sf_dir):
    runs, regions, _, media = page_tables(spark, sf_dir)
    return painter.with_background(runs, regions, media).select("doc_id", "page", "op_ord", "background")


@query(f"WITH {_PAGES} SELECT * FROM judged")
def page_tallies(spark, sf_dir):
    return _tallies(spark, sf_dir)


@query(
    f"""WITH {_PAGES}, d AS (
  SELECT doc_id, sum(camouflaged)::BIGINT AS c, coalesce(sum(tiny) FILTER (NOT is_scan), 0)::BIGINT AS t, coalesce(sum(invisible) FILTER (NOT is_scan), 0)::BIGINT AS i,
    count(*) FILTER (is_scan) AS s, min(page) FILTER (camouflaged > 0) AS cp, min(page) FILTER (tiny > 0 AND NOT is_scan) AS tp,
    min(page) FILTER (invisible > 0 AND NOT is_scan) AS ip FROM judged GROUP BY 1)
SELECT doc_id, 'PDF.INVISIBLE_TEXT_COLOR' AS rule, 'Medium' AS severity, 2 AS severity_rank, 'HiddenContent' AS category, c AS n, cp::VARCHAR AS sample FROM d WHERE c >= 4
UNION ALL SELECT doc_id, 'PDF.TINY_TEXT', 'Medium', 2, 'HiddenContent', t, tp::VARCHAR FROM d WHERE t >= 4
UNION ALL SELECT doc_id, 'PDF.INVISIBLE_RENDER_MODE', 'Medium', 2, 'HiddenContent', i, ip::VARCHAR FROM d WHERE i >= 4
UNION ALL SELECT doc_id, 'PDF.OCR_TEXT_LAYER', 'Info', 0, 'Structural', s, NULL FROM d WHERE s >= 1"""
)
def page_visibility(spark, sf_dir):
    return painter.visibility_findings(_tallies(spark, sf_dir)).select(*_SHORT, "sample")


@query(
    r"""WITH r AS (
  SELECT conv_id AS doc_id, turn, text, length(regexp_replace(text, '[\s\p{Z}]', '', 'g')) AS chars, turn % 4 IN (0, 2) AS pale, CASE turn % 5 WHEN 0 THEN 7 WHEN 1 THEN 8 ELSE 22 END AS sz,
    conv_id % 6 = 0 OR conv_id % 10 = 2 AS shown, CASE WHEN turn % 6 = 5 THEN 1 ELSE 0 END AS v FROM conversations
), d AS (
  SELECT doc_id, coalesce(sum(chars) FILTER (pale AND NOT shown), 0)::BIGINT AS w, coalesce(sum(chars) FILTER (sz < 8), 0)::BIGINT AS t, sum(v)::BIGINT AS v,
    arg_min(text, turn) FILTER (pale AND NOT shown AND chars > 0) AS ws, arg_min(text, turn) FILTER (sz < 8 AND chars > 0) AS ts FROM r GROUP BY 1)
SELECT doc_id, 'DOCX.INVISIBLE_TEXT_COLOR' AS rule, 'High' AS severity, 3 AS severity_rank, 'HiddenContent' AS category, w AS n, substr(ws, 1, 80) AS sample FROM d WHERE w >= 4
UNION ALL SELECT doc_id, 'DOCX.TINY_TEXT', 'High', 3, 'HiddenContent', t, substr(ts, 1, 80) FROM d WHERE t >= 4
UNION ALL SELECT doc_id, 'DOCX.HIDDEN_VANISH', 'Medium', 2, 'HiddenContent', v, NULL FROM d WHERE v >= 1"""
)
def docx_runs(spark, sf_dir):
    t, c = F.col("turn"), F.col("conv_id")
    runs = table(spark, sf_dir, "conversations").select(
        c.alias("doc_id"), t.alias("run_ord"), "text", F.when(t % 4 == 0, "FFFFFF").when(t % 4 == 1, "000000").when(t % 4 == 2, "FFFFCC").otherwise("auto").alias("color"),
        F.when(t % 5 == 0, 7).when(t % 5 == 1, 8).otherwise(22).alias("sz"), F.when(c % 6 == 0, "yellow").when(c % 6 == 1, "none").alias("highlight"),
        F.when(c % 10 == 2, "0000FF").when(c % 10 == 3, "FFFFFF").alias("shd_fill"), F.when(t % 6 == 5, 1).otherwise(0).alias("n_vanish"),
    )
    return docx_rules.run_findings(runs).select(*_SHORT, "sample")


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def docx_body_text(spark, sf_dir):
    runs = table(spark, sf_dir, "conversations").filter("text is not null")
    return docx_rules.body_text(runs.select(F.col("conv_id").alias("doc_id"), F.struct("turn", "text").alias("para_ord"), F.lit(0).alias("run_ord"), "text"))


# ------------------------------------------------------------ extracted against rendered text


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    visual_text = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "(?:ti|on)[a-z]* ", "")).otherwise(F.col("text"))
    return docs.select("doc_id", F.lit(0).alias("page"), F.col("text").alias("extracted"), visual_text.alias("visual"))


_READ = r"""pair AS (
  SELECT doc_id, text AS e, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '(ti|on)[a-z]* ', '', 'g') ELSE text END AS v FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, regexp_split_to_array(lower(e), '[^\pL\pN]+') AS es, list_distinct(list_filter(regexp_split_to_array(lower(v), '[^\pL\pN]+'), lambda x: length(x) >= 2)) AS vw FROM pair
)"""


@query(
    f"""WITH {_READ}, x AS (SELECT doc_id, list_distinct(list_filter(es, lambda x: length(x) >= 2)) AS ew, vw FROM w),
s AS (SELECT doc_id, len(vw) AS k, CASE WHEN len(list_distinct(list_concat(ew, vw))) = 0 THEN 1.0::DOUBLE
  ELSE len(list_intersect(ew, vw))::DOUBLE / len(list_distinct(list_concat(ew, vw)))::DOUBLE END AS similarity FROM x)
SELECT doc_id, 0 AS page, similarity, k >= 5 AND similarity < 0.4 AS diverges FROM s"""
)
def page_divergence(spark, sf_dir):
    return visual.page_divergence(readings(spark, sf_dir))


@query(
    rf"""WITH {_READ}, u AS (SELECT doc_id, unnest(es) AS x, generate_subscripts(es, 1) AS o, vw FROM w),
f AS (SELECT doc_id, x, min(o) AS o FROM u WHERE length(x) >= 4 AND regexp_matches(x, '^\pL+$') AND NOT list_contains(vw, x) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM f)
SELECT doc_id, 0 AS page, string_agg(x, ' ' ORDER BY o) AS words FROM r WHERE r <= 50 GROUP BY 1"""
)
def missing_words(spark, sf_dir):
    return visual.missing(readings(spark, sf_dir)).withColumn("words", F.array_join("words", " "))


@query(
    r"""WITH p AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\pL\pN]+') AS e,
  regexp_split_to_array(lower(CASE WHEN doc_id % 4 = 0 THEN replace(replace(text, ' and ', ' moon '), ' and ', ' moon ') ELSE text END), '[^\pL\pN]+') AS v FROM documents WHERE text IS NOT NULL),
z AS (SELECT doc_id, unnest(e) AS e, unnest(v) AS v FROM p)
SELECT doc_id, e, v, count(*) AS n FROM z WHERE e <> v AND length(e) >= 3 AND length(v) >= 3 GROUP BY 1, 2, 3"""
)
def word_substitutions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    swap = lambda c: F.replace(c, F.lit(" and "), F.lit(" moon "))  # noqa: E731  (twice, for one blank between two of them)
    seen = F.when(F.col("doc_id") % 4 == 0, swap(swap(F.col("text")))).otherwise(F.col("text"))
    pairs = docs.select("doc_id", F.lit(0).alias("page"), F.col("text").alias("extracted"), seen.alias("visual"))
    return visual.substitutions(pairs).groupBy("doc_id", "e", "v").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'Confirmed' WHEN doc_id % 11 >= 9 THEN 'Refuted'
  WHEN doc_id % 5 = 0 THEN 'Confirmed' ELSE 'Unconfirmed' END AS verdict FROM documents"""
)
def verdicts(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", (d % 3 == 0).alias("has_collision"), (d % 5 == 0).alias("canonical"), (d % 7 == 0).alias("diverges"), (d % 11 / 10).alias("similarity"))
    return visual.verdicts(docs)


_READS = f"""{_LETTERS}, reads AS (
  SELECT doc_id, ascii(letter) AS gid, CASE WHEN k = 2 THEN 'x' WHEN doc_id % 29 = 0 AND letter = 'a' THEN 'o' ELSE letter END AS l FROM letter CROSS JOIN (VALUES (0), (1), (2)) t(k)
  WHERE NOT (k = 1 AND doc_id % 2 = 0)
), votes AS (SELECT doc_id, gid, l, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id, gid) AS total FROM reads GROUP BY 1, 2, 3
), vote AS (SELECT doc_id, gid, l AS drawn FROM votes WHERE n * 2 > total)"""


def _votes(spark, sf_dir):
    letters = document_letters(spark, sf_dir).select("doc_id", F.lit(0).alias("font_ord"), F.ascii("letter").alias("gid"), "letter")
    reads = letters.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    seen = F.when(F.col("k") == 2, "x").when((F.col("doc_id") % 29 == 0) & (F.col("letter") == "a"), "o").otherwise(F.col("letter"))
    reads = reads.select("doc_id", "font_ord", "gid", seen.alias("letter"), F.when((F.col("k") == 1) & (F.col("doc_id") % 2 == 0), 50.0).otherwise(90.0).alias("confidence"))
    return visual.glyph_votes(reads), letters


@query(f"WITH {_READS} SELECT doc_id, 0 AS font_ord, gid, drawn FROM vote")
def glyph_votes(spark, sf_dir):
    return _votes(spark, sf_dir)[0]


@query(f"WITH {_READS} SELECT doc_id, drawn, chr(gid) AS claimed, count(*) AS n FROM vote WHERE drawn <> chr(gid) GROUP BY 1, 2, 3")
def specimen_lies(spark, sf_dir):
    votes, letters = _votes(spark, sf_dir)
    return visual.specimen_lies(votes, letters.withColumnRenamed("letter", "claimed"))


_IMAGES = f"""{_LETTERS}, image AS (
  SELECT doc_id, letter AS claimed, CASE WHEN k = 1 AND doc_id % 31 = 0 AND letter = 'd' THEN ascii('m') ELSE ascii(letter) END AS h FROM letter CROSS JOIN (VALUES (0), (1)) t(k)
), per AS (SELECT doc_id, h, count(*) AS n, count(DISTINCT claimed) AS k FROM image GROUP BY 1, 2)"""


def _images(spark, sf_dir):
    letters = document_letters(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    h = F.when((F.col("k") == 1) & (F.col("doc_id") % 31 == 0) & (F.col("letter") == "d"), F.lit(109)).otherwise(F.ascii("letter"))
    return letters.select("doc_id", F.col("letter").alias("claimed"), h.alias("image_hash"))


@query(f"WITH {_IMAGES} SELECT doc_id, sum(n)::BIGINT AS total, count(*) AS distinct_images, count(*) FILTER (k >= 2) AS ambiguous FROM per GROUP BY 1")
def glyph_statistics(spark, sf_dir):
    return visual.glyph_statistics(_images(spark, sf_dir))


@query(
    f"""WITH {_IMAGES} SELECT doc_id, 'GLYPH.SEMANTIC_REPLACEMENT' AS rule, 'High' AS severity, 3 AS severity_rank, 'FontIntegrity' AS category, count(*) AS n, claimed || '→m' AS sample
FROM image JOIN per USING (doc_id, h) WHERE k >= 2 AND h = 109 AND claimed <> 'm' GROUP BY doc_id, claimed"""
)
def glyph_clusters(spark, sf_dir):
    reads = spark.createDataFrame([(109, "m")], "image_hash int, letter string")
    return visual.glyph_clusters(_images(spark, sf_dir), reads).select(*_SHORT, "sample")


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN printf('D:2024%02d15103005+01', doc_id % 12 + 1) WHEN 1 THEN printf('2023%02d31', doc_id % 12 + 1)
  WHEN 2 THEN 'n.d.' ELSE 'D:2022' END AS raw FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN printf('2024-%02d-15 10:30:05', doc_id % 12 + 1) WHEN 1 THEN printf('2023-%02d-31', doc_id % 12 + 1) ELSE raw END AS created FROM d"""
)
def metadata_dates(spark, sf_dir):
    d = F.col("doc_id")
    month = d % 12 + 1
    raw = F.when(d % 4 == 0, F.format_string("D:2024%02d15103005+01", month)).when(d % 4 == 1, F.format_string("2023%02d31", month)).when(d % 4 == 2, "n.d.").otherwise("D:2022")
    return table(spark, sf_dir, "documents").select("doc_id", T.tidy_pdf_date(raw).alias("created"))


# ------------------------------------------------------------ what a reader confirms


@query(
    rf"""WITH {_READ}, u AS (SELECT doc_id, unnest(es) AS x, generate_subscripts(es, 1) AS o, vw FROM w),
f AS (SELECT doc_id, x, min(o) AS o FROM u WHERE length(x) >= 4 AND regexp_matches(x, '^\pL+$') AND NOT list_contains(vw, x) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM f)
SELECT doc_id, 'PDF.HIDDEN_TEXT_CONFIRMED' AS rule, 'High' AS severity, count(*) AS n, string_agg(x, ' ' ORDER BY o) FILTER (r <= 20) AS sample
FROM r WHERE r <= 50 AND doc_id % 2 = 0 GROUP BY 1 HAVING count(*) >= 4"""
)
def hidden_text_confirmed(spark, sf_dir):
    suspects = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id % 2 = 0")
    return visual.hidden_confirmed(readings(spark, sf_dir), suspects).select("doc_id", "rule", "severity", "n", "sample")


@query(
    r"""WITH p AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\pL\pN]+') AS e,
  regexp_split_to_array(lower(replace(replace(text, ' and ', ' moon '), ' and ', ' moon ')), '[^\pL\pN]+') AS v FROM documents WHERE text IS NOT NULL AND doc_id % 8 = 0),
z AS (SELECT doc_id, unnest(e) AS e, unnest(v) AS v FROM p)
SELECT doc_id, 'DOCX.RENDER_DIVERGENCE_CONFIRMED' AS rule, 'High' AS severity, count(*) AS n, 'and→moon' AS sample FROM z WHERE e <> v GROUP BY 1"""
)
def render_divergence_confirmed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    swap = lambda c: F.replace(c, F.lit(" and "), F.lit(" moon "))
    pairs = docs.select("doc_id", F.lit(0).alias("page"), F.col("text").alias("extracted"), swap(swap(F.col("text"))).alias("visual"))
    suspects = docs.select("doc_id").filter("doc_id % 8 = 0")
    pairs = pairs.join(suspects, "doc_id", "left_semi")
    return visual.divergence_confirmed(visual.substitutions(pairs), suspects, "DOCX").select("doc_id", "rule", "severity", "n", "sample")


@query(
    f"""WITH {_READS} SELECT doc_id, 'DOCX.GLYPH_SEMANTIC_REPLACEMENT_OCR' AS rule, 'High' AS severity, count(*) AS n, chr(gid) || '→' || drawn AS sample
FROM vote WHERE drawn <> chr(gid) GROUP BY doc_id, gid, drawn"""
)
def specimen_rule(spark, sf_dir):
    votes, letters = _votes(spark, sf_dir)
    lies = visual.specimen_lies(votes, letters.withColumnRenamed("letter", "claimed"))
    return visual.specimen_findings(lies, "DOCX").select("doc_id", "rule", "severity", "n", "sample")


@query(
    f"""WITH {_PAIRS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'docx' END AS format FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM pair WHERE doc_id NOT IN (SELECT doc_id FROM shifted)) AND doc_id % 5 <> 0"""
)
def escalation(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(d, F.when(d % 5 == 0, "html").when(d % 2 == 0, "pdf").otherwise("docx").alias("format"))
    return visual.to_escalate(docs, glyphs.replacement_findings(_pairs(spark, sf_dir)))


@query(
    r"""WITH p AS (
  SELECT conv_id AS doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: length(x) >= 2)) AS e,
    list_distinct(list_filter(regexp_split_to_array(lower(CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '(ti|on)[a-z]* ', '', 'g') ELSE text END), '[^\pL\pN]+'), lambda x: length(x) >= 2)) AS v
  FROM conversations WHERE text IS NOT NULL
), s AS (
  SELECT doc_id, CASE WHEN len(list_distinct(list_concat(e, v))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(e, v))::DOUBLE / len(list_distinct(list_concat(e, v)))::DOUBLE END AS x, len(v) AS k FROM p
)
SELECT doc_id, round(avg(x), 9) AS similarity, bool_or(k >= 5 AND x < 0.4) AS diverges FROM s GROUP BY 1"""
)
def mean_similarity(spark, sf_dir):
    seen = F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", "(?:ti|on)[a-z]* ", "")).otherwise(F.col("text"))
    pages = table(spark, sf_dir, "conversations").filter("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("text").alias("extracted"), seen.alias("visual"))
    return visual.mean_similarity(visual.page_divergence(pages)).withColumn("similarity", F.round("similarity", 9))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 0 AS page, generate_subscripts(ws, 1)::INTEGER - 1 AS word_ord, unnest(ws) AS word, 100.0::DOUBLE AS confidence FROM w"""
)
def ocr_reads(spark, sf_dir):
    """Reads of pictures by a scripted engine, which finds the text's own bytes in lower case."""
    images = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), F.encode(F.lower("text"), "UTF-8").alias("image"))
    return ocr.read_images(images, ocr.ScriptedEngine(bytes.decode))
