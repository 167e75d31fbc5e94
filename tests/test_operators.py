from pyspark.sql import functions as F

from glyphward.operators import docx_rules, findings, glyphs, html_rules, painter, registry, text_rules, visual
from glyphward.plans import report
from glyphward.schema import RULES


def rules(df):
    return sorted((r["doc_id"], r["rule"], r["n"]) for r in df.collect())


def test_catalogue_is_complete():
    assert len(RULES) == 32


def test_hygiene_boundaries(spark):
    df = spark.createDataFrame([(1, "" * 3), (2, "" * 4), (3, "a​"), (4, "‮"), (5, "clean"), (6, None), (7, "")], "doc_id long, text string")
    assert rules(text_rules.hygiene(df)) == [(2, "UNICODE.PUA", 4), (3, "UNICODE.ZERO_WIDTH", 1), (4, "UNICODE.BIDI_OVERRIDE", 1)]


def test_style_rules(spark):
    css = [(1, "opacity:0.5"), (2, "OPACITY:0"), (3, "margin-left:-9999px"), (4, "a{content: 'x'}"), (5, "font-size:0rem"), (6, "text-indent:-99px"), (7, "display : none;display:none")]
    df = spark.createDataFrame(css, "doc_id long, css string")
    loose = [(r["doc_id"], r["rule"], r["n"], r["sample"]) for r in html_rules.style_findings(df).orderBy("doc_id").collect()]
    assert loose == [
        (1, "HTML.HIDDEN_STYLE", 1, "opacity:0"), (3, "HTML.HIDDEN_STYLE", 1, "off-canvas"), (4, "HTML.CSS_CONTENT_INJECTION", 1, None), (7, "HTML.HIDDEN_STYLE", 2, "display:none"),
    ]
    strict = {r["doc_id"] for r in html_rules.style_findings(df, strict=True).filter("rule = 'HTML.HIDDEN_STYLE'").collect()}
    assert strict == {2, 5, 7}


def test_local_fonts_resolve(spark):
    pages = spark.createDataFrame([(1, "@font-face{src:url(./f/a.ttf)} @font-face{src:url('//cdn/x')}", "/base")], "doc_id long, css string, base_dir string")
    faces = spark.createDataFrame([("/base/f/a.ttf", "A")], "path string, family string")
    assert [r["family"] for r in html_rules.local_fonts(pages, faces).collect()] == ["A"]


def glyph_rows(spark, doc, triples):
    return spark.createDataFrame([(doc, h, c) for h, c, n in triples for _ in range(n)], "doc_id long, outline_hash long, letter string")


def test_collisions_take_the_most_frequent_letter(spark):
    rows = glyph_rows(spark, 1, [(1, "m", 2), (1, "d", 1), (2, "i", 2), (2, "l", 1), (3, "b", 1), (3, "a", 1), (4, "É", 2), (4, "e", 1)])
    pairs = glyphs.collisions(glyphs.letter_mappings(rows))
    assert sorted((r["truth"], r["lie"], r["n"]) for r in pairs.collect()) == [("a", "b", 1), ("m", "d", 1)]


def test_uniform_shift_needs_eight(spark):
    pairs = lambda k: spark.createDataFrame([(k, chr(97 + i), chr(99 + i), 1) for i in range(k)], "doc_id long, truth string, lie string, n long")
    both = pairs(7).unionByName(pairs(8))
    assert [(r["doc_id"], r["shift"]) for r in glyphs.uniform_shift(both).collect()] == [(8, -2)]
    found = rules(glyphs.replacement_findings(both))
    assert [x for x in found if x[0] == 8] == [(8, "PDF.FONT_ENCODING_ARTIFACT", 8)] and len(found) == 8


def test_type0_mapping_skips_glyph_zero(spark):
    to = spark.createDataFrame([(1, 5, 1, 65), (1, 5, 2, 66)], "doc_id long, font_ord int, code int, cp int")
    gid = spark.createDataFrame([(1, 5, 1, 9), (1, 5, 2, 0)], "doc_id long, font_ord int, cid int, gid int")
    out = spark.createDataFrame([(1, 5, 9, 77)], "doc_id long, font_ord int, gid int, outline_hash long")
    assert [(r["cp"], r["outline_hash"]) for r in glyphs.type0_mappings(to, gid, out).collect()] == [(65, 77)]
    wide = spark.createDataFrame([(1, 5, 70000, 65), (1, 5, 65, 65)], "doc_id long, font_ord int, code int, cp int")
    assert [(r["cid"], r["gid"]) for r in glyphs.identity_cid_gid(wide).collect()] == [(65, 65)]


def test_font_rules(spark):
    fonts = spark.createDataFrame([(d, f"{chr(65 + i) * 6}+F", i == 0) for d, k in ((1, 4), (2, 5)) for i in range(k)], "doc_id long, base_name string, has_differences boolean")
    assert rules(glyphs.many_subsets(fonts)) == [(2, "PDF.MANY_SUBSETS", 5)]
    assert len(rules(glyphs.custom_differences(fonts))) == 2
    garbled = spark.createDataFrame([(1, 0, "F", "E000" * 3), (2, 0, "F", "E000" * 4), (3, 0, "CMSY10", "E000" * 9)], "doc_id long, font_ord int, base_name string, dst_hex string")
    assert rules(glyphs.garbled_tounicode(garbled)) == [(2, "PDF.TOUNICODE_GARBLED", 4)]
    cmap = spark.createDataFrame([(d, 0, 0xE000 + i if i < k else i) for d, n, k in ((1, 16, 9), (2, 16, 8), (3, 15, 15), (4, 16, 16)) for i in range(n)], "doc_id long, font_ord int, cp int")
    names = spark.createDataFrame([(1, 0, "F", None, None), (2, 0, "F", None, None), (3, 0, "F", None, None), (4, 0, "Webdings", None, None)], "doc_id long, font_ord int, family string, full string, postscript string")
    assert rules(glyphs.pua_cmaps(names, cmap)) == [(1, "FONT.PUA_CMAP", 9)]
    entries = spark.createDataFrame([(1, 0, 5, 7, "0041"), (1, 0, 1, 9000, "0000")], "doc_id long, font_ord int, code_lo int, code_hi int, dst_hex string")
    assert glyphs.tounicode_map(entries).count() == 3 + 4097


def test_registry(spark):
    known = spark.createDataFrame([("s1", "c1", "P-Reg", "P", "P Reg"), ("s2", "c2", "Q-Reg", "Q", "Q Reg")], "file_sha string, cmap_sha string, postscript string, family string, full string")
    fonts = spark.createDataFrame(
        [(1, 0, "s1", "x", None, None, None), (2, 0, "x", "c1", "p-reg", "Q", None), (3, 0, "x", "c9", None, "q", None), (4, 0, "x", "c1", "Z", "Z", "Z"), (5, 0, None, None, None, None, None)],
        "doc_id long, font_ord int, file_sha string, cmap_sha string, postscript string, family string, full string",
    )
    got = {r["doc_id"]: r["status"] for r in registry.identify(fonts, known).collect()}
    assert got == {1: "Pristine", 2: "KnownVariant", 3: "KnownButCmapModified", 4: "Unidentified", 5: "Unidentified"}
    faces = spark.createDataFrame([(0, "Arial")], "face_ord int, family string")
    outlines = spark.createDataFrame([(0, 100, 1), (0, 109, 2)], "face_ord int, cp int, outline_hash long")
    claims = spark.createDataFrame([(1, "ARIAL", 100, 2), (2, "Arial", 100, 1), (3, "Other", 100, 2), (4, "Arial", 100, 9)], "doc_id long, family string, claimed_cp int, outline_hash long")
    subs = registry.canonical_substitutions(claims, *registry.family_outlines(faces, outlines))
    assert [tuple(r) for r in subs.collect()] == [(1, 100, 109)]
    assert rules(registry.canonical_findings(subs, subs)) == [(1, "PDF.CANONICAL_TAMPER_CONFIRMED", 1)]


def test_background_is_the_latest_small_region(spark):
    black = [0.0, 0.0, 0.0]
    runs = spark.createDataFrame([(1, 1, 10, 50.0, 50.0, black), (1, 1, 20, 50.0, 50.0, black), (1, 1, 30, 500.0, 50.0, black)], "doc_id long, page int, op_ord int, cx double, cy double, fill array<double>")
    regions = spark.createDataFrame(
        [(1, 1, 5, 0, 0.0, 0.0, 100.0, 100.0, [0.0, 0.0, 1.0]), (1, 1, 6, 0, 0.0, 0.0, 612.0, 792.0, [0.5] * 3), (1, 1, 15, 0, 0.0, 0.0, 100.0, 100.0, None)],
        "doc_id long, page int, op_ord int, rect_ord int, x0 double, y0 double, x1 double, y1 double, colour array<double>",
    )
    media = spark.createDataFrame([(1, 1, 0.0, 0.0, 612.0, 792.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    got = {r["op_ord"]: r["background"] for r in painter.with_background(runs, regions, media).collect()}
    assert got == {10: [0.0, 0.0, 1.0], 20: None, 30: [1.0, 1.0, 1.0]}
    off = regions.filter("op_ord = 6").union(spark.createDataFrame([(1, 1, 1, 0, -50.0, -50.0, -10.0, -10.0, None)], regions.schema))
    assert painter.image_coverage(off, media).first()["coverage"] == 1.0


def test_docx_run_rules(spark):
    rows = [
        (1, 0, "abcd", "FFFFFF", 22, None, None, 0), (2, 0, "abc ", "FFFFFF", 22, None, None, 0), (3, 0, "abcd", "FFFFFF", 22, "yellow", None, 0),
        (4, 0, "abcd", "FFFFFF", 22, None, "000000", 0), (5, 0, "abcd", "FFFFFF", 22, None, "auto", 0), (6, 0, "abcd", None, 7, None, None, 0), (7, 0, "abcd", None, 8, None, None, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, run_ord int, text string, color string, sz int, highlight string, shd_fill string, n_vanish int")
    assert rules(docx_rules.run_findings(df)) == [(1, "DOCX.INVISIBLE_TEXT_COLOR", 4), (5, "DOCX.INVISIBLE_TEXT_COLOR", 4), (6, "DOCX.TINY_TEXT", 4), (7, "DOCX.HIDDEN_VANISH", 1)]


def test_votes_need_a_majority(spark):
    reads = spark.createDataFrame(
        [(1, 0, 1, "a", 90.0), (1, 0, 1, "A", 65.0), (1, 0, 1, "x", 90.0), (1, 0, 2, "a", 90.0), (1, 0, 2, "b", 90.0), (1, 0, 3, "a", 64.0), (1, 0, 3, "7", 99.0)],
        "doc_id long, font_ord int, gid int, letter string, confidence double",
    )
    votes = visual.glyph_votes(reads)
    assert [(r["gid"], r["drawn"]) for r in votes.collect()] == [(1, "a")]
    claims = spark.createDataFrame([(1, 0, 1, "o"), (1, 0, 2, "z")], "doc_id long, font_ord int, gid int, claimed string")
    assert rules(visual.specimen_findings(visual.specimen_lies(votes, claims))) == [(1, "PDF.GLYPH_SEMANTIC_REPLACEMENT_OCR", 1)]


def test_confirmation_and_verdicts(spark):
    pairs = spark.createDataFrame([(1, 1, "visible words here ignore previous instructions quietly", "visible words here"), (2, 1, "same text", "same text")], "doc_id long, page int, extracted string, visual string")
    suspects = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert rules(visual.hidden_confirmed(pairs, suspects)) == [(1, "PDF.HIDDEN_TEXT_CONFIRMED", 4)]
    swapped = spark.createDataFrame([(1, 1, "state of delaware law", "state of maryland law")], "doc_id long, page int, extracted string, visual string")
    assert rules(visual.divergence_confirmed(visual.substitutions(swapped), suspects, "DOCX")) == [(1, "DOCX.RENDER_DIVERGENCE_CONFIRMED", 1)]
    v = spark.createDataFrame([(1, True, False, False, 0.95), (2, True, True, False, 0.5), (3, False, True, True, 1.0), (4, True, False, False, None)], "doc_id long, has_collision boolean, canonical boolean, diverges boolean, similarity double")
    got = visual.verdicts(v)
    assert [r["verdict"] for r in got.orderBy("doc_id").collect()] == ["Refuted", "Confirmed", None, "Unconfirmed"]
    pair = spark.createDataFrame([(1, "m", "d", 1), (2, "m", "d", 1)], "doc_id long, truth string, lie string, n long")
    low = visual.refute(glyphs.replacement_findings(pair, "DOCX"), got)
    assert {r["doc_id"]: r["severity"] for r in low.collect()} == {1: "Info", 2: "High"}


def test_best_readings_take_the_last_of_equals(spark):
    phrases = spark.createDataFrame([(1, 0, "pay the dan", "pay the man"), (1, 1, "zzz", "yyy")], "doc_id long, phrase_ord int, extracted string, presumed string")
    seen = spark.createDataFrame([(1, 0, "pay the man"), (1, 1, "Pay the man."), (1, 2, "else")], "doc_id long, sentence_ord int, sentence string")
    assert [r["ocr"] for r in visual.best_readings(phrases, seen).orderBy("phrase_ord").collect()] == ["Pay the man.", None]


def test_assessment_and_report(spark):
    docs = spark.createDataFrame([(1, "" * 4), (2, "clean"), (3, "a​")], "doc_id long, text string")
    found = text_rules.hygiene(docs).unionByName(docx_rules.run_findings(spark.createDataFrame([(3, 0, "x", None, None, None, None, 2)], "doc_id long, run_ord int, text string, color string, sz int, highlight string, shd_fill string, n_vanish int")))
    got = {r["doc_id"]: (r["ok"], r["defaced"], r["hidden_text"], r["max_severity"]) for r in findings.assess(docs, found).collect()}
    assert got == {1: (False, False, False, "High"), 2: (True, False, False, None), 3: (True, False, True, "Medium")}
    assert findings.gate(found).first()["exit_code"] == 1 and findings.gate(found.limit(0)).first()["exit_code"] == 0
    phrases = text_rules.phrases(docs, F.translate("sentence", "c", "k"))
    table = report.reports(docs, found, phrases)
    assert '"presumed":"klean"' in report.as_json(table.filter("doc_id = 2")).first()["report"]
    assert "document 1: NOT OK" in report.as_text(table) and "document 2: OK" in report.as_text(table)


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "" * (i % 7)) for i in range(50)], "doc_id long, text string")
    assert rules(text_rules.hygiene(df)) == rules(text_rules.hygiene(df.repartition(7)))
