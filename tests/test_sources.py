import glob
import zipfile
import zlib

import pytest

from glyphward import cli
from glyphward.operators import docx_rules
from glyphward.sources import docx, fonts, html, pdf, registry_json
from glyphward.sources.synthetic import write_font

FONT = next(iter(sorted(glob.glob("/usr/share/fonts/**/*.ttf", recursive=True))), None)


def test_html_tree(spark):
    df = spark.createDataFrame([(1, "<style>p{display:none}</style><p style='left:0'>a &amp; b</p><!-- no -->"), (2, None)], "doc_id long, html string")
    got = {r["doc_id"]: (r["dom_text"], r["css"]) for r in html.read_pages(df).collect()}
    assert got == {1: ("p{display:none} a & b", "p{display:none}\nleft:0"), 2: (None, None)}


def test_docx_round_trip(spark):
    runs = [{"para_ord": 0, "text": "Hidden <text>", "color": "FFFFFF", "sz": 22}, {"para_ord": 1, "text": "tail ", "n_vanish": 1}]
    files = spark.createDataFrame([(1, docx.write_package(runs)), (2, b"no archive"), (3, None)], "doc_id long, content binary")
    got = docx.read_runs(files)
    assert [(r["para_ord"], r["text"], r["color"], r["sz"], r["n_vanish"]) for r in got.orderBy("run_ord").collect()] == [(0, "Hidden <text>", "FFFFFF", 22, 0), (1, "tail ", None, None, 1)]
    assert docx_rules.body_text(got).first()["text"] == "Hidden <text>\ntail "
    assert {r["rule"] for r in docx_rules.run_findings(got).collect()} == {"DOCX.INVISIBLE_TEXT_COLOR", "DOCX.HIDDEN_VANISH"}
    assert {r["doc_id"] for r in docx.read_errors(files).collect()} == {2, 3}


def test_deobfuscation_is_its_own_inverse():
    guid, data = "{00112233-4455-6677-8899-AABBCCDDEEFF}", bytes(range(64))
    for back in (True, False):
        assert docx.deobfuscate(docx.deobfuscate(data, guid, back), guid, back) == data != docx.deobfuscate(data, guid, back)
    assert docx.deobfuscate(data, "short") == data
    assert docx.first_text(b"<a><b>x</b></a>", "b") == "x"


@pytest.mark.skipif(FONT is None, reason="no fonts here")
def test_fonts(spark, tmp_path):
    data = open(FONT, "rb").read()
    face = fonts.parse_faces(data)[0]
    assert face["family"] and face["cmap"][65] and face["outlines"][65] != face["outlines"][66]
    assert fonts.parse_faces(data[:100]) == [] == fonts.parse_faces(b"")
    package = tmp_path / "x.docx"
    key = "{00112233-4455-6677-8899-AABBCCDDEEFF}"
    w, r = 'xmlns:w="w"', 'xmlns:r="r"'
    with zipfile.ZipFile(package, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}/>")
        z.writestr("word/fontTable.xml", f'<w:fonts {w} {r}><w:font w:name="F"><w:embedRegular r:id="i" w:fontKey="{key}"/></w:font></w:fonts>')
        z.writestr("word/_rels/fontTable.xml.rels", '<Relationships><Relationship Id="i" Target="fonts/f.odttf"/></Relationships>')
        z.writestr("word/fonts/f.odttf", docx.deobfuscate(data, key))
    got = docx.read_package(package.read_bytes())["faces"][0]
    assert got["part"] == "word/fonts/f.odttf" and got["parsed"][0]["file_sha"] == face["file_sha"]
    faces, skipped = fonts.build_registry(spark, str(FONT.rpartition("/")[0]))
    assert faces.count() and skipped.count() >= 0


def tiny_pdf(content: bytes, extra: bytes = b"") -> bytes:
    packed = zlib.compress(content)
    cmap = zlib.compress(b"1 beginbfchar <41> <0042> endbfchar 1 beginbfrange <50> <52> <0061> endbfrange 1 beginbfrange <60> <61> [<E000> <E001>] endbfrange")
    return b"".join(
        [
            b"%PDF-1.5\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj\n",
            b"3 0 obj <</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>> endobj\n",
            b"4 0 obj <</Length %d/Filter/FlateDecode>> stream\n" % len(packed), packed, b"\nendstream endobj\n",
            b"5 0 obj <</Type/Font/BaseFont/ABCDEF+Times/ToUnicode 6 0 R/Encoding<</Differences[65/B]>>>> endobj\n",
            b"6 0 obj <</Length %d/Filter/FlateDecode>> stream\n" % len(cmap), cmap, b"\nendstream endobj\n",
            b"7 0 obj <</Title(A \\(b\\))/CreationDate(D:20240115103005)>> endobj\n", extra, b"trailer <</Root 1 0 R/Info 7 0 R>>\n%%EOF",
        ]
    )


CONTENT = b"q 0 0 1 rg 10 10 200 100 re f Q BT /F1 12 Tf 1 0 0 1 20 50 Tm 1 1 1 rg (AP) Tj 3 Tr 0 -20 Td (hidden) Tj ET q 500 0 0 500 0 0 cm /I1 Do Q"


def test_pdf(spark):
    got = pdf.read_file(tiny_pdf(CONTENT))
    page = got["pages"][0]
    assert [(r["text"], r["render_mode"], r["nbytes"]) for r in page.runs] == [("Ba", 0, 2), ("hidden", 3, 6)]
    assert page.regions[0]["colour"] == [0.0, 0.0, 1.0] and page.regions[0]["box"] == (10, 10, 210, 110)
    assert page.images[0]["box"] == (0, 0, 500, 500) and got["metadata"]["Title"] == "A (b)"
    assert got["fonts"][0]["has_differences"] and [e["dst_hex"] for e in got["fonts"][0]["tounicode"]] == ["0042", "0061", "E000", "E001"]
    with pytest.raises(ValueError):
        pdf.read_file(b"nothing")


def test_scan_of_all_formats(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(tiny_pdf(CONTENT))
    (tmp_path / "b.docx").write_bytes(docx.write_package([{"para_ord": 0, "text": "white text", "color": "FFFFFF"}]))
    (tmp_path / "c.html").write_text("<p style='display:none'>x​</p>")
    (tmp_path / "d.txt").write_text("plain")
    files = cli.load_files(spark, [str(tmp_path)])
    found = {r["rule"] for r in cli.scan(files).collect()}
    assert found >= {"PDF.INVISIBLE_RENDER_MODE", "PDF.CUSTOM_DIFFERENCES", "DOCX.INVISIBLE_TEXT_COLOR", "HTML.HIDDEN_STYLE", "UNICODE.ZERO_WIDTH"}
    assert [r["format"] for r in files.orderBy("path").collect()] == ["pdf", "docx", "html", None]


def test_scan_finds_forged_fonts(spark, tmp_path):
    forged, honest = write_font({"a": "a", "b": "b", "d": "b"}), write_font({"a": "a", "b": "b", "d": "d"})
    (tmp_path / "in").mkdir()
    font = b"<</Type/Font/BaseFont/T/FontDescriptor 9 0 R>>"
    objects = b"8 0 obj " + font + b" endobj\n9 0 obj <</FontFile2 10 0 R>> endobj\n10 0 obj <</Length %d>> stream\n" % len(forged) + forged + b"\nendstream endobj\n"
    (tmp_path / "in" / "a.pdf").write_bytes(tiny_pdf(b"BT /F2 12 Tf (bad day.) Tj ET", objects))
    to = b"2 beginbfchar <0002> <0062> <0003> <0064> endbfchar"
    kid = b"11 0 obj <</Type/Font/DescendantFonts[<</FontDescriptor 9 0 R/CIDToGIDMap 12 0 R>>]/ToUnicode 13 0 R>> endobj\n12 0 obj <</Length 8>> stream\n\0\0\0\1\0\2\0\2\nendstream endobj\n"
    kid += b"13 0 obj <</Length %d>> stream\n" % len(to) + to + b"\nendstream endobj\n"
    (tmp_path / "in" / "t.pdf").write_bytes(tiny_pdf(b"", objects.replace(forged, honest).replace(font, b"null") + kid))
    with zipfile.ZipFile(tmp_path / "in" / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>bad day.</w:t></w:r></w:p></w:document>')
        z.writestr("word/fonts/f.odttf", forged)
        z.writestr("word/fonts/g.odttf", b"nothing")
    (tmp_path / "fonts").mkdir()
    (tmp_path / "fonts" / "x.ttf").write_bytes(honest)
    faces, _ = fonts.build_registry(spark, str(tmp_path / "fonts"))
    registry_json.save(faces, str(tmp_path / "known"))
    files = cli.load_files(spark, [str(tmp_path / "in")])
    names = {r["doc_id"]: r["path"].rpartition("/")[2] for r in files.collect()}
    found, phrases, verdicts = cli.examine(files, registry_json.load(spark, str(tmp_path / "known")))
    got = {(names[r["doc_id"]], r["rule"], r["sample"]) for r in found.collect()}
    assert got >= {(f, f"{k}.GLYPH_SEMANTIC_REPLACEMENT", "d→b") for f, k in (("a.pdf", "PDF"), ("t.pdf", "PDF"), ("b.docx", "DOCX"))}
    assert got >= {(f, f"{k}.CANONICAL_TAMPER_CONFIRMED", None) for f, k in (("a.pdf", "PDF"), ("b.docx", "DOCX"))}
    assert ("b.docx", "DOCX.FONT_UNREADABLE", None) in got
    assert {(names[r["doc_id"]], r["verdict"]) for r in verdicts.collect()} == {("a.pdf", "Confirmed"), ("b.docx", "Confirmed"), ("t.pdf", "Unconfirmed")}
    assert {("b.docx", "bad day.", "bab bay.")} <= {(names[r["doc_id"]], r["extracted"], r["presumed"]) for r in phrases.collect()}


def test_pdf_filters_and_errors(spark):
    import base64

    def page(filters: bytes, raw: bytes) -> bytes:
        whole = tiny_pdf(CONTENT)
        old = zlib.compress(CONTENT)
        return whole.replace(b"<</Length %d/Filter/FlateDecode>> stream\n" % len(old) + old, b"<</Length %d/Filter%s>> stream\n" % (len(raw), filters) + raw, 1)

    lzw, n = 0, 0
    for c in [256, *CONTENT[:100], 256, *CONTENT[100:], 257]:
        lzw, n = lzw << 9 | c, n + 9
    packed = (lzw << -n % 8).to_bytes((n + 7) // 8, "big")
    runs = b"".join(bytes([0, c]) for c in CONTENT) + b"\x80"
    for filters, raw in ((b"/ASCII85Decode", base64.a85encode(CONTENT) + b"~>"), (b"/LZWDecode", packed), (b"[/A85/Fl]", base64.a85encode(zlib.compress(CONTENT)) + b"~>"), (b"/RunLengthDecode", runs)):
        got = pdf.read_file(page(filters, raw))
        assert [r["text"] for r in got["pages"][0].runs] == ["Ba", "hidden"] and got["errors"] == [], filters
    assert pdf._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == (bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66]), True)
    cut = page(b"/FlateDecode", zlib.compress(CONTENT + b" %" + bytes(range(256)) * 9)[:-40])
    got = pdf.read_file(cut)
    assert [r["text"] for r in got["pages"][0].runs] == ["Ba", "hidden"] and got["errors"]
    files = spark.createDataFrame([(1, tiny_pdf(CONTENT)), (2, cut), (3, b"nothing"), (4, page(b"/Crypt", b"x"))], "doc_id long, content binary")
    assert {r["doc_id"] for r in pdf.read_errors(files).collect()} == {2, 3, 4}
