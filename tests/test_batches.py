"""What Python workers hold at a time, and how often they decode a file."""

import pyarrow as pa

from glyphward import cli
from glyphward.operators import ocr
from glyphward.plans import decoder_queries as Q
from glyphward.plans.queries import QUERIES
from glyphward.sources import docx, fonts, pdf, registry_json
from glyphward.sources.batches import BYTES, MOST, ROWS, slices
from glyphward.sources.synthetic import write_font

SF = "/root/testdata/sf0.001"


def files(write, n: int, text: str = "a day\nb") -> pa.RecordBatch:
    rows = [{"doc_id": i, "text": text, "source": "s", "lang": "en"} for i in range(n)]
    return pa.RecordBatch.from_pydict({"doc_id": [r["doc_id"] for r in rows], "content": [write(r) for r in rows]})


def test_slices():
    batch = pa.RecordBatch.from_pydict({"x": ["a" * 5, None, "b" * 20, "c", "d", "e"]})
    assert [len(s) for s in slices(batch, "x", rows=2, size=10)] == [2, 1, 2, 1]
    assert pa.Table.from_batches(slices(batch, "x", 2, 10)).column("x").to_pylist() == batch.column("x").to_pylist()
    assert list(slices(batch.slice(0, 0), "x")) == []


def test_a_scan_decodes_packages_once(spark):
    """Decoded rows are read from the shared folder: no rule writes or decodes the files again."""
    inputs = cli.scan(Q.docx_files(spark, SF), Q.known_fonts(spark)).inputFiles()
    assert inputs and not any("documents.parquet" in f for f in inputs)


def test_packages_are_decoded_a_few_at_a_time():
    batch, some = files(Q.write_docx, 1000), []
    for out in docx.decoded_batches(("runs", "cmap"))([batch]):
        some.append((out.num_rows, out.column("kind")[0].as_py()))
    assert max(n for n, _ in some) <= MOST and sum(n for n, k in some if k == "runs") == 2000
    assert len(some) >= 2 * (1000 // ROWS)


def test_documents_become_files_a_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"doc_id": range(40), "text": ["x" * 99_999] * 40, "source": ["s"] * 40, "lang": ["en"] * 40})
    out = list(Q.file_batches(lambda r: r["text"].encode())([batch]))
    assert sum(b.num_rows for b in out) == 40 and max(b.nbytes for b in out) <= 1.1 * BYTES


def test_pdf_files_are_decoded_a_few_at_a_time():
    batch = files(Q.write_page, 600)
    out = list(pdf.decoded_batches(("runs", "tounicode", "metadata"))([batch]))
    assert sum(b.num_rows for b in out if b.column("kind")[0].as_py() == "runs") == 1200
    assert max(b.num_rows for b in out) <= MOST and 3 * 2 <= len(out) < 100  # neither all files nor each by itself


def test_codes_of_one_and_two_bytes():
    entries = [{"code_lo": 65, "code_hi": 66, "dst_hex": "0061"}, {"code_lo": 0x141, "code_hi": 0x141, "dst_hex": "D83DDE00"}]
    fonts_ = {"A": {"tounicode": entries, "type0": False}, "B": {"tounicode": entries, "type0": True}}
    page = pdf.paint(b"/A 1 Tf (AC\x01B) Tj /B 1 Tf <004101410001> Tj <014142> Tj /C 1 Tf (A) Tj", fonts_, (0, 0, 1, 1))
    assert [r["text"] for r in page.runs] == ["aCb", "a\U0001f600", "\U0001f600b", "A"]


def test_reader_takes_common_tokens_at_once():
    r = pdf.Reader(b" 1 0 R 12 -.5 3. +4 /A#42 /Na <414> <4 1> <> true Tj T* 7 0 Rx %c\n(a) 1e3")
    assert [r.value() for _ in range(18)] == [pdf.Ref(1), 12, -0.5, 3.0, 4, "AB", "Na", b"A@", b"A", b"", True, b"Tj", b"T*", 7, 0, b"Rx", b"a", b"1e3"]
    assert r.value() is None


def test_font_files_are_decoded_a_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(1000)], "content": [write_font({c: c for c in "abc"})] * 1000})
    out = list(fonts.face_batches([batch]))
    assert sum(b.num_rows for b in out) == 1000 and max(b.num_rows for b in out) <= ROWS


def test_reads_leave_in_small_batches():
    batch = pa.RecordBatch.from_pydict({"doc_id": range(50), "page": [0] * 50, "image": [b"a bc " * 4000, None] * 25})
    out = list(ocr.read_batches(ocr.ScriptedEngine(bytes.decode))([batch]))
    assert sum(b.num_rows for b in out) == 25 * 8000 and max(b.num_rows for b in out) <= MOST + 8000


def writes_first(df) -> bool:
    """Whether a condition on document ids stands above the first step in Python, so that files are written to be thrown away."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return any("Filter" in line and "%" in line and any("MapInArrow" in x and "content" in x for x in plan[i + 1 : i + 2]) for i, line in enumerate(plan))


def test_only_files_in_use_are_written(spark):
    whole = Q.pdf_files(spark, SF)
    assert writes_first(whole.filter("doc_id % 2 = 0")) and not writes_first(Q.pdf_files(spark, SF, "doc_id % 2 = 0"))
    for name in ("file_metadata", "scan_errors", "fonts_examined"):
        assert not writes_first(QUERIES[name](spark, SF)), name


def test_a_scan_reads_only_the_tables_of_pdf_files_that_it_needs(spark):
    inputs = cli.scan(Q.pdf_files(spark, SF), Q.known_fonts(spark)).inputFiles()
    assert any("/kind=tounicode/" in f for f in inputs) and not any("documents.parquet" in f for f in inputs)


def test_registry_is_read_by_path_and_by_uri(spark, tmp_path):
    faces = fonts.read_fonts(spark.createDataFrame([("a", write_font({c: c for c in "abc"}))], "path string, content binary"))
    registry_json.save(faces, f"file://{tmp_path}/r")
    for path in (f"file://{tmp_path}/r", f"{tmp_path}/r"):
        known, outlines = registry_json.load(spark, path)
        assert (known.count(), outlines.count()) == (1, 3), path


def test_pairs_of_codes_are_read_as_by_the_reader():
    pairs = b"<41> <0042><1>\n<D83DDE00> "
    want = [{"code_lo": 0x41, "code_hi": 0x41, "dst_hex": "0042"}, {"code_lo": 0x10, "code_hi": 0x10, "dst_hex": "D83DDE00"}]
    assert pdf.tounicode_entries(b"2 beginbfchar " + pairs + b"endbfchar") == want == pdf.tounicode_entries(b"2 beginbfchar %c\n" + pairs + b"endbfchar")
    assert pdf.tounicode_entries(b"beginbfchar " + pairs) == []


def test_a_small_font_is_parsed_once():
    data = write_font({c: c for c in "abc"})
    one, other = fonts.parse_faces(data), fonts.parse_faces(bytes(bytearray(data)))
    assert one is not other and one[0] is other[0]
