"""Word-processor packages: runs, fonts and properties, all from one pass over the archive."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import of_kinds, slices
from .fonts import letter_glyphs, parse_faces

PARTS = re.compile(r"^word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml$")
_OFF = ("false", "0", "off")
_SLOTS = {"embedRegular": "regular", "embedBold": "bold", "embedItalic": "italic", "embedBoldItalic": "boldItalic"}

RUN_SCHEMA = (
    "doc_id long, part string, part_ord int, para_ord int, run_ord int, text string, color string, sz int, highlight string, shd_fill string, "
    "family string, bold boolean, italic boolean, n_vanish int"
)


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _attrs(attrs: dict) -> dict[str, str]:
    return {_local(k): v for k, v in attrs.items()}


def parse_runs(xml: bytes) -> list[dict]:
    """Runs of one part.  All text elements of a run count; a hidden mark outside runs is a run without text."""
    runs: list[dict] = []
    state = {"para": -1, "run": None, "text": False}

    def start(name, attrs):
        tag, a = _local(name), _attrs(attrs)
        run = state["run"]
        if tag == "p":
            state["para"] += 1
        elif tag == "r":
            state["run"] = {"para_ord": state["para"], "text": "", "n_vanish": 0, "bold": False, "italic": False}
        elif tag == "t":
            state["text"] = run is not None
        elif tag == "vanish":
            if run is not None:
                run["n_vanish"] += 1
            else:
                runs.append({"para_ord": state["para"], "text": "", "n_vanish": 1, "bold": False, "italic": False})
        elif run is not None:
            if tag == "color":
                run["color"] = a.get("val")
            elif tag in ("sz", "szCs") and a.get("val", "").isdigit():
                run.setdefault("sz", int(a["val"])) if tag == "szCs" else run.__setitem__("sz", int(a["val"]))
            elif tag == "highlight":
                run["highlight"] = a.get("val")
            elif tag == "shd":
                run["shd_fill"] = a.get("fill")
            elif tag == "rFonts":
                run["family"] = a.get("ascii") or a.get("hAnsi")
            elif tag == "b":
                run["bold"] = a.get("val") not in _OFF
            elif tag == "i":
                run["italic"] = a.get("val") not in _OFF

    def end(name):
        tag = _local(name)
        if tag == "t":
            state["text"] = False
        elif tag == "r" and state["run"] is not None:
            runs.append(state["run"])
            state["run"] = None

    def text(data):
        if state["text"]:
            state["run"]["text"] += data

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.Parse(xml, True)
    for i, run in enumerate(runs):
        run["run_ord"] = i
    return runs


def parse_font_table(xml: bytes) -> list[dict]:
    """family, slot, rid and key of each embedded face."""
    faces: list[dict] = []
    family = [None]

    def start(name, attrs):
        tag, a = _local(name), _attrs(attrs)
        if tag == "font":
            family[0] = a.get("name")
        elif tag in _SLOTS:
            faces.append({"family": family[0], "slot": _SLOTS[tag], "rid": a.get("id"), "key": a.get("fontKey")})

    parser = expat.ParserCreate()
    parser.StartElementHandler = start
    parser.Parse(xml, True)
    return faces


def parse_rels(xml: bytes) -> dict[str, str]:
    out: dict[str, str] = {}

    def start(name, attrs):
        if _local(name) == "Relationship":
            out[attrs.get("Id", "")] = attrs.get("Target", "")

    parser = expat.ParserCreate()
    parser.StartElementHandler = start
    parser.Parse(xml, True)
    return out


def first_text(xml: bytes, tag: str) -> str | None:
    """Text of the first element of that local name, up to the next end tag; null if empty."""
    got: list[str] = []
    state = [0]

    def start(name, attrs):
        if state[0] == 0 and _local(name) == tag:
            state[0] = 1

    def end(name):
        if state[0] == 1:
            state[0] = 2

    def data(value):
        if state[0] == 1:
            got.append(value)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.Parse(xml, True)
    return "".join(got).strip() or None


def deobfuscate(data: bytes, guid: str | None, backwards: bool = True) -> bytes:
    """The first 32 bytes mixed with a 16-byte key; a key that is no GUID changes nothing."""
    digits = re.sub(r"[^0-9A-Fa-f]", "", guid or "")
    if len(digits) != 32:
        return data
    key = bytes.fromhex(digits)
    key = key[::-1] if backwards else key
    return bytes(b ^ key[i % 16] for i, b in enumerate(data[:32])) + data[32:]


def read_package(blob: bytes) -> dict:
    """runs, faces (with the parsed font, if any key opens it) and metadata."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        names = z.namelist()
        runs, part_ord = [], 0
        for name in names:
            if PARTS.match(name):
                for run in parse_runs(z.read(name)):
                    runs.append(run | {"part": name, "part_ord": part_ord})
                part_ord += 1
        faces, keys = [], []
        if "word/fontTable.xml" in names:
            rels = parse_rels(z.read("word/_rels/fontTable.xml.rels")) if "word/_rels/fontTable.xml.rels" in names else {}
            table = parse_font_table(z.read("word/fontTable.xml"))
            keys = [f["key"] for f in table]
            for face in table:
                target = rels.get(face["rid"] or "")
                if not target:
                    continue
                path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("word", target))
                data = z.read(path) if path in names else b""
                # its own key first, then the others, each in both byte orders
                tries = [data] + [deobfuscate(data, k, back) for k in [face["key"], *keys] for back in (True, False)]
                opened, parsed = next(((d, p) for d in tries if (p := parse_faces(d))), (None, []))
                faces.append(face | {"part": path, "parsed": parsed, "program": opened})
        for name in sorted({n for n in names if n.lower().endswith(".odttf")} - {f["part"] for f in faces}):  # no relationship names them
            data = z.read(name)
            tries = [data] + [deobfuscate(data, k, back) for k in keys for back in (True, False)]
            opened, parsed = next(((d, p) for d in tries if (p := parse_faces(d))), (None, []))
            faces.append({"family": None, "slot": None, "rid": None, "key": None, "part": name, "parsed": parsed, "program": opened})
        core = z.read("docProps/core.xml") if "docProps/core.xml" in names else None
        app = z.read("docProps/app.xml") if "docProps/app.xml" in names else None
    tags = {"title": core, "subject": core, "creator": core, "keywords": core, "lastModifiedBy": core, "created": core, "modified": core, "Application": app, "Company": app}
    meta = {k: first_text(x, k) if x else None for k, x in tags.items()}
    return {"runs": runs, "faces": faces, "metadata": meta}


FACES = "doc_id long, font_ord int, part string, parsed boolean, family string, full string, postscript string, file_sha string, cmap_sha string"
GLYPHS = "doc_id long, font_ord int, subtable_ord int, cp int, gid int, outline_hash long"
CMAP = "doc_id long, font_ord int, cp int"
PROGRAMS = "doc_id long, font_ord int, family string, slot string, program binary"
METADATA = "doc_id long, title string, subject string, creator string, keywords string, last_modified_by string, created string, modified string, application string, company string"
_META = ("title", "subject", "creator", "keywords", "lastModifiedBy", "created", "modified", "Application", "Company")
ERRORS = "doc_id long, error string"
TABLES = {"runs": RUN_SCHEMA, "faces": FACES, "glyphs": GLYPHS, "cmap": CMAP, "programs": PROGRAMS, "metadata": METADATA, "errors": ERRORS}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _face_rows(kind: str, doc: int, faces: list[dict]):
    parts = {f["part"]: f["parsed"] for f in faces}
    every = [(part, face) for part, parsed in parts.items() for face in parsed or [None]]
    for k, (part, face) in enumerate(every):
        key = {"doc_id": doc, "font_ord": k}
        if kind == "faces":
            yield (face or {}) | key | {"part": part, "parsed": face is not None}
        elif face and kind == "glyphs":
            yield from (key | g for g in letter_glyphs(face))
        elif face and kind == "cmap":
            yield from (key | {"cp": c} for c in face["cmap"])


def _rows(kind: str, doc: int, got: dict):
    if kind == "runs":
        yield from (r | {"doc_id": doc} for r in got["runs"])
    elif kind == "programs":
        yield from (f | {"doc_id": doc, "font_ord": k} for k, f in enumerate(got["faces"]) if f["family"] and f["program"])
    elif kind == "metadata":
        values = [got["metadata"].get(k) for k in _META]
        if any(v is not None for v in values):
            yield dict(zip([f.split()[0] for f in METADATA.split(", ")], [doc, *values]))
    elif kind != "errors":
        yield from _face_rows(kind, doc, got["faces"])


def _file_rows(kinds: list[str], doc: int, blob: bytes):
    """(kind, row) of a file; one that can't be read has an error row alone."""
    try:
        got = read_package(blob)
    except (zipfile.BadZipFile, expat.ExpatError, KeyError, ValueError, IndexError) as e:
        if "errors" in kinds:
            yield "errors", {"doc_id": doc, "error": f"{type(e).__name__}: {e}"}
        return
    for kind in kinds:
        try:
            for row in _rows(kind, doc, got):
                yield kind, row
        except (KeyError, ValueError, IndexError):  # a glyph that can't be read ends its table
            continue


def decoded_batches(kinds: tuple[str, ...]):
    """What a task does with batches of files (doc_id, content); see ``decode``."""
    columns = {k: [f.split()[0] for f in TABLES[k].split(", ")] for k in kinds}
    types = {n: _ARROW[t] for k in kinds for n, t in (f.split() for f in TABLES[k].split(", "))}

    def run(batches):
        for batch in batches:
            for some in slices(batch, "content"):
                pairs = zip(some.column("doc_id").to_pylist(), some.column("content").to_pylist())
                yield from of_kinds((x for doc, blob in pairs for x in _file_rows(list(kinds), doc, blob or b"")), columns, types)

    return run


def decode(files: DataFrame, kinds: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
    """The rows of all these tables of files (doc_id, content), told apart by ``kind``: each file is parsed once."""
    fields = {n: t for k in kinds for n, t in (f.split() for f in TABLES[k].split(", "))}
    return files.select("doc_id", "content").mapInArrow(decoded_batches(kinds), "kind string, " + ", ".join(f"{n} {t}" for n, t in fields.items()))


def table_of(decoded: DataFrame, kind: str) -> DataFrame:
    """One of TABLES, of what ``decode`` gives."""
    return decoded.filter(F.col("kind") == kind).select(*[f.split()[0] for f in TABLES[kind].split(", ")])


def read_runs(files: DataFrame) -> DataFrame:
    """RUN_SCHEMA of files (doc_id, content).  A file that can't be read has no runs; see ``read_errors``."""
    return table_of(decode(files, ("runs",)), "runs")


def read_faces(files: DataFrame, kind: str) -> DataFrame:
    """One of the tables faces, glyphs, cmap of the fonts embedded in files (doc_id, content); each part counts once."""
    return table_of(decode(files, (kind,)), kind)


def read_programs(files: DataFrame) -> DataFrame:
    """PROGRAMS: the font programs, opened, of files (doc_id, content) that the font table names."""
    return table_of(decode(files, ("programs",)), "programs")


def read_metadata(files: DataFrame) -> DataFrame:
    """METADATA of files (doc_id, content) that say anything about themselves; one that says nothing has no row."""
    return table_of(decode(files, ("metadata",)), "metadata")


def read_errors(files: DataFrame) -> DataFrame:
    """doc_id, error of files that can't be read."""
    return table_of(decode(files, ("errors",)), "errors")


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def write_package(runs: list[dict], fonts: list[tuple[str, str, bytes]] = (), core: dict[str, str] | None = None) -> bytes:
    """A minimal package of runs (para_ord, text, color, sz, highlight, shd_fill, n_vanish), of embedded fonts (family, key,
    program, obfuscated by a key that is not empty) and of core properties, as fixtures need."""
    from xml.sax.saxutils import escape, quoteattr

    body, para = [], None
    for r in runs:
        if r.get("para_ord") != para:
            body.append("</w:p><w:p>" if para is not None else "<w:p>")
            para = r.get("para_ord")
        props = "".join(
            f"<w:{tag} w:{attr}={quoteattr(str(r[k]))}/>" for k, tag, attr in (("color", "color", "val"), ("sz", "sz", "val"), ("highlight", "highlight", "val"), ("shd_fill", "shd", "fill")) if r.get(k) is not None
        )
        props += "<w:vanish/>" * (r.get("n_vanish") or 0)
        body.append(f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{escape(r.get("text") or "")}</w:t></w:r>')
    xml = f"<w:document {_W}><w:body>{''.join(body)}{'</w:p>' if para is not None else ''}</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
        if fonts:
            names = [f"<w:font w:name={quoteattr(f)}><w:embedRegular r:id=\"i{k}\" w:fontKey={quoteattr(key)}/></w:font>" for k, (f, key, _) in enumerate(fonts)]
            z.writestr("word/fontTable.xml", f'<w:fonts {_W} xmlns:r="r">{"".join(names)}</w:fonts>')
            links = [f'<Relationship Id="i{k}" Target="fonts/f{k}.odttf"/>' for k in range(len(fonts))]
            z.writestr("word/_rels/fontTable.xml.rels", f"<Relationships>{''.join(links)}</Relationships>")
            for k, (_, key, data) in enumerate(fonts):
                z.writestr(f"word/fonts/f{k}.odttf", deobfuscate(data, key) if key else data)
        if core:
            fields = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in core.items())
            z.writestr("docProps/core.xml", f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d">{fields}</cp:coreProperties>')
    return out.getvalue()
