"""Writers of small fonts and PDF files, for fixtures and for queries that need files to decode."""

from __future__ import annotations

import struct
import zlib


def write_font(drawn: dict[str, str], family: str = "Tiny") -> bytes:
    """A TrueType face whose characters (keys) show the outlines of characters (values)."""
    names = sorted(set(drawn.values()))
    points = [struct.pack(">5hHH3B6h", 1, 0, 0, 900, 900, 2, 0, 1, 1, 1, 0, ord(c) % 30_000, 7, 0, 5, ord(c) % 30_000) + b"\0" for c in names]
    loca = struct.pack(f">{len(points) + 2}I", 0, *(sum(map(len, points[:k])) for k in range(len(points) + 1)))
    pairs = b"".join(struct.pack(">III", ord(c), ord(c), 1 + names.index(d)) for c, d in sorted(drawn.items()))
    cmap = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIII", 12, 0, 16 + len(pairs), 0, len(drawn)) + pairs
    label = family.encode("utf-16-be")
    name = struct.pack(">9H", 0, 1, 18, 3, 1, 0, 1, len(label), 0) + label
    tables = {b"cmap": cmap, b"glyf": b"".join(points), b"head": bytes(50) + b"\0\1\0\0", b"loca": loca, b"maxp": struct.pack(">IH", 0x10000, len(names) + 1), b"name": name}
    at, head, body = 12 + 16 * len(tables), b"", b""
    for tag, t in tables.items():
        head += struct.pack(">4sIII", tag, 0, at + len(body), len(t))
        body += t
    return b"\0\1\0\0" + struct.pack(">4H", len(tables), 0, 0, 0) + head + body


def _stream(number: int, data: bytes, entries: bytes = b"") -> bytes:
    packed = zlib.compress(data)
    return b"%d 0 obj <</Length %d/Filter/FlateDecode%s>> stream\n" % (number, len(packed), entries) + packed + b"\nendstream endobj\n"


def _literal(text: str) -> bytes:
    raw = text.encode("latin-1") if all(ord(c) < 128 for c in text) else b"\xfe\xff" + text.encode("utf-16-be")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def write_pdf(lines: list[dict], base_name: str = "ABCDEF+Body", garbled: int = 0, differences: bool = False, subsets: int = 0, program: bytes = b"", info: dict[str, str] | None = None) -> bytes:
    """One page of lines (text, render_mode, size, fill as three numbers) in a font of two-byte codes, its ToUnicode map, and
    what else a file may have: map entries that lead to private-use characters, an encoding with differences, fonts of further
    subset tags, a simple font with an embedded program, document information."""
    chars = sorted({c for x in lines for c in x["text"]})
    code = {c: k + 1 for k, c in enumerate(chars)}
    digits = {c: f"{n:04X}" for c, n in code.items()}
    shown = []
    for k, x in enumerate(lines):
        codes = "".join([digits[c] for c in x["text"]]).encode()
        r, g, b = x.get("fill", (0, 0, 0))
        shown.append(b"BT /F1 %g Tf 1 0 0 1 20 %d Tm %g %g %g rg %d Tr <%s> Tj ET" % (x.get("size", 12), 700 - k % 600, r, g, b, x.get("render_mode", 0), codes))
    entries = [f"<{n:04X}> <{c.encode('utf-16-be').hex()}>" for c, n in code.items()] + [f"<{len(code) + 1 + k:04X}> <{0xE000 + k:04X}>" for k in range(garbled)]
    to = "".join(f"{len(entries[i : i + 100])} beginbfchar {' '.join(entries[i : i + 100])} endbfchar\n" for i in range(0, len(entries), 100))
    more = b"/Encoding<</Differences[65/B]>>" if differences else b""
    parts = [
        b"%PDF-1.5\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj\n",
        b"3 0 obj <</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>> endobj\n",
        _stream(4, b"\n".join(shown)),
        b"5 0 obj <</Type/Font/Subtype/Type0/BaseFont/%s/ToUnicode 6 0 R/DescendantFonts[]%s>> endobj\n" % (base_name.encode(), more),
        _stream(6, to.encode()),
    ]
    for k in range(subsets):
        parts.append(b"%d 0 obj <</Type/Font/BaseFont/AAAA%c%c+Many>> endobj\n" % (100 + k, 65 + k // 26, 65 + k % 26))
    if program:
        parts.append(b"8 0 obj <</Type/Font/BaseFont/T/FontDescriptor 9 0 R>> endobj\n9 0 obj <</FontFile2 10 0 R>> endobj\n" + _stream(10, program))
    fields = b"".join(b"/%s%s" % (k.encode(), _literal(v)) for k, v in (info or {}).items())
    parts.append(b"7 0 obj <<%s>> endobj\ntrailer <</Root 1 0 R/Info 7 0 R>>\n%%%%EOF" % fields)
    return b"".join(parts)
