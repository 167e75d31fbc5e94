"""PDF files: objects, fonts, character maps and each page's paint order, without a PDF library.

Objects are found by scanning for their headers (so damaged cross-reference tables don't matter) and by unpacking object
streams.  The page interpreter keeps a graphics state and emits text runs, painted rectangles and images in order.  It is an
approximation: the text position does not advance with shown text, forms are taken for images of the unit square, and
transparency is not looked at.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import of_kinds, slices
from .fonts import letter_glyphs, parse_faces

_HEADER = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_WHITE = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_BLANK = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*+")
#: The common tokens at once: a string of hexadecimal digits, a name without codes, an integer, a number with a point, letters.
_TOKEN = re.compile(
    rb"[\x00\t\n\x0c\r ]*+(?:<([0-9A-Fa-f]++)>|/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]++)(?!#)"
    rb"|([+-]?\d++)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])|([+-]?\d*\.\d++)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])|([A-Za-z]++)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%]))"
)
_PAIRS = re.compile(rb"((?:[\x00\t\n\x0c\r ]*+<[0-9A-Fa-f]++>[\x00\t\n\x0c\r ]*+<[0-9A-Fa-f]++>)*+)[\x00\t\n\x0c\r ]*+endbfchar(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_DIGITS = re.compile(rb"[0-9A-Fa-f]+")
_BOOLEANS = {b"true": True, b"false": False}
_INTEGER = re.compile(rb"[+-]?\d+")
_REAL = re.compile(rb"[+-]?\d*\.?\d*")
_REFERENCE = re.compile(rb"\s+(\d+)\s+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_NO_DIGITS = re.compile(rb"[^0-9A-Fa-f]")
_NAME_CODE = re.compile(rb"#([0-9A-Fa-f]{2})")
_ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\f"}
MAX_RANGE = 4097


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    pass


@dataclass
class Stream:
    dict: dict
    raw: bytes


class Reader:
    """Objects and operators of a byte string."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        if self.at < len(self.data):
            self.at = _BLANK.match(self.data, self.at).end()

    def value(self):
        """The next object, an operator as bytes, or None at the end."""
        d = self.data
        m = _TOKEN.match(d, self.at)
        if m:
            self.at = m.end()
            kind = m.lastindex
            word = m.group(kind)
            if kind == 1:
                return bytes.fromhex((word + b"0" * (len(word) % 2)).decode())
            if kind == 2:
                return Name(word.decode("latin-1"))
            if kind == 3:
                r = _REFERENCE.match(d, self.at) if word.isdigit() else None
                if r:
                    self.at = r.end()
                    return Ref(int(word))
                return int(word)
            return float(word) if kind == 4 else _BOOLEANS.get(word, word)
        self.skip()
        if self.at >= len(d):
            return None
        c = d[self.at : self.at + 1]
        if d[self.at : self.at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                self.skip()
                if d[self.at : self.at + 2] == b">>" or self.at >= len(d):
                    self.at += 2
                    return out
                key = self.value()
                value = self.value()
                if isinstance(key, Name):
                    out[str(key)] = value
        if c == b"[":
            self.at += 1
            items = []
            while True:
                self.skip()
                if d[self.at : self.at + 1] in (b"]", b""):
                    self.at += 1
                    return items
                items.append(self.value())
        if c == b"(":
            return self._string()
        if c == b"<":
            end = d.find(b">", self.at)
            end = len(d) if end < 0 else end
            digits = _NO_DIGITS.sub(b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            m = _WORD.match(d, self.at + 1)
            raw = m.group(0) if m else b""
            self.at += 1 + len(raw)
            return Name((_NAME_CODE.sub(lambda x: bytes([int(x.group(1), 16)]), raw) if b"#" in raw else raw).decode("latin-1"))
        m = _WORD.match(d, self.at)
        if not m:
            self.at += 1
            return d[self.at - 1 : self.at]
        word = m.group(0)
        self.at = m.end()
        if _INTEGER.fullmatch(word):
            r = _REFERENCE.match(d, self.at)
            if r and word.isdigit():
                self.at = r.end()
                return Ref(int(word))
            return int(word)
        try:
            return float(word) if _REAL.fullmatch(word) and word.strip(b"+-.") else _BOOLEANS.get(word, word)
        except ValueError:
            return word

    def _string(self) -> bytes:
        d, out, depth = self.data, bytearray(), 0
        i = self.at
        while i < len(d):
            c = d[i]
            if c == 0x5C:
                i += 1
                e = d[i] if i < len(d) else 0
                if e in _ESCAPES:
                    out += _ESCAPES[e]
                elif 0x30 <= e <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(d, i)
                    out.append(int(m.group(0), 8) & 255)
                    i += len(m.group(0)) - 1
                elif e == 0x0D and d[i + 1 : i + 2] == b"\n":
                    i += 1
                elif e not in b"\r\n":
                    out.append(e)
            elif c == 0x28:
                depth += 1
                if depth > 1:
                    out.append(c)
            elif c == 0x29:
                depth -= 1
                if depth == 0:
                    i += 1
                    break
                out.append(c)
            else:
                out.append(c)
            i += 1
        self.at = i
        return bytes(out)


def _inflate(raw: bytes) -> tuple[bytes, bool]:
    """What could be inflated up to the first error, and whether that is all."""
    best = b""
    try:
        d = zlib.decompressobj()
        return d.decompress(raw) + d.flush(), d.eof
    except zlib.error:  # piece by piece, up to the error
        pass
    for bits, data in ((15, raw), (-15, raw[2:])):
        d, out = zlib.decompressobj(bits), bytearray()
        try:
            for i in range(0, len(data), 64):
                out += d.decompress(data[i : i + 64])
            return bytes(out + d.flush()), d.eof
        except zlib.error:
            for k in range(i, min(i + 64, len(data))):  # of the piece with the error, byte by byte
                try:
                    if k == i:
                        d = zlib.decompressobj(bits)
                        out = bytearray(d.decompress(data[:i]))
                    out += d.decompress(data[k : k + 1])
                except zlib.error:
                    break
            best = max(best, bytes(out), key=len)
    return best, False


def _ascii85(raw: bytes) -> tuple[bytes, bool]:
    body, mark, _ = raw.partition(b"~>")
    out, held = bytearray(), []
    for c in body.removeprefix(b"<~"):
        if c == 0x7A and not held:
            out += bytes(4)
        elif 33 <= c <= 117:
            held.append(c - 33)
            if len(held) == 5:
                out += (sum(v * 85 ** (4 - k) for k, v in enumerate(held)) & 0xFFFFFFFF).to_bytes(4, "big")
                held = []
        elif c not in _WHITE:
            return bytes(out), False
    if held:
        full = held + [84] * (5 - len(held))
        out += (sum(v * 85 ** (4 - k) for k, v in enumerate(full)) & 0xFFFFFFFF).to_bytes(4, "big")[: len(held) - 1]
    return bytes(out), bool(mark)


def _lzw(raw: bytes, early: int = 1) -> tuple[bytes, bool]:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, before, width, held, n = bytearray(), b"", 9, 0, 0
    for byte in raw:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            return bytes(out), True
        if code == 256:
            del table[258:]
            before, width = b"", 9
            continue
        if code > len(table) or (code == len(table) and not before):
            return bytes(out), False
        now = table[code] if code < len(table) else before + before[:1]
        out += now
        if before and len(table) < 4096:
            table.append(before + now[:1])
        before = now
        width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out), False


def _run_length(raw: bytes) -> tuple[bytes, bool]:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n == 128:
            return bytes(out), True
        out += raw[i + 1 : i + 2 + n] if n < 128 else raw[i + 1 : i + 2] * (257 - n)
        i += 2 + n if n < 128 else 2
    return bytes(out), False


class File:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF header")
        m = re.search(rb"%PDF-(\d\.\d)", data[:1024])
        self.version = m.group(1).decode() if m else None
        self.objects: dict[int, object] = {}
        self.info: object = None
        self.errors: list[str] = []
        for m in _HEADER.finditer(data):
            r = Reader(data, m.end())
            value = r.value()
            r.skip()
            if isinstance(value, dict) and data[r.at : r.at + 6] == b"stream":
                a = r.at + 6
                a += 2 if data[a : a + 2] == b"\r\n" else 1
                size = value.get("Length")
                if not (isinstance(size, int) and data[a + size : a + size + 20].lstrip(_WHITE).startswith(b"endstream")):
                    end = data.find(b"endstream", a)
                    size = (end if end >= 0 else len(data)) - a
                value = Stream(value, data[a : a + size])
            self.objects[int(m.group(1))] = value
        for number in [n for n, o in self.objects.items() if isinstance(o, Stream) and o.dict.get("Type") == "ObjStm"]:
            self._unpack(self.objects[number])
        for m in re.finditer(rb"trailer", data):
            t = Reader(data, m.end()).value()
            if isinstance(t, dict) and "Info" in t:
                self.info = t["Info"]
        for o in list(self.objects.values()):
            if isinstance(o, Stream) and o.dict.get("Type") == "XRef" and "Info" in o.dict:
                self.info = o.dict["Info"]

    def _unpack(self, s: Stream) -> None:
        body = self.decoded(s)
        first, n = self.get(s.dict.get("First")), self.get(s.dict.get("N"))
        if not isinstance(first, int) or not isinstance(n, int):
            return
        head = Reader(body)
        for number, at in [(head.value(), head.value()) for _ in range(n)]:
            if isinstance(number, int) and isinstance(at, int) and number not in self.objects:
                self.objects[number] = Reader(body, first + at).value()

    def get(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def at(self, value, *keys):
        for k in keys:
            value = self.get(value)
            value = value.dict if isinstance(value, Stream) else value
            value = value.get(k) if isinstance(value, dict) else None
        return self.get(value)

    def decoded(self, s: Stream) -> bytes:
        filters = self.get(s.dict.get("Filter")) or []
        raw = s.raw
        for k, f in enumerate(filters if isinstance(filters, list) else [filters]):
            f = self.get(f)
            whole = True
            if f in ("FlateDecode", "Fl"):
                raw, whole = _inflate(raw)
            elif f in ("ASCII85Decode", "A85"):
                raw, whole = _ascii85(raw)
            elif f in ("LZWDecode", "LZW"):
                parms = self.get(s.dict.get("DecodeParms"))
                early = self.at(parms[k] if isinstance(parms, list) and k < len(parms) else parms, "EarlyChange")
                raw, whole = _lzw(raw, 0 if early == 0 else 1)
            elif f in ("RunLengthDecode", "RL"):
                raw, whole = _run_length(raw)
            elif f in ("ASCIIHexDecode", "AHx"):
                raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0]).decode())
            else:
                self.errors.append(f"filter {f} is not decoded")
                return b""
            if not whole:
                self.errors.append(f"{f} data end early or are damaged")
        return raw

    # -- fonts

    def fonts(self) -> list[dict]:
        """Font dictionaries in order of object number, descendants of composite fonts left to their parents."""
        out = []
        kids = set()
        found = sorted((n, o) for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "Font")
        for _, f in found:
            for d in self.get(f.get("DescendantFonts")) or []:
                if isinstance(d, Ref):
                    kids.add(d.number)
        for number, f in found:
            if number in kids:
                continue
            base = self.get(f.get("BaseFont"))
            kid = (self.get(f.get("DescendantFonts")) or [None])[0]
            descriptor = self.at(f, "FontDescriptor") or self.at(kid, "FontDescriptor")
            program = next((p for p in (self.at(descriptor, k) for k in ("FontFile2", "FontFile3", "FontFile")) if isinstance(p, Stream)), None)
            to = self.get(f.get("ToUnicode"))
            cid = self.at(kid, "CIDToGIDMap")
            out.append(
                {
                    "font_ord": number,
                    "base_name": str(base) if base else "",
                    "type0": kid is not None,
                    "has_differences": isinstance(self.at(f, "Encoding", "Differences"), list),
                    "program": self.decoded(program) if program else None,
                    "tounicode": tounicode_entries(self.decoded(to)) if isinstance(to, Stream) else [],
                    "cid_gid": self.decoded(cid) if isinstance(cid, Stream) else None,
                }
            )
        return out

    def metadata(self) -> dict[str, str | None]:
        info = self.get(self.info)
        info = info if isinstance(info, dict) else {}
        keys = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
        return {k: text_string(v) if isinstance(v := self.get(info.get(k)), bytes) else None for k in keys} | {"version": self.version}

    # -- pages

    def pages(self) -> list[dict]:
        roots = [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Pages" and "Parent" not in o]
        out: list[dict] = []

        def walk(node, depth):
            node = self.get(node)
            if not isinstance(node, dict) or depth > 64:
                return
            if node.get("Type") == "Page":
                out.append(node)
            for kid in self.get(node.get("Kids")) or []:
                walk(kid, depth + 1)

        for root in roots:
            walk(root, 0)
        return out or [o for _, o in sorted((n, o) for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "Page")]


def text_string(raw: bytes) -> str:
    return (raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")).strip("\x00 ")


def tounicode_entries(cmap: bytes) -> list[dict]:
    """code_lo, code_hi and dst_hex of each bfchar and bfrange entry; an array gives an entry per code."""
    out = []
    r, held = Reader(cmap), []
    while (v := r.value()) is not None:
        if v in (b"beginbfchar", b"beginbfrange"):
            held = []
            m = _PAIRS.match(cmap, r.at) if v == b"beginbfchar" else None
            if m:  # nothing but pairs of codes up to the end: all at once
                digits = [x + b"0" * (len(x) % 2) for x in _DIGITS.findall(m.group(1))]
                codes = [int(x, 16) for x in digits[::2]]
                out += [{"code_lo": c, "code_hi": c, "dst_hex": x.decode().upper()} for c, x in zip(codes, digits[1::2])]
                r.at = m.end()
        elif v in (b"endbfchar", b"endbfrange"):
            step = 2 if v == b"endbfchar" else 3
            for k in range(0, len(held) - step + 1, step):
                lo = int.from_bytes(held[k], "big")
                hi = lo if step == 2 else int.from_bytes(held[k + 1], "big")
                dst = held[k + step - 1]
                if isinstance(dst, list):
                    out += [{"code_lo": lo + i, "code_hi": lo + i, "dst_hex": d.hex().upper()} for i, d in enumerate(dst[: hi - lo + 1]) if isinstance(d, bytes)]
                elif isinstance(dst, bytes):
                    out.append({"code_lo": lo, "code_hi": hi, "dst_hex": dst.hex().upper()})
            held = []
        elif isinstance(v, (bytes, list)):
            held.append(v)
    return out


def decoder(font: dict) -> tuple[int, dict[int, str]]:
    """Bytes a code takes, and the characters of codes."""
    table: dict[int, str] = {}
    for e in font["tounicode"]:
        raw = bytes.fromhex(e["dst_hex"])
        for k, code in enumerate(range(e["code_lo"], min(e["code_hi"], e["code_lo"] + MAX_RANGE - 1) + 1)):
            if len(raw) >= 2:
                last = int.from_bytes(raw[-2:], "big") + k
                table[code] = (raw[:-2] + (last & 0xFFFF).to_bytes(2, "big")).decode("utf-16-be", "replace")
    return 2 if font["type0"] else 1, table


# ---------------------------------------------------------------- painting

Matrix = tuple[float, float, float, float, float, float]
_UNIT: Matrix = (1, 0, 0, 1, 0, 0)


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b (row vectors)."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2],
        a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def box(m: Matrix, x: float, y: float, w: float, h: float) -> tuple[float, float, float, float]:
    xs, ys = zip(*[(px * m[0] + py * m[2] + m[4], px * m[1] + py * m[3] + m[5]) for px, py in ((x, y), (x + w, y), (x, y + h), (x + w, y + h))])
    return min(xs), min(ys), max(xs), max(ys)


@dataclass
class State:
    ctm: Matrix = _UNIT
    size: float = 0.0
    mode: int = 0
    fill: tuple[float, float, float] | None = (0.0, 0.0, 0.0)
    font: str | None = None


@dataclass
class Painted:
    media: tuple[float, float, float, float]
    runs: list[dict] = field(default_factory=list)
    regions: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)


def paint(content: bytes, fonts: dict[str, dict], media: tuple[float, float, float, float]) -> Painted:
    """Runs, regions and images of a page's content in paint order."""
    out = Painted(media)
    state, stack, args, rects = State(), [], [], []
    tm = line = _UNIT
    leading, order = 0.0, 0
    decoders = {k: decoder(f) for k, f in fonts.items()}
    single: dict[str | None, list[str]] = {}  # characters of one-byte codes, of fonts in use
    r = Reader(content)

    def number(i: int, default: float = 0.0) -> float:
        return float(args[i]) if -len(args) <= i < len(args) and isinstance(args[i], (int, float)) else default

    def show(raw: bytes) -> None:
        if not raw:
            return
        m = multiply(tm, state.ctm)
        scale = (m[2] ** 2 + m[3] ** 2) ** 0.5
        width, table = decoders.get(state.font or "", (1, {}))
        if width == 1:
            if state.font not in single:
                single[state.font] = [table.get(c) or (chr(c) if 32 <= c < 127 else "") for c in range(256)]
            text = "".join(map(single[state.font].__getitem__, raw))
        else:  # codes of two bytes; a byte left over is a code by itself
            codes = struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) & ~1]) + (tuple(raw[-1:]) if len(raw) % 2 else ())
            text = "".join([table.get(c, "") for c in codes])
        x0, y0, x1, y1 = box(m, 0, 0, len(raw) * 0.5 * state.size, state.size)
        out.runs.append(
            {
                "op_ord": order, "nbytes": len(raw), "text": text, "fill": list(state.fill) if state.fill else None, "render_mode": state.mode,
                "eff_size": abs(state.size * scale), "cx": (x0 + x1) / 2, "cy": (y0 + y1) / 2,
            }
        )

    while (v := r.value()) is not None:
        if not isinstance(v, bytes) or r.data[r.at - 1 : r.at] in (b")", b">"):
            args.append(v)
            continue
        order += 1
        op = v.decode("latin-1")
        if op == "q":
            stack.append(replace(state))
        elif op == "Q" and stack:
            state = replace(stack.pop(), font=state.font)
        elif op == "cm" and len(args) >= 6:
            state.ctm = multiply(tuple(number(i) for i in range(-6, 0)), state.ctm)
        elif op == "BT":
            tm = line = _UNIT
        elif op == "Tf":
            state.font, state.size = (str(args[-2]) if len(args) > 1 else None), number(-1)
        elif op == "Tr":
            state.mode = int(number(-1))
        elif op == "TL":
            leading = number(-1)
        elif op == "Tm" and len(args) >= 6:
            tm = line = tuple(number(i) for i in range(-6, 0))
        elif op in ("Td", "TD"):
            tm = line = multiply((1, 0, 0, 1, number(-2), number(-1)), line)
            leading = -number(-1) if op == "TD" else leading
        elif op in ("T*", "'", '"'):
            tm = line = multiply((1, 0, 0, 1, 0, -leading), line)
            if op != "T*" and args and isinstance(args[-1], bytes):
                show(args[-1])
        elif op == "Tj" and args and isinstance(args[-1], bytes):
            show(args[-1])
        elif op == "TJ" and args and isinstance(args[-1], list):
            show(b"".join(x for x in args[-1] if isinstance(x, bytes)))
        elif op == "g":
            state.fill = (number(-1),) * 3
        elif op == "rg":
            state.fill = (number(-3), number(-2), number(-1))
        elif op == "k":
            black = 1 - number(-1)
            state.fill = tuple((1 - number(i)) * black for i in (-4, -3, -2))
        elif op in ("sc", "scn", "cs"):
            state.fill = None
        elif op == "re" and len(args) >= 4:
            rects.append(box(state.ctm, *(number(i) for i in range(-4, 0))))
        elif op in ("f", "F", "f*", "B", "B*", "b", "b*"):
            for k, b in enumerate(rects):
                out.regions.append({"op_ord": order, "rect_ord": k, "box": b, "colour": list(state.fill) if state.fill else None})
            rects = []
        elif op in ("n", "S", "s"):
            rects = []
        elif op == "Do":
            b = box(state.ctm, 0, 0, 1, 1)
            out.images.append({"op_ord": order, "box": b})
            out.regions.append({"op_ord": order, "rect_ord": 0, "box": b, "colour": None})
        elif op == "BI":
            end = r.data.find(b"EI", r.at)
            r.at = len(r.data) if end < 0 else end + 2
        args = []
    return out


def read_file(data: bytes) -> dict:
    """fonts, painted pages and metadata."""
    f = File(data)
    by_number = {x["font_ord"]: x for x in f.fonts()}
    pages = []
    for page in f.pages():
        media = f.get(page.get("MediaBox"))
        values = [f.get(v) for v in media] if isinstance(media, list) and len(media) == 4 else []
        media = tuple(float(v) for v in values) if values and all(isinstance(v, (int, float)) for v in values) else (0.0, 0.0, 612.0, 792.0)
        contents = f.get(page.get("Contents"))
        streams = [f.get(c) for c in contents] if isinstance(contents, list) else [contents]
        body = b"\n".join(f.decoded(s) for s in streams if isinstance(s, Stream))
        names = f.at(page, "Resources", "Font") or {}
        fonts = {k: by_number[v.number] for k, v in names.items() if isinstance(v, Ref) and v.number in by_number}
        pages.append(paint(body, fonts, media))
    return {"fonts": list(by_number.values()), "pages": pages, "metadata": f.metadata(), "errors": list(dict.fromkeys(f.errors))}


RUNS = "doc_id long, page int, op_ord int, nbytes long, text string, fill array<double>, render_mode int, eff_size double, cx double, cy double"
REGIONS = "doc_id long, page int, op_ord int, rect_ord int, x0 double, y0 double, x1 double, y1 double, colour array<double>, is_image boolean"
MEDIA = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double"
FONTS = "doc_id long, font_ord int, base_name string, type0 boolean, has_differences boolean, program binary"
TOUNICODE = "doc_id long, font_ord int, base_name string, code_lo int, code_hi int, dst_hex string"
FACES = "doc_id long, font_ord int, type0 boolean, own_cid_map boolean, family string, full string, postscript string, file_sha string, cmap_sha string"
GLYPHS = "doc_id long, font_ord int, subtable_ord int, cp int, gid int, outline_hash long"
CMAP = "doc_id long, font_ord int, cp int"
OUTLINES = "doc_id long, font_ord int, gid int, outline_hash long"
CID_GID = "doc_id long, font_ord int, cid int, gid int"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _rows(kind: str, doc: int, got: dict):
    if kind == "runs":
        for p, page in enumerate(got["pages"], 1):
            for r in page.runs:
                yield {"doc_id": doc, "page": p, **r}
    elif kind == "regions":
        for p, page in enumerate(got["pages"], 1):
            images = {r["op_ord"] for r in page.images}
            for r in page.regions:
                yield {"doc_id": doc, "page": p, **r, **dict(zip(("x0", "y0", "x1", "y1"), r["box"])), "is_image": r["op_ord"] in images}
    elif kind == "media":
        for p, page in enumerate(got["pages"], 1):
            yield {"doc_id": doc, "page": p, **dict(zip(("x0", "y0", "x1", "y1"), page.media))}
    elif kind == "fonts":
        for f in got["fonts"]:
            yield {"doc_id": doc, **f}
    elif kind == "metadata":
        m = got["metadata"]
        values = [m[k] for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")]
        if any(v is not None for v in values):
            yield {"doc_id": doc} | dict(zip([f.split()[0] for f in METADATA.split(", ")][1:], [*values, m["version"]]))
    elif kind == "tounicode":
        for f in got["fonts"]:
            for e in f["tounicode"]:
                yield {"doc_id": doc, "font_ord": f["font_ord"], "base_name": f["base_name"], **e}
    else:
        for f in got["fonts"]:
            key = {"doc_id": doc, "font_ord": f["font_ord"]}
            cid = f["cid_gid"] or b""
            if kind == "cid_gid" and f["type0"]:
                yield from (key | {"cid": c, "gid": int.from_bytes(cid[2 * c : 2 * c + 2], "big")} for c in range(len(cid) // 2))
            if "face" not in f:  # parsed once for all tables
                f["face"] = parse_faces(f["program"] or b"")[:1]
            for face in f["face"]:
                if kind == "faces":
                    yield face | key | {"type0": f["type0"], "own_cid_map": f["cid_gid"] is not None}
                elif kind == "glyphs":
                    yield from (key | g for g in letter_glyphs(face))
                elif kind == "cmap":
                    yield from (key | {"cp": c} for c in face["cmap"])
                elif kind == "outlines" and f["type0"]:
                    yield from (key | {"gid": g, "outline_hash": h} for g in range(face["num_glyphs"]) if (h := face["hash_of"](g)) is not None)


METADATA = "doc_id long, title string, author string, subject string, keywords string, creator string, producer string, created string, modified string, version string"
ERRORS = "doc_id long, error string"
TABLES = {
    "runs": RUNS, "regions": REGIONS, "media": MEDIA, "fonts": FONTS, "tounicode": TOUNICODE, "faces": FACES, "glyphs": GLYPHS, "cmap": CMAP,
    "outlines": OUTLINES, "cid_gid": CID_GID, "metadata": METADATA, "errors": ERRORS,
}
#: All columns of all tables; a column has one type everywhere.
_ALL = {n: t for schema in TABLES.values() for n, t in (f.split() for f in schema.split(", "))}


def _file_rows(kinds: list[str], doc: int, blob: bytes):
    """(kind, row) of a file; one that can't be read has an error row alone."""
    try:
        got = read_file(blob)
        found = [(k, r) for k in kinds if k != "errors" for r in _rows(k, doc, got)]
        errors = got["errors"]
    except (ValueError, IndexError, RecursionError, struct.error) as e:
        found, errors = [], [f"{type(e).__name__}: {e}"]
    yield from found
    if "errors" in kinds:
        yield from (("errors", {"doc_id": doc, "error": e}) for e in errors)


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


def read_table(files: DataFrame, kind: str) -> DataFrame:
    """One of TABLES of files (doc_id, content); for several tables ``decode`` parses each file once.

    runs, regions, media, fonts, tounicode; of embedded TrueType programs faces, glyphs, cmap, outlines, cid_gid; metadata of
    files that say anything about themselves; errors of files that can't be read (which have no other rows), and of streams
    that can't be decoded to their end."""
    return table_of(decode(files, (kind,)), kind)


def read_errors(files: DataFrame) -> DataFrame:
    """doc_id, error of files that can't be read, and of files with streams that can't be decoded to their end."""
    return read_table(files, "errors")
