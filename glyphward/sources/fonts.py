"""TrueType faces: names, character map and outline hashes."""

from __future__ import annotations

import hashlib
import struct
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .batches import slices

EXTENSIONS = ("ttf", "otf", "ttc", "otc")
_NAMES = {0: "copyright", 1: "family", 2: "subfamily", 4: "full", 5: "version", 6: "postscript", 8: "manufacturer"}
_MASK = (1 << 64) - 1
#: Bytes of a font that is remembered.
_SMALL = 1 << 16


def _u16(b: bytes, i: int) -> int:
    return int.from_bytes(b[i : i + 2], "big")


def _u32(b: bytes, i: int) -> int:
    return int.from_bytes(b[i : i + 4], "big")


def _tables(data: bytes, at: int) -> dict[bytes, bytes]:
    out = {}
    for k in range(_u16(data, at + 4)):
        tag, _, start, size = struct.unpack(">4sIII", data[at + 12 + 16 * k : at + 28 + 16 * k])
        out[tag] = data[start : start + size]
    return out


def _read_names(b: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    count, base = _u16(b, 2), _u16(b, 4)
    for k in range(count):
        platform, encoding, _, which, size, start = struct.unpack(">6H", b[6 + 12 * k : 18 + 12 * k])
        if which not in _NAMES or _NAMES[which] in out:
            continue
        raw = b[base + start : base + start + size]
        if platform in (0, 3):
            out[_NAMES[which]] = raw.decode("utf-16-be", "replace")
        elif platform == 1 and encoding == 0:
            out[_NAMES[which]] = raw.decode("mac-roman", "replace")
    return out


def _format4(b: bytes) -> dict[int, int]:
    n = _u16(b, 6) // 2
    out = {}
    for k in range(n):
        end, start = _u16(b, 14 + 2 * k), _u16(b, 16 + 2 * n + 2 * k)
        delta, where = _u16(b, 16 + 4 * n + 2 * k), 16 + 6 * n + 2 * k
        shift = _u16(b, where)
        for c in range(start, end + 1):
            if c == 0xFFFF:
                continue
            g = (c + delta) & 0xFFFF
            if shift:
                g = _u16(b, where + shift + 2 * (c - start))
                g = (g + delta) & 0xFFFF if g else 0
            if g:
                out[c] = g
    return out


def _format12(b: bytes) -> dict[int, int]:
    out = {}
    for k in range(_u32(b, 12)):
        first, last, g = struct.unpack(">III", b[16 + 12 * k : 28 + 12 * k])
        if last < first or last > 0x10FFFF:
            break
        out.update((c, g + c - first) for c in range(first, last + 1))
    return out


def unicode_maps(b: bytes) -> list[dict[int, int]]:
    """Every Unicode subtable of a cmap table."""
    out = []
    for k in range(_u16(b, 2)):
        platform, encoding, at = struct.unpack(">HHI", b[4 + 8 * k : 12 + 8 * k])
        if platform == 0 or (platform == 3 and encoding in (0, 1, 10)):
            kind = _u16(b, at)
            if kind == 4:
                out.append(_format4(b[at:]))
            elif kind == 12:
                out.append(_format12(b[at:]))
            elif kind == 0:
                out.append({c: g for c, g in enumerate(b[at + 6 : at + 262]) if g})
    return out


class _Glyphs:
    def __init__(self, t: dict[bytes, bytes]):
        self.glyf, loca, head = t[b"glyf"], t[b"loca"], t[b"head"]
        wide = _u16(head, 50)
        self.at = [_u32(loca, 4 * i) for i in range(len(loca) // 4)] if wide else [2 * _u16(loca, 2 * i) for i in range(len(loca) // 2)]

    def contours(self, gid: int, depth: int = 0) -> list[list[tuple[float, float, bool]]]:
        if gid + 1 >= len(self.at) or self.at[gid + 1] <= self.at[gid] or depth > 8:
            return []
        b = self.glyf[self.at[gid] : self.at[gid + 1]]
        n = struct.unpack(">h", b[:2])[0]
        return self._simple(b, n) if n >= 0 else self._composite(b, depth)

    def _simple(self, b: bytes, n: int) -> list[list[tuple[float, float, bool]]]:
        ends = [_u16(b, 10 + 2 * k) for k in range(n)]
        total = ends[-1] + 1 if ends else 0
        i = 12 + 2 * n + _u16(b, 10 + 2 * n)
        flags: list[int] = []
        while len(flags) < total:
            f = b[i]
            i += 1
            flags.append(f)
            if f & 8:
                flags += [f] * b[i]
                i += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, values = 0, []
            for f in flags[:total]:
                if f & short:
                    v += b[i] if f & same else -b[i]
                    i += 1
                elif not f & same:
                    v += struct.unpack(">h", b[i : i + 2])[0]
                    i += 2
                values.append(v)
            axes.append(values)
        points = [(float(x), float(y), bool(f & 1)) for x, y, f in zip(*axes, flags)]
        return [points[a:e] for a, e in zip([0] + [e + 1 for e in ends[:-1]], [e + 1 for e in ends])]

    def _composite(self, b: bytes, depth: int) -> list[list[tuple[float, float, bool]]]:
        i, out = 10, []
        while True:
            flags, gid = _u16(b, i), _u16(b, i + 2)
            i += 4
            dx, dy = struct.unpack(">hh", b[i : i + 4]) if flags & 1 else struct.unpack(">bb", b[i : i + 2])
            i += 4 if flags & 1 else 2
            m = (1.0, 0.0, 0.0, 1.0)
            f = lambda k: struct.unpack(">h", b[i + 2 * k : i + 2 * k + 2])[0] / 16384  # noqa: E731, B023
            if flags & 8:
                m, i = (f(0), 0.0, 0.0, f(0)), i + 2
            elif flags & 64:
                m, i = (f(0), 0.0, 0.0, f(1)), i + 4
            elif flags & 128:
                m, i = (f(0), f(1), f(2), f(3)), i + 8
            if not flags & 2:
                dx = dy = 0
            for c in self.contours(gid, depth + 1):
                out.append([(x * m[0] + y * m[2] + dx, x * m[1] + y * m[3] + dy, on) for x, y, on in c])
            if not flags & 32:
                return out


def outline_hash(contours: list[list[tuple[float, float, bool]]]) -> int | None:
    """64 signed bits of the drawing operations and whole coordinates; null of an empty outline."""
    if not contours:
        return None
    h = 0xCBF29CE484222325
    for c in contours:
        for k, (x, y, on) in enumerate(c):
            for v in (1 if k == 0 else 2 if on else 3, int(x) & _MASK, int(y) & _MASK):
                h = ((h ^ v) * 0x100000001B3) & _MASK
        h = ((h ^ 5) * 0x100000001B3) & _MASK
    return h - (1 << 64) if h >> 63 else h


def parse_face(data: bytes, at: int, index: int) -> dict:
    t = _tables(data, at)
    maps = unicode_maps(t[b"cmap"]) if b"cmap" in t else []
    cmap = max(maps, key=len, default={})
    packed = b"".join(struct.pack("<IH", c, cmap[c] & 0xFFFF) for c in sorted(cmap))
    glyphs = _Glyphs(t) if b"glyf" in t and b"loca" in t and b"head" in t else None
    outlines = {}
    if glyphs is not None:
        for c, g in cmap.items():
            if unicodedata.name(chr(c), "").startswith("LATIN") and chr(c).isalpha():
                h = outline_hash(glyphs.contours(g))
                if h is not None:
                    outlines[c] = h
    names = _read_names(t[b"name"]) if b"name" in t else {}
    return names | {
        "index": index,
        "num_glyphs": _u16(t[b"maxp"], 4) if b"maxp" in t else 0,
        "units_per_em": _u16(t[b"head"], 18) if b"head" in t else 0,
        "cmap": cmap,
        "maps": maps,
        "outlines": outlines,
        "hash_of": lru_cache(maxsize=1024)(lambda gid: outline_hash(glyphs.contours(gid))) if glyphs is not None else (lambda gid: None),
        "file_sha": hashlib.sha256(data).hexdigest(),
        "cmap_sha": hashlib.sha256(packed).hexdigest(),
    }


def parse_faces(data: bytes) -> list[dict]:
    """All faces of a font file or collection; those that can't be read are passed over.  Small fonts come in many files, so the
    last few are remembered; the faces are not to be changed."""
    return list(_small_faces(data)) if len(data) <= _SMALL else _parse_faces(data)


@lru_cache(maxsize=32)
def _small_faces(data: bytes) -> list[dict]:
    return _parse_faces(data)


def _parse_faces(data: bytes) -> list[dict]:
    starts = []
    if data[:4] == b"ttcf":
        starts = [_u32(data, 12 + 4 * k) for k in range(_u32(data, 8))]
    elif data[:4] in (b"\x00\x01\x00\x00", b"OTTO", b"true"):
        starts = [0]
    out = []
    for k, at in enumerate(starts):
        try:
            out.append(parse_face(data, at, k))
        except (IndexError, struct.error, KeyError, ValueError):
            continue
    return out


def letter_glyphs(face: dict) -> list[dict]:
    """subtable_ord, cp, gid, outline_hash of the Latin letters of every Unicode subtable; empty outlines are left out."""
    out = []
    for k, m in enumerate(face["maps"]):
        for c, g in m.items():
            if unicodedata.name(chr(c), "").startswith("LATIN") and chr(c).isalpha() and (h := face["hash_of"](g)) is not None:
                out.append({"subtable_ord": k, "cp": c, "gid": g, "outline_hash": h})
    return out


FACE_SCHEMA = "path string, face_index int, family string, full string, postscript string, num_glyphs int, units_per_em int, file_sha string, cmap_sha string, cps array<struct<cp:int,gid:int,outline_hash:bigint>>"


def face_batches(batches):
    """What a task does with batches of files (path, content); see ``read_fonts``."""
    kind = pa.list_(pa.struct([("cp", pa.int32()), ("gid", pa.int32()), ("outline_hash", pa.int64())]))
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), kind]
    names = [f.split()[0] for f in FACE_SCHEMA.split(", ")[:9]] + ["cps"]
    for batch in batches:
        for some in slices(batch, "content"):
            rows = []
            for path, blob in zip(some.column("path").to_pylist(), some.column("content").to_pylist()):
                for f in parse_faces(blob or b""):
                    cps = [{"cp": c, "gid": g, "outline_hash": f["outlines"].get(c)} for c, g in sorted(f["cmap"].items())]
                    rows.append((path, f["index"], f.get("family"), f.get("full"), f.get("postscript"), f["num_glyphs"], f["units_per_em"], f["file_sha"], f["cmap_sha"], cps))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def read_fonts(files: DataFrame) -> DataFrame:
    """FACE_SCHEMA of files (path, content); files without a readable face have no row."""
    return files.select("path", "content").mapInArrow(face_batches, FACE_SCHEMA)


def font_files(spark: SparkSession, folder: str) -> DataFrame:
    glob = "*.{" + ",".join(EXTENSIONS + tuple(e.upper() for e in EXTENSIONS)) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def build_registry(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(faces, skipped files) of a folder."""
    files = font_files(spark, folder)
    faces = read_fonts(files)
    return faces, files.select("path").join(faces.select("path").distinct(), "path", "left_anti")
