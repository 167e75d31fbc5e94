"""Code point classes, as expressions over text or over code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PUA = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
ANY = f"{PUA}|{ZERO_WIDTH}|{BIDI}"


def count_class(text: Column, pattern: str) -> Column:
    """How many characters of text are of the class (null for a null text)."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def is_pua(cp: Column) -> Column:
    return cp.between(0xE000, 0xF8FF) | cp.between(0xF0000, 0xFFFFD) | cp.between(0x100000, 0x10FFFD)


def is_zero_width(cp: Column) -> Column:
    return cp.between(0x200B, 0x200D) | cp.between(0x2060, 0x2064) | cp.isin(0xFEFF, 0xAD)


def is_bidi_override(cp: Column) -> Column:
    return cp.between(0x202A, 0x202E) | cp.between(0x2066, 0x2069)


def is_unreadable(cp: Column) -> Column:
    return is_pua(cp) | is_zero_width(cp)


def is_ligature(cp: Column) -> Column:
    return cp.between(0xFB00, 0xFB4F)


def pua_units(hexadecimal: Column) -> Column:
    """Unreadable UTF-16 units of a hex string, four digits each; a short tail and astral characters don't count."""
    units = F.floor(F.length(hexadecimal) / 4).cast("int")
    places = F.when(units > 0, F.sequence(F.lit(0), units - 1)).otherwise(F.array().cast("array<int>"))
    cps = F.transform(places, lambda i: F.conv(F.substring(hexadecimal, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    return F.size(F.filter(cps, is_unreadable)).cast("long")
