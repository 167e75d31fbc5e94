"""Latin letters, and which of them may share a glyph."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Letters without a decomposition, by their ASCII base; IPA and extension letters among them.
_BASES = {
    "a": "ɐɑɒⱥ", "ae": "æ", "b": "ƀɓƃʙ", "c": "ƈȼɕ", "d": "ðđɖɗƌȡᶁ", "e": "ɇəɛɘǝ", "f": "ƒ", "g": "ɡǥɠɢᵹ", "h": "ħɦⱨ", "i": "ıɨɪ", "j": "ȷɉʝ",
    "k": "ƙⱪĸ", "l": "łƚɫɬɭʟ", "m": "ɱ", "n": "ŋɲɳƞɴ", "o": "øɵɔ", "oe": "œ", "p": "ƥᵽ", "q": "ɋʠ", "r": "ɍɽɾɼʀ", "s": "ſʂȿ", "ss": "ß", "t": "ŧƭʈⱦ",
    "th": "þ", "u": "ʉɯ", "v": "ʋⱱ", "w": "ⱳ", "y": "ƴɏʏ", "z": "ƶȥʐʑⱬ",
}
_BASE_OF = {c: base for base, cs in _BASES.items() for c in cs}
#: Pairs that published confusables data holds for equal; a hand-made part of it.
_LOOKALIKES = [("i", "l"), ("ı", "i"), ("ɩ", "i"), ("ƿ", "p"), ("ʋ", "u"), ("ꞵ", "b"), ("ꭓ", "x"), ("ʒ", "ȝ"), ("ɣ", "y"), ("ꞷ", "w"), ("ꞝ", "o")]


def ascii_base(c: str) -> str:
    plain = "".join(_BASE_OF.get(x, x) for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
    return plain if plain.isascii() else ""


@lru_cache(maxsize=1)
def legit_pairs() -> list[tuple[int, int]]:
    """Both orders of all pairs of different lower-case Latin letters that may look the same; a few thousand, fixed."""
    latin = [chr(c) for c in range(0x61, 0xAB80) if chr(c).isalpha() and unicodedata.name(chr(c), "").startswith("LATIN") and chr(c).lower() == chr(c)]
    groups: dict[str, list[str]] = {}
    for c in latin:
        base = ascii_base(c) or unicodedata.normalize("NFKD", c)
        groups.setdefault(base, []).append(c)
    pairs = {(ord(a), ord(b)) for g in groups.values() for a in g for b in g if a != b}
    for a, b in _LOOKALIKES:
        pairs |= {(ord(a), ord(b)), (ord(b), ord(a))}
    return sorted(pairs)


def legitimately_identical(a: str, b: str) -> bool:
    """Of two Latin letters, whatever their case."""
    a, b = a.lower()[:1], b.lower()[:1]
    if not (unicodedata.name(a, "").startswith("LATIN") and unicodedata.name(b, "").startswith("LATIN")):
        return a == b or unicodedata.name(a, "?").split()[0] != unicodedata.name(b, "?").split()[0] or unicodedata.normalize("NFKD", a) == unicodedata.normalize("NFKD", b)
    return a == b or (ord(a), ord(b)) in _legit_set()


@lru_cache(maxsize=1)
def _legit_set() -> frozenset[tuple[int, int]]:
    return frozenset(legit_pairs())


def legit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(legit_pairs(), "a_cp int, b_cp int")


def latin_letter(char: Column) -> Column:
    """The lower-case letter of a Latin letter, null for anything else."""
    return F.when(char.rlike(r"^\p{IsLatin}$") & char.rlike(r"^\p{IsAlphabetic}$"), F.substring(F.lower(char), 1, 1))
