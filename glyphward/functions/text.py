"""Sentences, words, samples and substitutions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glyphward.schema import DEFAULTS

SENTENCE = r"[^.!?;\n\r]*[.!?;\n\r]|[^.!?;\n\r]+$"
WORD_GAP = r"[^\p{IsAlphabetic}\p{N}]+"


def clean_snippet(text: Column, most: int) -> Column:
    """White space collapsed and trimmed; beyond ``most`` characters cut, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def sentences(text: Column, most: int = DEFAULTS.sentence_chars) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: clean_snippet(s, most))
    return F.filter(found, lambda s: s != "")


def apply_map(text: Column, swaps: dict[str, str]) -> Column:
    """Constant substitutions of lower-case letters; a capital becomes the capital of its letter's substitute."""
    pairs = {**swaps, **{k.upper(): v.upper()[:1] for k, v in swaps.items() if len(k.upper()) == 1}}
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def apply_column_map(text: Column, swaps: Column) -> Column:
    """As ``apply_map`` with a map column of each row (lower-case letter to letter)."""

    def swap(c: Column) -> Column:
        low = F.substring(F.lower(c), 1, 1)
        to = F.element_at(swaps, low)
        return F.when(to.isNull(), c).when((c == F.upper(c)) & (c != F.lower(c)), F.upper(to)).otherwise(to)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def words(text: Column) -> Column:
    """Distinct words of two characters or more, lower-cased."""
    return F.filter(F.array_distinct(F.split(F.lower(text), WORD_GAP)), lambda w: F.length(w) >= 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def missing_words(extracted: Column, visual: Column, most: int = DEFAULTS.missing_words) -> Column:
    """Alphabetic words of at least four letters that the reader's text lacks, in order of appearance."""
    long = F.filter(F.array_distinct(F.split(F.lower(extracted), WORD_GAP)), lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{IsAlphabetic}+$"))
    return F.slice(F.array_except(long, words(visual)), 1, most)


def is_real_substitution(e: Column, v: Column, over: float = DEFAULTS.substitution) -> Column:
    longest = F.greatest(F.length(e), F.length(v))
    alphabetic = e.rlike(r"^\p{IsAlphabetic}+$") & v.rlike(r"^\p{IsAlphabetic}+$")
    return (F.length(e) >= 3) & (F.length(v) >= 3) & alphabetic & (F.levenshtein(e, v) / longest > over)


def first_words(text: Column, n: int = 16) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"(?U)\s+"), 1, n), " ")


def first_letter(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"(\p{IsAlphabetic})", 1))


def subset_tag(base_font: Column) -> Column:
    """``ABCDEF`` of ``ABCDEF+Name``, else null."""
    return F.when((F.length(base_font) > 7) & (F.substring(base_font, 7, 1) == "+"), F.substring(base_font, 1, 6))


def font_family(base_font: Column) -> Column:
    return F.when(subset_tag(base_font).isNotNull(), F.substr(base_font, F.lit(8))).otherwise(base_font)


def is_symbol_family(name: Column) -> Column:
    return F.lower(name).rlike("wingding|webding|symbol|dingbat|marlett|bookshelf|mt extra")


def is_math_or_symbol_font(name: Column) -> Column:
    return F.lower(name).rlike("cmex|cmsy|cmmi|msam|msbm|stmary|wasy|symbol|wingding|webding|dingbat")


def decode_pdf_text(raw: Column) -> Column:
    """Bytes of a PDF string: UTF-16BE behind its mark, else Latin-1; outer NULs and blanks go."""
    wide = F.substring(raw, 1, 2) == F.unhex(F.lit("FEFF"))
    body = F.when(wide, F.decode(F.substring(raw, 3, 1 << 30), "UTF-16BE")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.regexp_replace(body, r"^[\x00 ]+|[\x00 ]+$", "")


def tidy_pdf_date(value: Column) -> Column:
    """``D:YYYYMMDDHHmmss`` as ``YYYY-MM-DD HH:mm:ss``, a bare day as such; other strings stay."""
    digits = F.regexp_extract(value, r"^(?:D:)?(\d*)", 1)
    day = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    clock = F.concat_ws(":", F.substring(digits, 9, 2), F.substring(digits, 11, 2), F.substring(digits, 13, 2))
    return F.when(F.length(digits) >= 14, F.concat_ws(" ", day, clock)).when(F.length(digits) >= 8, day).otherwise(value)


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def css_string(text: Column) -> Column:
    """A string in single quotes for a style sheet; control characters go."""
    safe = F.replace(F.replace(F.regexp_replace(text, r"[\x00-\x1f]", ""), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), safe, F.lit("'"))


def data_uri(content: Column, kind: str) -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def format_of(path: Column) -> Column:
    """pdf, docx or html; null for what no decoder reads."""
    e = extension(path)
    return F.when(e.isin("pdf", "docx"), e).when(e.isin("html", "htm"), F.lit("html"))
