"""Finding schema, rule catalogue and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")
RANK = {s: i for i, s in enumerate(SEVERITIES)}
FONT, UNICODE, HIDDEN, STRUCTURE = "FontIntegrity", "UnicodeHygiene", "HiddenContent", "Structural"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    category: str
    confidence: float
    location: str


RULES: dict[str, Rule] = {
    name: Rule(name, sev, cat, conf, loc)
    for name, sev, cat, conf, loc in [
        ("UNICODE.PUA", "High", UNICODE, 0.9, "document text"),
        ("UNICODE.ZERO_WIDTH", "Medium", UNICODE, 0.7, "document text"),
        ("UNICODE.BIDI_OVERRIDE", "Medium", UNICODE, 0.7, "document text"),
        ("FONT.PUA_CMAP", "High", FONT, 0.75, "embedded font"),
        ("PDF.TOUNICODE_GARBLED", "High", FONT, 0.85, "font"),
        ("PDF.CUSTOM_DIFFERENCES", "Info", STRUCTURE, 0.3, "font"),
        ("PDF.MANY_SUBSETS", "Medium", STRUCTURE, 0.6, "family"),
        ("PDF.GLYPH_SEMANTIC_REPLACEMENT", "High", FONT, 0.9, "embedded font"),
        ("PDF.FONT_ENCODING_ARTIFACT", "Info", STRUCTURE, 0.85, "embedded fonts"),
        ("PDF.CANONICAL_TAMPER_CONFIRMED", "High", FONT, 0.95, "embedded fonts"),
        ("PDF.INVISIBLE_TEXT_COLOR", "Medium", HIDDEN, 0.6, "page"),
        ("PDF.TINY_TEXT", "Medium", HIDDEN, 0.6, "page"),
        ("PDF.INVISIBLE_RENDER_MODE", "Medium", HIDDEN, 0.5, "page"),
        ("PDF.OCR_TEXT_LAYER", "Info", STRUCTURE, 0.8, "page(s)"),
        ("PDF.HIDDEN_TEXT_CONFIRMED", "High", HIDDEN, 0.85, "rendered page"),
        ("PDF.RENDER_DIVERGENCE_CONFIRMED", "High", FONT, 0.9, "rendered page"),
        ("PDF.GLYPH_SEMANTIC_REPLACEMENT_OCR", "High", FONT, 0.8, "embedded font"),
        ("GLYPH.SEMANTIC_REPLACEMENT", "High", FONT, 0.9, "glifo"),
        ("DOCX.INVISIBLE_TEXT_COLOR", "High", HIDDEN, 0.7, "document runs"),
        ("DOCX.TINY_TEXT", "High", HIDDEN, 0.7, "document runs"),
        ("DOCX.HIDDEN_VANISH", "Medium", HIDDEN, 0.8, "document runs"),
        ("DOCX.FONT_UNREADABLE", "Low", FONT, 0.4, "embedded font"),
        ("DOCX.GLYPH_SEMANTIC_REPLACEMENT", "High", FONT, 0.9, "embedded font"),
        ("DOCX.CANONICAL_TAMPER_CONFIRMED", "High", FONT, 0.95, "embedded fonts"),
        ("DOCX.HIDDEN_TEXT_CONFIRMED", "High", HIDDEN, 0.85, "rendered document"),
        ("DOCX.RENDER_DIVERGENCE_CONFIRMED", "High", FONT, 0.9, "rendered document"),
        ("DOCX.GLYPH_SEMANTIC_REPLACEMENT_OCR", "High", FONT, 0.8, "embedded font"),
        ("HTML.HIDDEN_STYLE", "Medium", HIDDEN, 0.6, "CSS"),
        ("HTML.CSS_CONTENT_INJECTION", "Low", HIDDEN, 0.4, "CSS"),
        ("HTML.REMOTE_WEBFONT", "Info", FONT, 0.3, "@font-face"),
        ("HTML.DATAURI_WEBFONT", "Info", FONT, 0.3, "@font-face"),
        ("HTML.FONTFACE_COUNT", "Info", STRUCTURE, 0.2, "CSS"),
    ]
}

FINDING_COLUMNS = ("doc_id", "rule", "severity", "severity_rank", "category", "location", "confidence", "n", "sample")


@dataclass(frozen=True)
class Thresholds:
    """Every limit of the rules in one place."""

    pua_chars: int = 4
    garbled: int = 4
    subset_tags: int = 5
    cmap_size: int = 16
    cmap_pua_ratio: float = 0.5
    shift_count: int = 8
    shift_share: float = 0.8
    hidden_chars: int = 4
    tiny_points: float = 1.5
    tiny_half_points: int = 8
    near_white_luma: float = 0.9
    colour_eps: float = 0.08
    background_share: float = 0.9
    scan_coverage: float = 0.70
    scan_invisible: float = 0.70
    scan_spread: float = 0.50
    grid: int = 40
    sample_chars: int = 200
    phrases: int = 100
    missing_words: int = 50
    missing_confirmed: int = 4
    sentence_chars: int = 400
    phrase_match: float = 0.4
    refuted: float = 0.9
    divergence: float = 0.40
    divergence_words: int = 5
    substitution: float = 0.4
    ocr_confidence: float = 65.0


DEFAULTS = Thresholds()
