"""Rules over HTML: styles that hide text, text that styles insert, and web fonts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphward.schema import FINDING_COLUMNS

from .findings import as_findings, counted_findings, finding_columns, union

#: Label and pattern.  They are case-sensitive and unanchored on purpose, as deployed rules have them; see STRICT.
CLOAKING = {
    "display:none": r"display\s*:\s*none",
    "visibility:hidden": r"visibility\s*:\s*hidden",
    "opacity:0": r"opacity\s*:\s*0(?:\.0+)?\b",
    "font-size:0": r"font-size\s*:\s*0(?:px|pt|em)?\b",
    "negative text-indent": r"text-indent\s*:\s*-\s*9{3,}",
    "clip:rect(0": r"clip\s*:\s*rect\(\s*0",
    "off-canvas": r"left\s*:\s*-\s*9{3,}",
}
#: No matter of case; fractions such as 0.5 and properties that end in a listed name don't count.
STRICT = {
    k: r"(?i)(?:^|[;{\s\"'])" + v.replace(r"0(?:\.0+)?\b", r"0(?:\.0+)?\s*(?:[;}!\"']|$)").replace(r"0(?:px|pt|em)?\b", r"0(?:px|pt|r?em)?\s*(?:[;}!\"']|$)")
    for k, v in CLOAKING.items()
}
CONTENT = r"content\s*:\s*[\"']"
FACE = r"(?is)@font-face\s*\{([^}]*)\}"
URL = r"url\(\s*['\"]?([^'\")]+)['\"]?\s*\)"


def css_text(html: Column) -> Column:
    """All style sheets, then all style attributes, a line each."""
    sheets = F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))
    inline = F.regexp_extract_all(html, F.lit(r"(?is)<[a-z][^>]*\sstyle\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.array_join(F.concat(sheets, inline), "\n")


def style_findings(pages: DataFrame, strict: bool = False) -> DataFrame:
    """HTML.HIDDEN_STYLE (a row per pattern, its label in ``sample``) and HTML.CSS_CONTENT_INJECTION of (doc_id, css)."""
    count = lambda p: F.regexp_count("css", F.lit(p))
    some = pages.filter(F.col("css").rlike("|".join(f"(?:{p})" for p in [*(STRICT if strict else CLOAKING).values(), CONTENT])))
    parts = [("HTML.HIDDEN_STYLE", count(p), 1, F.lit(label)) for label, p in (STRICT if strict else CLOAKING).items()]
    return counted_findings(some, [*parts, ("HTML.CSS_CONTENT_INJECTION", count(CONTENT), 1, None)])


def font_urls(pages: DataFrame) -> DataFrame:
    """doc_id, target, kind (remote, data, local) of every url in every @font-face."""
    bodies = pages.select("doc_id", F.explode(F.regexp_extract_all("css", F.lit(FACE), F.lit(1))).alias("body"))
    urls = bodies.select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(URL), F.lit(1))).alias("target"))
    target = F.trim("target")
    kind = F.when(target.rlike("^(?:https?:)?//"), "remote").when(target.startswith("data:"), "data").otherwise("local")
    return urls.select("doc_id", target.alias("target"), kind.alias("kind"))


def webfont_findings(pages: DataFrame) -> DataFrame:
    urls = font_urls(pages)
    remote = as_findings(urls.filter("kind = 'remote'"), "HTML.REMOTE_WEBFONT", F.lit(1), F.col("target"))
    data = as_findings(urls.filter("kind = 'data'"), "HTML.DATAURI_WEBFONT", F.lit(1))
    faces = pages.select("doc_id", F.regexp_count("css", F.lit(FACE)).alias("faces")).filter("faces > 0")
    return union(remote, data, as_findings(faces, "HTML.FONTFACE_COUNT", F.col("faces")))


def local_fonts(pages: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces (path, ...) that pages (doc_id, css, base_dir) name by a relative url."""
    urls = font_urls(pages).filter("kind = 'local'").join(pages.select("doc_id", "base_dir"), "doc_id")
    return urls.withColumn("path", F.concat_ws("/", "base_dir", F.regexp_replace("target", r"^\./", ""))).drop("kind", "base_dir").join(faces, "path")


__all__ = ["FINDING_COLUMNS", "finding_columns", "css_text", "style_findings", "font_urls", "webfont_findings", "local_fonts"]
