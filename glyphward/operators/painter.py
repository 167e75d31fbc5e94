"""What a page's paint order hides: text on its own colour, tiny text, invisible render modes, scans with a text layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphward.functions import colour as C
from glyphward.schema import DEFAULTS, Thresholds

from .findings import counted_findings


def with_background(runs: DataFrame, regions: DataFrame, media: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """runs with ``background``: the colour of the latest region painted before the run that holds its centre and is not the
    whole page; white where there is none, null where that region's colour is unknown.

    Equal keys are document and page, so each page's runs meet that page's regions alone.  The winner is an aggregate, never
    a sort.
    """
    key = ["doc_id", "page"]
    size = media.select(*key, C.area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("page_area"))
    small = regions.join(size, key).filter(C.area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= t.background_share * F.col("page_area"))
    small = small.select(*key, F.col("op_ord").alias("r_ord"), "rect_ord", "x0", "y0", "x1", "y1", "colour")
    at = runs.select(*key, "op_ord", "cx", "cy")
    under = at.join(small, key).filter((F.col("r_ord") < F.col("op_ord")) & C.contains(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "cx", "cy")]))
    top = under.groupBy(*key, "op_ord").agg(F.max(F.struct("r_ord", "rect_ord", "colour")).alias("top"))
    white = F.array(*[F.lit(1.0)] * 3)
    joined = runs.join(top, [*key, "op_ord"], "left")
    return joined.withColumn("background", F.when(F.col("top").isNull(), white).otherwise(F.col("top.colour"))).drop("top")


def image_coverage(images: DataFrame, media: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id, page, coverage: share of a grid's cells that image boxes touch."""
    key = ["doc_id", "page"]
    m = media.select(*key, *[F.col(c).alias("m" + c) for c in ("x0", "y0", "x1", "y1")])
    boxed = images.join(m, key).filter("mx1 > mx0 and my1 > my0")
    cells = lambda lo, hi, a, b: F.sequence(C.cell(F.col(lo), F.col(a), F.col(b), t.grid), C.cell(F.col(hi), F.col(a), F.col(b), t.grid))
    gx = boxed.select(*key, F.explode(cells("x0", "x1", "mx0", "mx1")).alias("gx"), cells("y0", "y1", "my0", "my1").alias("gys"))
    grid = gx.select(*key, "gx", F.explode("gys").alias("gy"))
    return grid.groupBy(*key).agg((F.countDistinct(F.col("gy") * t.grid + F.col("gx")) / float(t.grid * t.grid)).alias("coverage"))


def page_tallies(runs: DataFrame, coverage: DataFrame, media: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Per page: characters in all, invisible, tiny and camouflaged; spread of the invisible ones; whether it is a scan with a
    text layer.  runs need ``background``."""
    key = ["doc_id", "page"]
    invisible = F.col("render_mode").isin(3, 7)
    tiny = (F.col("eff_size") > 0) & (F.col("eff_size") < t.tiny_points)
    hidden = F.coalesce(C.colours_close(F.col("fill"), F.col("background"), t.colour_eps), F.lit(False)) & ~invisible
    per = runs.groupBy(*key).agg(
        F.sum("nbytes").alias("total"),
        *[F.sum(F.when(c, F.col("nbytes")).otherwise(0)).alias(n) for n, c in (("invisible", invisible), ("tiny", tiny), ("camouflaged", hidden))],
        (F.max(F.when(invisible, F.col("cx"))) - F.min(F.when(invisible, F.col("cx")))).alias("w"),
        (F.max(F.when(invisible, F.col("cy"))) - F.min(F.when(invisible, F.col("cy")))).alias("h"),
    )
    m = media.select(*key, (F.col("x1") - F.col("x0")).alias("mw"), (F.col("y1") - F.col("y0")).alias("mh"))
    per = per.join(m, key).join(coverage, key, "left").na.fill(0.0, ["coverage"])
    spread = F.when((F.col("mw") > 0) & (F.col("mh") > 0), F.least(F.col("w") / F.col("mw"), F.col("h") / F.col("mh"))).otherwise(0.0)
    per = per.withColumn("spread", F.coalesce(spread, F.lit(0.0)))
    scan = (F.col("invisible") > 0) & (F.col("coverage") >= t.scan_coverage) & (F.col("invisible") / F.col("total") >= t.scan_invisible) & (F.col("spread") >= t.scan_spread)
    return per.select(*key, "total", "invisible", "tiny", "camouflaged", "coverage", "spread", scan.alias("is_scan"))


def visibility_findings(tallies: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """PDF.* hidden-text rules per document; pages that are scans with a text layer count for the colour rule and as such.

    ``sample`` is the first page that has any."""
    normal = ~F.col("is_scan")
    part = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    page = lambda c, when: F.min(F.when(when & (F.col(c) > 0), F.col("page"))).cast("string")
    yes = F.lit(True)
    docs = tallies.groupBy("doc_id").agg(
        part("camouflaged", yes).alias("c"), page("camouflaged", yes).alias("cp"), part("tiny", normal).alias("t"), page("tiny", normal).alias("tp"),
        part("invisible", normal).alias("i"), page("invisible", normal).alias("ip"), F.sum(F.col("is_scan").cast("long")).alias("s"),
    )
    return counted_findings(
        docs,
        [
            ("PDF.INVISIBLE_TEXT_COLOR", F.col("c"), t.hidden_chars, F.col("cp")),
            ("PDF.TINY_TEXT", F.col("t"), t.hidden_chars, F.col("tp")),
            ("PDF.INVISIBLE_RENDER_MODE", F.col("i"), t.hidden_chars, F.col("ip")),
            ("PDF.OCR_TEXT_LAYER", F.col("s"), 1, None),
        ],
    )


def run_samples(runs: DataFrame, most: int = DEFAULTS.sample_chars) -> DataFrame:
    """doc_id, page, sample: a page's runs in paint order, joined and cut."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_ord", "text"))), lambda r: r["text"]), " ")
    return runs.filter("trim(text) <> ''").groupBy("doc_id", "page").agg(F.substring(text, 1, most).alias("sample"))
