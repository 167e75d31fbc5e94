"""Reports: a nested row per document, as JSON or as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphward.operators.findings import assess


def reports(docs: DataFrame, findings: DataFrame, phrases: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """doc_id, assessment, findings (the worst first), phrases (null where none), verdict."""
    fields = ["rule", "severity", "category", "location", "confidence", "n", "sample"]
    one = F.struct((-F.col("severity_rank")).alias("o"), *fields)
    lists = findings.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("findings"))
    a = assess(docs, findings)
    out = a.select("doc_id", F.struct("ok", "defaced", "hidden_text", "max_severity").alias("assessment")).join(lists, "doc_id", "left")
    if phrases is not None:
        pairs = phrases.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence_ord", "extracted", "presumed"))), lambda x: F.struct(x["extracted"].alias("extracted"), x["presumed"].alias("presumed"))).alias("phrases"))
        out = out.join(pairs, "doc_id", "left")
    if verdicts is not None:
        out = out.join(verdicts, "doc_id", "left")
    return out


def as_json(table: DataFrame) -> DataFrame:
    """A JSON string per report; absent parts are left out."""
    return table.select(F.to_json(F.struct(*table.columns)).alias("report"))


def as_text(table: DataFrame) -> str:
    """For a reader, of a table small enough to read."""
    lines = []
    for r in table.orderBy("doc_id").toLocalIterator():
        a = r["assessment"]
        lines.append(f"document {r['doc_id']}: {'OK' if a['ok'] and not a['hidden_text'] else 'NOT OK'}")
        for f in r["findings"] or []:
            lines.append(f"  [{f['severity']}] {f['rule']} x{f['n']} ({f['location']})" + (f": {f['sample'][:80]}" if f["sample"] else ""))
    return "\n".join(lines)
