"""Findings, their union, and what is concluded from them per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from glyphward.schema import FINDING_COLUMNS, FONT, HIDDEN, RANK, RULES, SEVERITIES


def finding_columns(rule: str, n: Column, sample: Column | None = None, location: Column | None = None) -> list[Column]:
    """All finding columns but doc_id."""
    r = RULES[rule]
    return [
        F.lit(rule).alias("rule"),
        F.lit(r.severity).alias("severity"),
        F.lit(RANK[r.severity]).cast("int").alias("severity_rank"),
        F.lit(r.category).alias("category"),
        (F.lit(r.location) if location is None else location).alias("location"),
        F.lit(r.confidence).cast("double").alias("confidence"),
        n.cast("long").alias("n"),
        (F.lit(None).cast("string") if sample is None else sample).alias("sample"),
    ]


def as_findings(df: DataFrame, rule: str, n: Column, sample: Column | None = None, location: Column | None = None) -> DataFrame:
    return df.select("doc_id", *finding_columns(rule, n, sample, location))


def counted_findings(df: DataFrame, parts: list[tuple[str, Column, int, Column | None]]) -> DataFrame:
    """Findings of several rules from one pass: (rule, count, least count, sample) each."""
    rows = [F.when(F.coalesce(n, F.lit(0)) >= least, F.struct(*finding_columns(rule, n, sample))) for rule, n, least, sample in parts]
    found = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return df.select("doc_id", F.inline(found)).select(*FINDING_COLUMNS)


def union(*findings: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), findings)


def assess(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """A row per document: ok (nothing of High or above), defaced, hidden_text, max_severity (null without findings)."""
    per = findings.groupBy("doc_id").agg(
        F.max("severity_rank").alias("max_severity_rank"),
        F.bool_or((F.col("category") == FONT) & (F.col("severity_rank") >= RANK["High"])).alias("defaced"),
        F.bool_or((F.col("category") == HIDDEN) & (F.col("severity_rank") >= RANK["Medium"])).alias("hidden_text"),
        F.count(F.lit(1)).alias("n_findings"),
    )
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.col("max_severity_rank") < RANK["High"], F.lit(True)).alias("ok"),
        F.coalesce("defaced", F.lit(False)).alias("defaced"),
        F.coalesce("hidden_text", F.lit(False)).alias("hidden_text"),
        F.try_element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("max_severity_rank") + 1).alias("max_severity"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
    )


def gate(findings: DataFrame) -> DataFrame:
    """One row: exit_code, 1 where any finding is High or above, else 0."""
    return findings.agg(F.coalesce(F.max("severity_rank") >= RANK["High"], F.lit(False)).cast("int").alias("exit_code"))


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by category and severity with subtotals (null stands for all)."""
    return findings.rollup("category", "severity").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("doc_id").alias("n_docs"))


def sink_order(findings: DataFrame) -> DataFrame:
    """As a reader wants them: the worst first."""
    return findings.orderBy(F.desc("severity_rank"), "doc_id", "rule", "location")
