"""Operator 5: mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target share / actual share (shares of characters).
Documents stand in line by id; the running sum of expected copies plus one random offset per source crosses an integer
boundary as often as the document is emitted.  Sums are whole micro-copies, so they are exact and independent of order
of evaluation.

The running sum needs no window over a whole source: ids are cut into ranges by approximate quantiles, range totals are
summed per source (a few numbers per range), and each range then sums its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SCALE = 1_000_000
#: Relative target weights of the production query; sources not named get ``OTHER``.
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}
OTHER = 1.0
SEED = "mix-1"
#: Ranges of ids at most; a range of a source is summed in one task, so it holds more rows where there are more than
#: RANGES * rows_per_range.
RANGES = 4096


def _offset(source: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.coalesce(source, F.lit("\u0000")), F.lit("|" + seed)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(SCALE))


def rates(docs: DataFrame, weights: dict[str, float], other: float, seed: str) -> DataFrame:
    """Per source: micro-copies per document and the offset.  A source without characters keeps its documents once."""
    weight = F.lit(other)
    for name, w in sorted(weights.items()):
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    per = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))
    per = per.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0)))
    total = per.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars")
    return per.crossJoin(F.broadcast(total)).select(
        F.col("source").alias("__source"),
        F.when(F.col("chars") > 0, F.floor(share * SCALE + 0.5)).otherwise(SCALE).cast("long").alias("__step"),
        _offset(F.col("source"), seed).alias("__offset"),
    )


def _range_of(docs: DataFrame, rows_per_range: int) -> Column:
    """Number of an id's range.  Bounds are approximate quantiles of all ids, at most RANGES; only balance depends on them.
    A null id stands before all others."""
    n = docs.count()
    k = min(RANGES, max(1, round(n / rows_per_range)))
    if k == 1:
        return F.lit(0)
    q = docs.approxQuantile("doc_id", [i / k for i in range(1, k)], 0.25 / k) or []
    bounds = sorted({int(x) for x in q})
    if not bounds:
        return F.lit(0)
    # searched in two steps: among the first bounds of groups of 64, then in one group
    some = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    below = lambda array: F.array_size(F.filter(array, lambda b: b <= F.col("doc_id")))
    group = below(F.lit([g[0] for g in some[1:]]).cast("array<long>")) if len(some) > 1 else F.lit(0)
    inside = F.element_at(F.array(*[F.lit(g).cast("array<long>") for g in some]), group + 1)
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(group * 64 + below(inside))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    other: float = OTHER,
    seed: str = SEED,
    rows_per_range: int = 20_000,
) -> DataFrame:
    """Rows of docs, each as often as it is drawn, with ``copy_no`` (1, 2, ...).

    Order within a source is by id, then by hashes of the text and of the row written as JSON, so repeated rows are drawn
    like any others and equal rows are interchangeable.  A null source is a source of its own; a null id comes first; null and empty texts are drawn
    like others.  A source whose texts are all empty or null keeps each row once.  A column of docs named copy_no is
    replaced; names beginning with two underscores are ours.
    """
    weights = WEIGHTS if weights is None else weights
    base = docs.drop("copy_no").withColumn("__range", _range_of(docs, rows_per_range))
    per = F.broadcast(rates(docs, weights, other, seed))  # a row per source
    spread = base.groupBy("source", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = spread.select(F.col("source").alias("__source"), F.col("__range").alias("__r"), before.alias("__before"))
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text", "copy_no")]
    rest = [F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])))] if others else []
    line = W.partitionBy("source", "__range").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), *rest)
    ranked = base.withColumn("__i", F.row_number().over(line))
    ranked = ranked.join(start, ranked["source"].eqNullSafe(start["__source"]) & (ranked["__range"] == start["__r"])).drop("__source", "__r")
    ranked = ranked.join(per, ranked["source"].eqNullSafe(per["__source"])).drop("__source")
    copies = F.expr(
        f"((__before + __i) * __step + __offset) div {SCALE} - ((__before + __i - 1) * __step + __offset) div {SCALE}"
    )
    names = [c for c in docs.columns if c != "copy_no"]
    drawn = ranked.withColumn("__copies", copies).filter(F.col("__copies") > 0)
    return drawn.select(*names, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy_no"))


def oracle(weights: dict[str, float] | None = None, other: float = OTHER, seed: str = SEED) -> str:
    """DuckDB SQL for doc_id, source, copy_no of ``mix`` over documents."""
    weights = WEIGHTS if weights is None else weights
    case = "CASE " + " ".join(f"WHEN source = '{k}' THEN {float(w)!r}::DOUBLE" for k, w in sorted(weights.items())) + f" ELSE {other!r}::DOUBLE END"
    return f"""
WITH per AS (
  SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents GROUP BY source
), weighted AS (
  SELECT *, CASE WHEN chars > 0 THEN {case} ELSE 0.0::DOUBLE END AS weight FROM per
), rate AS (
  SELECT source,
    CASE WHEN chars > 0 THEN floor(weight / (SELECT sum(weight) FROM weighted)
      * (SELECT sum(chars)::DOUBLE FROM weighted) / chars::DOUBLE * {SCALE} + 0.5)::BIGINT ELSE {SCALE} END AS step,
    ('0x' || substr(md5(coalesce(source, chr(0)) || '|{seed}'), 1, 8))::BIGINT % {SCALE} AS offs
  FROM weighted
), line AS (
  SELECT d.doc_id, d.source, step, offs,
    row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id NULLS FIRST) AS i
  FROM documents d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source
), drawn AS (
  SELECT doc_id, source, (i * step + offs) // {SCALE} - ((i - 1) * step + offs) // {SCALE} AS copies FROM line
)
SELECT doc_id, source, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM drawn WHERE copies > 0
"""
