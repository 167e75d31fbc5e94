"""An ingestion gate: documents stream in, accepted ones and findings stream out.

Every text is judged by itself, so the rules need no state, no watermark and no shuffle; replays of a batch write the same
folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphward.operators.text_rules import hygiene
from glyphward.schema import RANK


def start(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """stream (doc_id, text, ...) to ``out``/findings and ``out``/accepted, a folder for each batch.

    A document passes if it has no finding of High or above.  A null text passes."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        found = hygiene(batch)
        found.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        bad = found.filter(F.col("severity_rank") >= RANK["High"]).select("doc_id").distinct()
        batch.join(bad, "doc_id", "left_anti").write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def findings_by_day(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """day, rule, n of a stream (ts, doc_id, text): tumbling days, rows later than ``late`` dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    from glyphward.functions import unicode as U

    kinds = F.array(*[F.when(F.col("text").rlike(p), F.lit(r)) for r, p in (("UNICODE.PUA", U.PUA), ("UNICODE.ZERO_WIDTH", U.ZERO_WIDTH), ("UNICODE.BIDI_OVERRIDE", U.BIDI))])
    each = timed.withColumn("rule", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    return each.groupBy(F.window("ts", "1 day").alias("day"), "rule").agg(F.count(F.lit(1)).alias("n"))
