"""Operator 10: cross-entropy difference of two matched bigram models.

The target model is counted over the documents that are labelled ``quality = 1``, the background model over all documents.
Both share one vocabulary, all words of the corpus and the end mark; both are bigram models with a Dirichlet prior on an
additively smoothed unigram model, and have the same constants, so that per-token losses can be subtracted:

    p1(w) = (c(w) + ALPHA) / (N + ALPHA * V)        p(w | h) = (c(h, w) + MU * p1(w)) / (c(h) + MU)

A document is scored by what all others say: its own events are subtracted from the counts of each model that it is in (but
V stays), else it would look the more familiar the shorter the corpus is.  Another row of the same text is another document.

Words are runs of letters, digits and non-ASCII characters, ASCII letters lower-cased.  A document with n words has n + 1
events, the last being the end mark; the first word's history is a begin mark.

Counts are never gathered in one place.  A chunk of documents sends each distinct word and bigram once, with its counts,
to a range of the hash space; the range sums over all chunks and sends the sums back to each chunk that asked.  A one-row
aggregate over the same exchange gives V and both N.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES, U64, _BASE, bucket_cuts, hash_tokens, mix, pack_sorted, planes, settled, string_buffers, text_bytes, tidy, unpack_sorted, unplanes

ALPHA = 0.5
MU = 5.0
_BEGIN, _END = U64(0x5F1D36F7A1B2C3D5), U64(0xA24BAED4963EE407)


def _events(table: pa.Table):
    """Of a chunk: its documents (rows without the marker rows of labels), words, bigrams, histories, event offsets."""
    is_doc = table.column("__kind").to_numpy() == 0
    labelled = table.filter(pa.array(~is_doc)).column("doc_id").drop_null().to_numpy()
    docs = table.filter(pa.array(is_doc))
    docs = docs.filter(docs.column("text").is_valid())
    data, offsets = string_buffers(docs.column("text"))
    h, _, _, tok = hash_tokens(data, offsets, "word")
    cur, before = np.insert(h, tok[1:], _END), np.insert(h, tok[:-1], _BEGIN)
    pair = mix(mix(before * U64(_BASE)) + cur)
    # a history is counted by its word; the begin mark occurs as often as the end mark
    history = np.where(before == _BEGIN, _END, before)
    ids = docs.column("doc_id")
    wanted = np.isin(ids.fill_null(0).to_numpy(), labelled) & ids.is_valid().to_numpy()
    return docs, cur, pair, history, tok + np.arange(len(tok)), wanted


def _ask(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("__chunk")[0].as_py()
        _, cur, pair, _, at, wanted = _events(table)
        target = np.repeat(wanted, np.diff(at))
        rows = {k: [] for k in ("bucket", "chunk", "words", "w_all", "w_target", "pairs", "p_all", "p_target", "n_all", "n_target")}
        parts = []
        for keys in (cur, pair):
            u, inv, n = np.unique(keys, return_inverse=True, return_counts=True)
            t = np.bincount(inv[target], minlength=len(u)) if len(u) else np.zeros(0, np.int64)
            parts.append((u, n.astype(np.uint32), t.astype(np.uint32), bucket_cuts(u, n_buckets)))
        (wu, wn, wt, wc), (pu, pn, pt, pc) = parts
        totals = (len(cur), int(target.sum()))
        for b in np.flatnonzero(np.diff(wc) + np.diff(pc)):
            i, j, k, m = wc[b], wc[b + 1], pc[b], pc[b + 1]
            for name, v in zip(
                rows,
                (b, chunk, pack_sorted(wu[i:j]), planes(wn[i:j]), planes(wt[i:j]), pack_sorted(pu[k:m]), planes(pn[k:m]), planes(pt[k:m]), *totals),
            ):
                rows[name].append(v)
            totals = (0, 0)
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
        return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(rows.items(), kinds)})

    return run


_ASKED = "bucket int, chunk int, words binary, w_all binary, w_target binary, pairs binary, p_all binary, p_target binary, n_all long, n_target long"


def _totals(table: pa.Table) -> pa.Table:
    words = [unpack_sorted(b) for b in table.column("words").to_pylist()]
    n = [sum(table.column(c).to_pylist()) for c in ("n_all", "n_target")]
    return pa.table({"v": [len(np.unique(np.concatenate(words)))], "n_all": [n[0]], "n_target": [n[1]]})


def _sums(blobs: list[np.ndarray], counts: list[list[np.ndarray]]) -> list[list[bytes]]:
    keys = np.concatenate(blobs)
    cuts = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    _, inv = np.unique(keys, return_inverse=True)
    out = []
    for c in counts:
        total = np.bincount(inv, weights=np.concatenate(c).astype(np.float64)) if len(inv) else np.zeros(0)
        each = total[inv].astype(np.uint64)
        narrow = each.astype(np.uint32) if not len(each) or each.max() < 1 << 32 else each
        out.append([planes(narrow[i:j]) for i, j in zip(cuts, cuts[1:])])
    return out


def _answer(table: pa.Table) -> pa.Table:
    out = {"chunk": table.column("chunk"), "bucket": table.column("bucket")}
    for key, names in (("words", ("w_all", "w_target")), ("pairs", ("p_all", "p_target"))):
        blobs = [unpack_sorted(b) for b in table.column(key).to_pylist()]
        out[f"n_{key}"] = pa.array([len(b) for b in blobs], pa.int32())
        summed = _sums(blobs, [[unplanes(b, np.uint32) for b in table.column(n).to_pylist()] for n in names])
        for name, s in zip(names, summed):
            out[name] = pa.array(s, pa.binary())
    return pa.table(out)


_ANSWERED = "chunk int, bucket int, n_words int, w_all binary, w_target binary, n_pairs int, p_all binary, p_target binary"


def _wide(blob: bytes, n: int) -> np.ndarray:
    return unplanes(blob, np.uint64 if n and len(blob) == 8 * n else np.uint32).astype(np.float64)


def _score(alpha: float, mu: float, leave_out: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = {"doc_id": pa.int64(), "n_events": pa.int64(), "ce_target": pa.float64(), "ce_background": pa.float64(), "ce_diff": pa.float64()}
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in empty.items()})
        docs, cur, pair, history, at, wanted = _events(table)
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in empty.items()})
        order = np.argsort(answers.column("bucket").to_numpy()).tolist()
        v, n_all, n_target = (answers.column(c)[0].as_py() for c in ("v", "total_all", "total_target"))
        words, winv = np.unique(cur, return_inverse=True)
        _, pinv = np.unique(pair, return_inverse=True)
        hinv = np.searchsorted(words, history)
        size = np.diff(at)
        row = np.repeat(np.arange(len(size)), size)
        own_p, own_w, own_h, own_n = (np.zeros(len(row)),) * 4
        if leave_out:
            _, inv, n = np.unique(row * (int(pinv.max()) + 1) + pinv, return_inverse=True, return_counts=True)
            own_p = n[inv].astype(float)
            u, inv, n = np.unique(row * len(words) + winv, return_inverse=True, return_counts=True)
            own_w, own_h = n[inv].astype(float), n[np.searchsorted(u, row * len(words) + hinv)].astype(float)
            own_n = size[row].astype(float)
        losses = []
        n_w, n_p = answers.column("n_words").to_pylist(), answers.column("n_pairs").to_pylist()
        for which, total in (("target", n_target), ("all", n_all)):
            w, p = (answers.column(f"{x}_{which}").to_pylist() for x in "wp")
            cw = np.concatenate([_wide(w[i], n_w[i]) for i in order])
            cp = np.concatenate([_wide(p[i], n_p[i]) for i in order])
            inside = wanted[row] if which == "target" else np.ones(len(row), bool)
            p1 = (cw[winv] - own_w * inside + alpha) / (total - own_n * inside + alpha * v)
            loss = -np.log((cp[pinv] - own_p * inside + mu * p1) / (cw[hinv] - own_h * inside + mu))
            losses.append(np.add.reduceat(loss, at[:-1]) / size)
        t, b = losses
        return pa.table({"doc_id": docs.column("doc_id"), "n_events": pa.array(np.diff(at), pa.int64()), "ce_target": pa.array(t), "ce_background": pa.array(b), "ce_diff": pa.array(t - b)})

    return run


def _spread(texts: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Texts and marks (rows of kind 1) of labelled ids, by chunk: a text meets its id's mark.

    Rows of one id share a chunk, but for ids that a thousandth of all rows or more has (so at most 1000 ids): their rows are
    spread over all chunks, and so are copies of their marks.  Null ids are never labelled and spread like these.
    """
    ids = texts.groupBy("doc_id").count().filter("doc_id is not null")
    rows = texts.count()
    often = [r["doc_id"] for r in ids.filter(F.col("count") >= max(1000, rows / 1000)).select("doc_id").collect()]
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))
    alone = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    hot = F.col("doc_id").isin(often) if often else F.lit(False)
    marks = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    every = F.when(hot, F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).otherwise(F.array(alone))
    marks = marks.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(1).alias("__kind"), F.explode(every).alias("__chunk")).withColumn("__chunk", F.col("__chunk").cast("int"))
    texts = texts.select("doc_id", "text", F.lit(0).alias("__kind"), F.when(hot | F.col("doc_id").isNull(), place).otherwise(alone).cast("int").alias("__chunk"))
    return texts.unionByName(marks).repartition("__chunk")


def score(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, mu: float = MU, n_chunks: int | None = None, leave_out: bool = True) -> DataFrame:
    """doc_id, n_events, ce_target, ce_background (nats per event) and ce_diff, low where a document is like the target.

    A null text is no document: it has no row and counts nowhere.  An empty text has one event.  Repeated rows count each
    time and are scored each time.  A null id is never labelled.  Several labels of one id count once.  With no (other)
    labelled document the target model is uniform.  Other columns are not read.  Without ``leave_out`` a document's own events
    count too.
    """
    texts = settled(docs.select("doc_id", "text"))
    n = n_chunks or max(1, -(-text_bytes(texts) // CHUNK_BYTES))
    spread = _spread(texts, labels, n)
    asked = spread.groupBy("__chunk").applyInArrow(tidy(_ask(n)), _ASKED).repartition("bucket")
    totals = asked.groupBy("bucket").applyInArrow(_totals, "v long, n_all long, n_target long")
    totals = totals.agg(F.sum("v").alias("v"), F.sum("n_all").alias("total_all"), F.sum("n_target").alias("total_target"))
    answers = asked.groupBy("bucket").applyInArrow(tidy(_answer), _ANSWERED).crossJoin(F.broadcast(totals))  # one row
    out = "doc_id long, n_events long, ce_target double, ce_background double, ce_diff double"
    return spread.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(_score(alpha, mu, leave_out)), out)


def oracle(alpha: float = ALPHA, mu: float = MU, digits: int = 6) -> str:
    """DuckDB SQL for ``score`` over documents and labels, losses rounded."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_append(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+'), '</s>') AS tok,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS wanted
  FROM documents WHERE text IS NOT NULL
), e AS (
  SELECT r, doc_id, wanted, tok[i] AS w, CASE WHEN i = 1 THEN '</s>' ELSE tok[i - 1] END AS h, i = 1 AS first
  FROM (SELECT r, doc_id, wanted, tok, unnest(range(1, len(tok) + 1)) AS i FROM d)
), one AS (
  SELECT w, count(*) AS a, count(*) FILTER (wanted) AS t FROM e GROUP BY w
), two AS (
  SELECT h, first, w, count(*) AS a, count(*) FILTER (wanted) AS t FROM e GROUP BY h, first, w
), n AS (
  SELECT sum(a)::DOUBLE AS a, sum(t)::DOUBLE AS t, count(*)::DOUBLE AS v FROM one
), own AS (
  SELECT r, w, count(*) AS k FROM e GROUP BY r, w
), mine AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(wanted)::INT AS inside, h, first, w, count(*) AS k, any_value(size) AS size
  FROM (SELECT *, count(*) OVER (PARTITION BY r) AS size FROM e) GROUP BY r, h, first, w
), loss AS (
  SELECT m.r, m.doc_id, m.k,
    -ln((two.t - m.k * inside + {mu} * (one.t - ow.k * inside + {alpha}) / (n.t - size * inside + {alpha} * n.v)) / (hist.t - oh.k * inside + {mu})) AS t,
    -ln((two.a - m.k + {mu} * (one.a - ow.k + {alpha}) / (n.a - size + {alpha} * n.v)) / (hist.a - oh.k + {mu})) AS a
  FROM mine m JOIN two ON m.h = two.h AND m.first = two.first AND m.w = two.w
  JOIN one ON m.w = one.w JOIN one hist ON m.h = hist.w
  JOIN own ow ON ow.r = m.r AND ow.w = m.w JOIN own oh ON oh.r = m.r AND oh.w = m.h CROSS JOIN n
)
SELECT doc_id, sum(k)::BIGINT AS n_events, round(sum(k * t) / sum(k), {digits}) AS ce_target, round(sum(k * a) / sum(k), {digits}) AS ce_background,
  round(sum(k * t) / sum(k) - sum(k * a) / sum(k), {digits}) AS ce_diff
FROM loss GROUP BY r, doc_id
"""
