"""Operator 3: passages that occur more than once, found by Rabin-Karp hashes of every fixed-length token window.

Tokens are runs of anything but ASCII white space, compared as written.  A window of ``window`` tokens is repeated when its
hash occurs at least twice in the whole table, in one text or in several; overlapping and touching repeated windows merge
into maximal intervals, and every occurrence is removed.

The plan has two exchanges of packed keys.  Texts are spread over chunks.  A chunk sends its distinct window hashes, each
with a bit that says whether it occurs twice already, in equal ranges of the hash space (about six bytes a window); a range
counts over all chunks and answers each chunk with one bit per hash.  So a passage that millions of texts share costs each
chunk one key.  Texts move once: the chunks' exchange serves both asking and applying the answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import CHUNK_BYTES, U64, bucket_cuts, hash_tokens, mix, pack_sorted, powers, settled, string_buffers, text_bytes, tidy, unpack_sorted, with_chunk

WINDOW = 50


def window_hashes(h: np.ndarray, tok: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows that lie inside one text, and the token each begins at."""
    n = len(h)
    if n < window:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(h * powers(n), out=sums[1:])
    rolled = (sums[window:] - sums[:-window]) * powers(n - window + 1, inverse=True)
    inside = np.ones(n - window + 1, bool)
    # a window that begins less than `window` tokens before the end of its text crosses into the next
    ends = np.repeat(tok[1:], np.diff(tok))[: n - window + 1]
    inside = np.arange(n - window + 1) + window <= ends
    return mix(rolled[inside]), np.flatnonzero(inside)


def _ask(window: int, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("__chunk")[0].as_py()
        data, offsets = string_buffers(table.column("text"))
        h, _, _, tok = hash_tokens(data, offsets, "space")
        keys, counts = np.unique(window_hashes(h, tok, window)[0], return_counts=True)
        cuts = bucket_cuts(keys, n_buckets)
        used = np.flatnonzero(np.diff(cuts))
        return pa.table(
            {
                "bucket": pa.array(used.astype(np.int32)),
                "chunk": pa.array(np.full(len(used), chunk, np.int32)),
                "keys": pa.array([pack_sorted(keys[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
                "again": pa.array([np.packbits(counts[cuts[b] : cuts[b + 1]] > 1).tobytes() for b in used], pa.binary()),
            }
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    blobs = [unpack_sorted(b) for b in table.column("keys").to_pylist()]
    sizes = [len(b) for b in blobs]
    again = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool) for a, n in zip(table.column("again").to_pylist(), sizes)])
    keys = np.concatenate(blobs)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    hit = np.zeros(len(k), bool)
    hit[1:] |= same
    hit[:-1] |= same
    again[order] |= hit
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    bits = [np.packbits(again[i:j]).tobytes() for i, j in zip(cuts, cuts[1:])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _repeated(texts: pa.ChunkedArray, answers: pa.Table, window: int):
    """Of a chunk: bytes, row offsets, token starts, token offsets, and the intervals (row, first token, last token + 1)."""
    data, offsets = string_buffers(texts)
    h, starts, _, tok = hash_tokens(data, offsets, "space")
    hashes, at = window_hashes(h, tok, window)
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return data, offsets, starts, tok, (none, none, none)
    _, inverse = np.unique(hashes, return_inverse=True)
    order = np.argsort(answers.column("bucket").to_numpy())
    bits, sizes = answers.column("bits").to_pylist(), answers.column("n").to_pylist()
    flags = np.concatenate([np.unpackbits(np.frombuffer(bits[i], np.uint8), count=sizes[i]) for i in order]).astype(bool)
    first = at[flags[inverse]]
    depth = np.zeros(len(h) + 1, np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + window, -1)
    covered = np.cumsum(depth[:-1]) > 0
    # an interval ends with its text
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(tok))
    change = np.flatnonzero(covered[1:] & covered[:-1] & (rows[1:] != rows[:-1])) + 1
    b, e = runs(covered)
    b, e = np.sort(np.concatenate([b, change])), np.sort(np.concatenate([e, change]))
    return data, offsets, starts, tok, (rows[b], b, e)


def _spread(docs: DataFrame, window: int, n_chunks: int | None):
    n = n_chunks or max(1, -(-text_bytes(docs) // CHUNK_BYTES))
    spread = with_chunk(settled(docs), n).repartition("__chunk")
    asked = spread.groupBy("__chunk").applyInArrow(tidy(_ask(window, n)), "bucket int, chunk int, keys binary, again binary")
    answers = asked.groupBy("bucket").applyInArrow(tidy(_answer), "chunk int, bucket int, n int, bits binary")
    return spread.groupBy("__chunk"), answers.groupBy("chunk")


def intervals(docs: DataFrame, window: int = WINDOW, n_chunks: int | None = None) -> DataFrame:
    """doc_id, start_token, end_token: the maximal repeated intervals, tokens counted from 0, the end exclusive.

    A null or empty text has none, and neither has a text of fewer than ``window`` tokens.  Repeated rows are occurrences
    like any others, so their whole texts are intervals.  A null id stays null.  Other columns are not read.
    """

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows, b, e = (np.zeros(0, np.int64),) * 3
        if chunk.num_rows:
            _, _, _, tok, (rows, b, e) = _repeated(chunk.column("text"), answers, window)
            b, e = b - tok[rows], e - tok[rows]
        ids = chunk.column("doc_id").take(pa.array(rows)) if chunk.num_rows else pa.array([], pa.int64())
        return pa.table({"doc_id": ids, "start_token": pa.array(b, pa.int64()), "end_token": pa.array(e, pa.int64())})

    left, right = _spread(docs.select("doc_id", "text"), window, n_chunks)
    return left.cogroup(right).applyInArrow(tidy(run), "doc_id long, start_token long, end_token long")


def remove(docs: DataFrame, window: int = WINDOW, n_chunks: int | None = None) -> DataFrame:
    """Rows of docs with all repeated intervals cut out of ``text``; ``n_chars``, where docs has it, is counted anew.

    A cut goes from the interval's first token to the next token that stays, or to the end of the text.  Every row stays,
    also one whose text becomes empty; a null text stays null.  Names beginning with two underscores are ours.
    """
    names = docs.columns
    schema = T.StructType([f for f in docs.schema.fields])

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return chunk.select(names)
        data, offsets, starts, tok, (rows, b, e) = _repeated(chunk.column("text"), answers, window)
        texts = chunk.column("text").to_pylist()
        counts = chunk.column("n_chars").to_pylist() if "n_chars" in names else None
        cuts: dict[int, list[tuple[int, int]]] = {}
        for r, i, j in zip(rows.tolist(), b.tolist(), e.tolist()):
            end = int(starts[j]) if j < tok[r + 1] else int(offsets[r + 1])
            cuts.setdefault(r, []).append((int(starts[i]), end))
        for r, spans in cuts.items():
            kept, at = [], int(offsets[r])
            for i, j in spans:
                kept.append(data[at:i].tobytes())
                at = j
            kept.append(data[at : offsets[r + 1]].tobytes())
            texts[r] = b"".join(kept).decode()
            if counts is not None:
                counts[r] = len(texts[r])
        for name, values in (("text", texts), ("n_chars", counts)):
            if values is not None:
                k = chunk.schema.get_field_index(name)
                chunk = chunk.set_column(k, name, pa.array(values, chunk.schema.field(k).type))
        return chunk.select(names)

    left, right = _spread(docs, window, n_chunks)
    return left.cogroup(right).applyInArrow(tidy(run), schema)


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for ``intervals`` over documents, comparing the windows' words themselves."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS tok FROM documents
), w AS (
  SELECT r, doc_id, i, array_to_string(tok[i + 1 : i + {window}], ' ') AS words
  FROM (SELECT r, doc_id, tok, unnest(range(0, len(tok) - {window - 1})) AS i FROM d WHERE len(tok) >= {window})
), again AS (
  SELECT words FROM w GROUP BY words HAVING count(*) > 1
), hit AS (
  SELECT r, doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {window} THEN 0 ELSE 1 END AS opens
  FROM w WHERE words IN (SELECT words FROM again)
), grouped AS (
  SELECT r, doc_id, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS g FROM hit
)
SELECT doc_id, min(i)::BIGINT AS start_token, (max(i) + {window})::BIGINT AS end_token FROM grouped GROUP BY r, doc_id, g
"""
