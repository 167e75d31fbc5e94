"""Operator 1: language by family first, then by one-versus-one linear support vector machines within the family.

Features are relative frequencies of byte n-grams (1 to 4 bytes, ASCII and Latin-1 letters lower-cased, everything that is
no letter a blank), hashed to ``DIMS`` columns.  Each column is scaled by the root of its mean frequency, which a linear
model folds into its weights, so a text's score is a mean of table entries and never needs its feature vector.

The machines (squared hinge loss) are fitted on a bounded sample of labelled rows, ``rows_per_language`` whole texts of
each language, those whose ids have the least hashes.  Everything else covers all rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import slices, string_buffers, tidy

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
DIMS = 1 << 13
#: Bound of the training sample.
ROWS_PER_LANGUAGE = 300
#: A text whose least deciding margin is under this is rejected: it lies where the classes' texts lie on neither side.
MIN_MARGIN = 0.02
_ORDERS = (1, 2, 3, 4)
_STEP = 1 << 18


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_TABLE = _letters()


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes reduced to lower-case letters and single blanks, and the rows' new offsets."""
    m = _TABLE[data]
    if len(m) > 1:  # capital letters of U+00C0..U+00DE
        upper = (m[1:] >= 0x80) & (m[1:] <= 0x9E) & (m[1:] != 0x97) & (m[:-1] == 0xC3)
        m[1:][upper] += 0x20
    blank = m == 32
    keep = np.ones(len(m), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    heads = offsets[:-1][np.diff(offsets) > 0]
    keep[heads] = True
    return m[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def columns(m: np.ndarray, n: int) -> np.ndarray:
    """Hashed column of the n-gram that begins at each byte."""
    g = np.full(max(0, len(m) - n + 1), n * 0x3C6EF372 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        g ^= m[k : len(m) - n + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    g *= np.uint32(2654435761)
    g ^= g >> np.uint32(15)
    g *= np.uint32(2246822519)
    return (g >> np.uint32(32 - 13)).astype(np.intp)


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the machines' sums of mean weights, and whether it has any letter."""
    m, off = normalise(data, offsets)
    n_rows = len(off) - 1
    out = np.zeros((n_rows, len(weights)))
    for n in _ORDERS:
        first, last = off[:-1], off[1:] - n + 1
        some = np.flatnonzero(last > first)
        if not len(some):
            continue
        cols = np.append(columns(m, n), DIMS)  # the last is no n-gram
        edges = np.stack([first[some], last[some]], axis=1).ravel()
        for k in range(len(weights)):
            out[some, k] += np.add.reduceat(weights[k][cols], edges)[::2] / (last - first)[some]
    seen = np.concatenate([[0], np.cumsum(m != 32)])
    return out, seen[off[1:]] > seen[off[:-1]]


def _features(table_rows: list[bytes]) -> np.ndarray:
    x = np.zeros((len(table_rows), DIMS))
    for i, raw in enumerate(table_rows):
        pairs = np.frombuffer(raw, [("c", "<u2"), ("v", "<f4")])
        x[i, pairs["c"]] = pairs["v"]
    return x


def _sample_features(batches):
    for batch in batches:
        data, offsets = string_buffers(batch.column("text"))
        rows = []
        for i, j in zip(offsets, offsets[1:]):
            m, _ = normalise(data[i:j], np.array([0, j - i]))
            x = np.zeros(DIMS)
            for n in _ORDERS:
                if len(m) >= n:
                    x += np.bincount(columns(m, n), minlength=DIMS) / (len(m) - n + 1)
            at = np.flatnonzero(x)
            pairs = np.empty(len(at), [("c", "<u2"), ("v", "<f4")])
            pairs["c"], pairs["v"] = at, x[at]
            rows.append(pairs.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "x"])


def fit_machine(gram: np.ndarray, y: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton's method in the dual: (coefficients of the rows, bias)."""
    n = len(y)
    each = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    k = gram + 1.0  # the bias is a constant column
    active = np.ones(n, bool)
    alpha = np.zeros(n)
    for _ in range(50):
        a = np.flatnonzero(active)
        alpha = np.zeros(n)
        alpha[a] = np.linalg.solve(k[np.ix_(a, a)] + np.diag(1.0 / each[a]), y[a])
        now = y * (k @ alpha) < 1
        if (now == active).all():
            break
        active = now
    return alpha, float(alpha.sum())


class Model:
    """Families, their languages, and a weight column with bias for each machine."""

    def __init__(self, langs: list[str], x: np.ndarray, labels: np.ndarray, c: float = 10.0):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(FAMILY.get(lang, lang), []).append(lang)
        self.names = sorted(self.families)
        scale = 1.0 / np.sqrt(x.mean(axis=0) + 1e-5) if len(x) else np.ones(DIMS)
        z = (x * scale).astype(np.float32)
        family = np.array([FAMILY.get(v, v) for v in labels])
        # of two families one machine says both
        alone = self.names[:1] if len(self.names) == 2 else self.names if len(self.names) > 2 else []
        jobs = [((f,), np.ones(len(z), bool), family == f) for f in alone]
        for f in self.names:
            for a, b in itertools.combinations(self.families[f], 2):
                jobs.append(((a, b), (labels == a) | (labels == b), labels == a))
        self.machines = [key for key, _, _ in jobs]
        self.weights = np.zeros((len(jobs), DIMS + 1))
        self.bias = np.zeros(len(jobs))
        for k, (_, rows, yes) in enumerate(jobs):
            at = np.flatnonzero(rows)
            alpha, self.bias[k] = fit_machine((z[at] @ z[at].T).astype(np.float64), np.where(yes[at], 1.0, -1.0), c)
            self.weights[k, :DIMS] = (alpha @ z[at]) * scale

    def decide(self, data: np.ndarray, offsets: np.ndarray):
        """Per row: family, language, margin (None where there is no letter or no language is known)."""
        s, letters = scores(data, offsets, self.weights)
        s += self.bias
        n = len(letters)
        if not self.names:
            return [None] * n, [None] * n, [None] * n
        at = {key: k for k, key in enumerate(self.machines)}
        best, margin = np.zeros(n, int), np.full(n, np.inf)
        if len(self.names) > 1:
            f = s[:, [at[(x,)] for x in self.names if (x,) in at]]
            f = np.hstack([f, -f]) if f.shape[1] == 1 else f
            best = f.argmax(axis=1)
            top = np.sort(f, axis=1)
            margin = (top[:, -1] - top[:, -2]) / 2
        lang = np.zeros(n, object)
        for i, name in enumerate(self.names):
            langs, rows = self.families[name], np.flatnonzero(best == i)
            votes = np.zeros((len(rows), len(langs)))
            weakest = np.full((len(rows), len(langs)), np.inf)
            for p, q in itertools.combinations(range(len(langs)), 2):
                d = s[rows, at[(langs[p], langs[q])]]
                votes[:, p] += d >= 0
                votes[:, q] += d < 0
                weakest[:, p] = np.minimum(weakest[:, p], d)
                weakest[:, q] = np.minimum(weakest[:, q], -d)
            # most votes; among equals the one whose weakest duel is the least bad, then the first by name
            order = votes + np.clip(weakest, -1e3, 1e3) * 1e-6
            win = order.argmax(axis=1)
            lang[rows] = np.array(langs, object)[win]
            margin[rows] = np.minimum(margin[rows], weakest[np.arange(len(rows)), win])
        margin = np.minimum(margin, 1e3)
        pick = lambda values: [v if ok else None for v, ok in zip(values, letters)]
        return pick([self.names[i] for i in best]), pick(lang), pick(np.round(margin, 6).tolist())


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, c: float = 10.0) -> Model:
    """Machines from rows with text and lang; rows where either or the id is null are no labels.

    At most ``rows_per_language`` ids of each language take part, each with one text (that of the least hash), whatever the
    number of rows under an id.  Other columns are not read.
    """
    known = labelled.select("doc_id", "lang", "text", F.xxhash64("text").alias("th")).filter("lang is not null and text is not null and doc_id is not null")
    ids = known.groupBy("lang", "doc_id").agg(F.min("th").alias("th"))  # an id counts once, however often it occurs
    line = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.col("doc_id"))
    ids = ids.withColumn("n", F.row_number().over(line)).filter(F.col("n") <= rows_per_language).drop("n")
    # at most rows_per_language ids of each language
    chosen = known.join(F.broadcast(ids), ["lang", "doc_id", "th"]).groupBy("lang", "doc_id").agg(F.first("text").alias("text"))
    rows = chosen.select("text", "lang").mapInArrow(_sample_features, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    labels = np.array([r["lang"] for r in rows], object)
    return Model(sorted(set(labels)), _features([bytes(r["x"]) for r in rows]), labels, c)


def identify(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of docs: doc_id, family, predicted, margin, accepted.

    A null or empty text, or one without letters, has null family, predicted and margin and is not accepted; nor is one
    whose margin is under ``min_margin``.  The margin is the weakest that the decision rests on: the family's lead or the
    language's duels.  With one language alone it is 1000; with no labelled row nothing is accepted.  Repeated rows and null
    ids stay; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, _STEP):
                family, lang, margin = model.decide(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(family, pa.string()),
                        pa.array(lang, pa.string()),
                        pa.array(margin, pa.float64()),
                        pa.array([m is not None and m >= min_margin for m in margin]),
                    ],
                    names=["doc_id", "family", "predicted", "margin", "accepted"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, family string, predicted string, margin double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Rows of docs that ``identify`` accepts, unchanged."""

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            ok: list[bool] = []
            for i, j in slices(offsets, _STEP):
                _, _, margin = model.decide(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ok += [m is not None and m >= min_margin for m in margin]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
