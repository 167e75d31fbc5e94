"""Operator 9: near-equal embeddings by spherical-cap filters from structured random product codes.

Rows of one and the same vector are one node, so copies are never compared with each other.

The coordinates of a (randomly rotated) unit vector are divided into blocks (as many as keep a block's code small), each with its own code of random unit
vectors.  A filter is a choice of one code word per block; its direction is the words joined and scaled.  A vector passes
the filters whose direction has an inner product of at least alpha with it; since that product is a sum over blocks, all
of them are listed block by block, without looking at filters that the best of the later blocks could not save.  Vectors meet on common filters, and
meetings are verified.

The number of filters grows in proportion to the number of vectors and alpha follows from it, so that a vector passes about
PASSED filters and meets about PASSED**2 / PER_VECTOR strangers at every size.

An entry of the join is a filter, an id and 128 signs of random projections, 32 bytes: meetings whose signs differ in more
places than all but one in 10**5 pairs at the threshold do are dropped before the vectors are fetched.  A filter that more
than SPLIT vectors pass is joined in pairs of parts of about that size, so no task meets a whole group of near copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_staged, stage_table
from .components import components

THRESHOLD = 0.95
#: Code words of a block at most, two blocks at least.
WORDS = 4096
SPLIT = 1024
PASSED = 32
PER_VECTOR = 16
#: A vector also passes the filters within this of its best one, so that none passes no filter.
SLACK = 0.03
SEED = 20_24
_BITS = 128


def cap_share(alpha: float, dim: int, n: int = 20_001) -> float:
    """Share of a random unit vector's directions within alpha: P(<u, v> >= alpha)."""
    if dim < 2:
        return 0.5
    x = np.linspace(-1, 1, n)
    density = np.maximum(1 - x * x, 0) ** ((dim - 3) / 2) if dim > 3 else np.ones(n)
    total = density.sum()
    return float(density[x >= alpha].sum() / total)


class Code:
    """Code words, threshold and sign projections for one dimension and size of table."""

    def __init__(self, dim: int, n_vectors: int, passed: float = PASSED, per_vector: float = PER_VECTOR, threshold: float = THRESHOLD, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.dim = dim
        self.blocks = min(dim, max(2, math.ceil(math.log(max(2.0, per_vector * n_vectors)) / math.log(WORDS))))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        size = max(8, math.ceil((per_vector * max(n_vectors, 1)) ** (1 / self.blocks)))
        self.cuts = [dim * k // self.blocks for k in range(self.blocks + 1)]
        self.words = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            w = rng.standard_normal((size, b - a))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(self.blocks))
        self.size = size
        want = min(0.5, passed / size**self.blocks)
        lo, hi = 0.0, 1.0
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if cap_share(mid, dim) > want else (lo, mid)
        self.alpha = lo
        self.projection = rng.standard_normal((dim, _BITS))
        p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
        self.most = math.ceil(_BITS * p + 4.3 * math.sqrt(_BITS * p * (1 - p)) + 1)

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that each row of v (unit vectors) passes."""
        r = v @ self.rotation
        rows = np.arange(len(r))
        number = np.zeros(len(r), np.int64)
        have = np.zeros(len(r))
        products = [r[:, a:b] @ w.T for (a, b), w in zip(zip(self.cuts, self.cuts[1:]), self.words)]
        # the best that later blocks can still add
        rest = np.zeros((len(products) + 1, len(r)))
        for k in range(len(products) - 1, -1, -1):
            rest[k] = rest[k + 1] + products[k].max(axis=1)
        alpha = np.minimum(self.alpha, rest[0] - SLACK)
        for k, p in enumerate(products):
            need = alpha[rows] - have - rest[k + 1][rows]
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            step = max(1, (1 << 22) // self.size)
            for i in range(0, len(rows), step):
                at, word = np.nonzero(p[rows[i : i + step]] >= need[i : i + step, None])
                found.append((at + i, word))
            at, word = (np.concatenate(x) for x in zip(*found))
            have = have[at] + p[rows[at], word]
            rows, number = rows[at], number[at] * self.size + word
        return rows, number

    def signs(self, v: np.ndarray) -> np.ndarray:
        return np.packbits(v @ self.projection >= 0, axis=1).view(">i8").astype(np.int64)


_CODES: dict[tuple, Code] = {}


def code_for(*key) -> Code:
    """One per Python worker and table."""
    if key not in _CODES:
        if len(_CODES) > 8:
            _CODES.clear()
        _CODES[key] = Code(*key)
    return _CODES[key]


def unit_rows(column: pa.Array, dim: int | None = None):
    """Rows that are vectors (not null, no null or non-finite element, not zero) by dimension: {dim: (rows, unit vectors)}."""
    lists = column.to_pylist() if not isinstance(column, pa.ListArray) else None
    out: dict[int, tuple[list, list]] = {}
    if lists is None:
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        if column.null_count == 0 and flat.null_count == 0 and len(sizes) and (sizes == sizes[0]).all() and sizes[0]:
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, sizes[0])
            norm = np.linalg.norm(x, axis=1)
            good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            return {int(sizes[0]): (good, x[good] / norm[good, None])} if len(good) else {}
        lists = column.to_pylist()
    for i, v in enumerate(lists):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            rows, xs = out.setdefault(len(v), ([], []))
            rows.append(i)
            xs.append(v)
    result = {}
    for d, (rows, xs) in out.items():
        x = np.array(xs, np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        fine = np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
        result[d] = np.array(rows)[fine], x[fine] / norm[fine]
    return result


def entries(vectors: DataFrame, n_vectors: int, passed: float, per_vector: float, threshold: float) -> DataFrame:
    """dim, filter, vec_id, s0, s1 for every filter that a vector passes."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                ids = part.column("vec_id").to_numpy()
                for dim, (rows, v) in unit_rows(part.column("embedding")).items():
                    code = code_for(dim, n_vectors, passed, per_vector, threshold)
                    step = max(1, (1 << 22) // code.size)
                    for i in range(0, len(v), step):
                        at, number = code.decode(v[i : i + step])
                        sign = code.signs(v[i : i + step])[at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(at), dim, np.int32)),
                                pa.array(number),
                                pa.array(ids[rows[i : i + step][at]]),
                                pa.array(np.ascontiguousarray(sign[:, 0])),
                                pa.array(np.ascontiguousarray(sign[:, 1])),
                            ],
                            names=["dim", "filter", "vec_id", "s0", "s1"],
                        )

    return vectors.select("vec_id", "embedding").mapInArrow(run, "dim int, filter long, vec_id long, s0 long, s1 long")


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            a, b = unit_pairs(batch.column("x"), batch.column("y"))
            cosine = np.einsum("ij,ij->i", a, b) if len(a) else np.zeros(0)
            keep = cosine >= threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in "ab"], names=["a", "b"]
            )

    return run


def unit_pairs(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of two columns whose rows agree in dimension; columns are as wide as the widest, with zeros."""
    out = []
    for column in (x, y):
        sizes = np.diff(column.offsets.to_numpy())
        wide = int(sizes.max()) if len(sizes) else 0
        v = np.zeros((len(sizes), wide))
        v[np.arange(wide)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        out.append(v / np.linalg.norm(v, axis=1, keepdims=True) if len(v) else v)
    return out[0], out[1]


def _node() -> Column:
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return F.when(sound, F.xxhash64("embedding"))


def links(nodes: DataFrame, threshold: float, passed: float, per_vector: float, split: int) -> DataFrame:
    """a < b: nodes (node, embedding) whose cosine is at least threshold, each pair once."""
    n = nodes.count()
    base = nodes.select(F.col("node").alias("vec_id"), "embedding")
    met = stage_table(entries(base, n, passed, per_vector, threshold), "caps")
    most = {d["dim"]: Code(d["dim"], n, passed, per_vector, threshold).most for d in met.select("dim").distinct().collect()}
    limit = F.lit(0)
    for dim, m in sorted(most.items()):  # a dimension is a kind of embedding; there are few
        limit = F.when(F.col("dim") == dim, F.lit(m)).otherwise(limit)
    crowds = met.groupBy("dim", "filter").count().filter(F.col("count") > 1).select("dim", "filter", F.ceil(F.col("count") / split).cast("int").alias("parts"))
    met = met.join(crowds, ["dim", "filter"])
    part, other = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    left = met.select("dim", "filter", part.alias("p"), F.explode(other).alias("q"), F.col("vec_id").alias("a"), F.col("s0").alias("a0"), F.col("s1").alias("a1"))
    right = met.select("dim", "filter", part.alias("q"), F.explode(other).alias("p"), F.col("vec_id").alias("b"), F.col("s0").alias("b0"), F.col("s1").alias("b1"))
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    pairs = left.join(right, ["dim", "filter", "p", "q"]).filter((F.col("a") < F.col("b")) & (apart <= limit)).select("a", "b").distinct()
    x = nodes.select(F.col("node").alias("a"), F.col("embedding").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("embedding").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a long, b long")


def similar(vectors: DataFrame, threshold: float = THRESHOLD, passed: float = PASSED, per_vector: float = PER_VECTOR, split: int = SPLIT) -> DataFrame:
    """vec_id, class_id, n_links: one row for each row of vectors.

    A row is linked with every other row whose vector's cosine is at least threshold, all but a small share of which are
    found; ``n_links`` counts them, copies included.  Links connect classes; ``class_id`` is the least id in the class.

    Vectors that are null, empty, zero or hold a null or non-finite element have no link and their own id as class; only
    vectors of one dimension are compared.  Repeated rows are rows like others, also under one id.  A null id is an id
    unknown, so a class of such rows alone has a null class_id.  Other columns are not read.  Vectors are told apart by 64-bit
    hashes.
    """
    rows = vectors.select("vec_id", "embedding").withColumn("node", _node())
    nodes = rows.filter("node is not null").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = stage_table(nodes, "vectors")
    found = stage_table(links(nodes, threshold, passed, per_vector, split), "links")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = nodes.select("node", "copies", "least")
    degree = both.join(counts.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("links"))
    of = counts.join(degree, "node", "left").join(components(found), "node", "left").filter("copies > 1 or links > 0")
    of = of.withColumn("component", F.coalesce("component", "node"))
    lead = of.groupBy("component").agg(F.min("least").alias("class_id"))
    of = stage_table(of.join(lead, "component").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "linked")
    drop_staged(found)
    drop_staged(nodes)
    ids = rows.select("vec_id", "node")
    linked = ids.filter("node is not null").join(of.withColumn("in_class", F.lit(True)), "node", "left")
    linked = linked.select("vec_id", F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("vec_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return linked.unionByName(ids.filter("node is null").select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``similar`` over embeddings, comparing all pairs and following links."""
    return f"""
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
), u AS (
  SELECT r, v, sqrt(list_inner_product(v, v)) AS norm FROM e WHERE v IS NOT NULL AND len(v) > 0 AND list_inner_product(v, v) > 0
), link AS (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= {threshold}
), reach AS (
  SELECT r, r AS x FROM e
  UNION
  SELECT reach.r, link.b FROM reach JOIN link ON reach.x = link.a
), class AS (
  SELECT reach.r, min(e.vec_id) AS class_id FROM reach JOIN e ON e.r = reach.x GROUP BY 1
), degree AS (
  SELECT a, count(*) AS n FROM link GROUP BY 1
)
SELECT e.vec_id, class_id, coalesce(degree.n, 0)::BIGINT AS n_links FROM e JOIN class USING (r) LEFT JOIN degree ON degree.a = e.r
"""
