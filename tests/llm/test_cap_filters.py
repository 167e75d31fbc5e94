import numpy as np
import pytest
from tests.comparing import duck

from glyphward.llm import cap_filters as C


def planted(n=1500, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for k, cos in enumerate(np.linspace(0.951, 0.999, 300)):
        w = rng.standard_normal(dim)
        w -= w @ v[k] * v[k]
        v[600 + k] = cos * v[k] + np.sqrt(1 - cos**2) * w / np.linalg.norm(w)
    for k in range(40):  # one cluster
        v[1000 + k] = v[999] + 0.01 * rng.standard_normal(dim)
    return v


def pairs(v):
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u @ u.T
    return set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(cos >= C.THRESHOLD, 1)))))


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("split", [C.SPLIT, 7])
def test_recall_and_precision(spark, split):
    v = planted()
    want = pairs(v)
    nodes = table(spark, v).withColumnRenamed("vec_id", "node")
    got = [(r["a"], r["b"]) for r in C.links(nodes, C.THRESHOLD, C.PASSED, C.PER_VECTOR, split).collect()]
    assert len(set(got)) == len(got) and set(got) <= want and len(got) >= 0.97 * len(want) > 900


def test_classes_equal_sql(spark, tmp_path):
    """Planted pairs at a cosine at which none is missed, a cluster, copies, repeated ids, nulls."""
    v = planted()
    v[600:900] = v[:300] + 0.005 * v[300:600]
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))] + [(5000 + i, v[0].astype(np.float32).tolist()) for i in range(20)]
    rows += [(7, v[9].astype(np.float32).tolist()), (None, v[1].astype(np.float32).tolist()), (None, None), (6000, None), (6001, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, C.similar(spark.read.parquet(str(tmp_path / "embeddings.parquet"))).collect()), key=repr)
    assert got == sorted(duck(str(tmp_path)).sql(C.oracle()).fetchall(), key=repr)
    assert sum(n > 0 for _, _, n in got) > 600


def test_blocks_grow_with_the_table():
    sizes = [(C.Code(64, n).blocks, C.Code(64, n).size) for n in (10**3, 10**6, 10**10)]
    assert [b for b, _ in sizes] == [2, 2, 4] and all(s <= C.WORDS for _, s in sizes)


def test_lists_every_filter_that_exceeds():
    v = planted()[:200]
    c = C.Code(64, 200)
    rows, number = c.decode(v)
    r = v @ c.rotation
    whole = np.concatenate([np.repeat(c.words[0], c.size, 0), np.tile(c.words[1], (c.size, 1))], axis=1)
    p = r @ whole.T
    alpha = np.minimum(c.alpha, p.max(axis=1) - C.SLACK)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(p >= alpha[:, None] - 1e-12))))
    assert set(zip(rows.tolist(), number.tolist())) == want and len(np.unique(rows)) == 200


def test_edges(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    nan = float("nan")
    rows = [(1, a), (2, [2.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (3, b), (4, None), (5, []), (6, [0.0] * 4), (7, [nan, 1.0, 0.0, 0.0]), (8, [1.0, None, 0.0, 0.0]), (None, a), (9, [1.0, 0.0]), (10, [1.0, 0.01])]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<float>, dim int, filter int")
    got = sorted(((r["vec_id"], r["class_id"], r["n_links"]) for r in C.similar(df).collect()), key=repr)
    own = [(i, i, 0) for i in (3, 4, 5, 6, 7, 8)]
    assert got == sorted([(1, 1, 3), (2, 1, 3), (2, 1, 3), (None, 1, 3), (9, 9, 1), (10, 9, 1), *own], key=repr)
    assert C.similar(df.limit(0)).count() == 0
