import pytest

from glyphward.llm import source_mix as M


def brute(rows, weights, other=1.0):
    import hashlib

    chars, out = {}, []
    for _, s, t in rows:
        chars[s] = chars.get(s, 0) + len(t or "")
    w = {s: (weights.get(s, other) if c else 0.0) for s, c in chars.items()}
    for s, c in chars.items():
        step = int(w[s] / sum(w.values()) * sum(chars.values()) / c * M.SCALE + 0.5) if c else M.SCALE
        offset = int(hashlib.md5(f"{chr(0) if s is None else s}|{M.SEED}".encode()).hexdigest()[:8], 16) % M.SCALE
        line = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0))
        for k, r in enumerate(line):
            n = ((k + 1) * step + offset) // M.SCALE - (k * step + offset) // M.SCALE
            out += [(r[0], s, c) for c in range(1, n + 1)]
    return sorted(out, key=repr)


ROWS = [(i, f"src{i % 4}", "x" * (i % 13)) for i in range(300)] + [(None, "src1", None), (900, None, "abc"), (901, None, ""), (902, "blank", ""), (903, "blank", None)]


@pytest.mark.parametrize("per_range", [20_000, 30, 2])
def test_equals_brute_force(spark, per_range):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    weights = {"src0": 3.0, "src1": 0.4}
    got = M.mix(df, weights, rows_per_range=per_range).select("doc_id", "source", "copy_no")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS, weights)


def test_shares_reach_the_target(spark):
    rows = [(i, "a" if i % 10 else "b", "x" * 10) for i in range(2000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), {"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 1000) <= 1 for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", "t", 5, "k"), (1, "a", "t", 5, "k")], "doc_id long, source string, text string, copy_no int, weight string")
    got = M.mix(df)
    assert got.columns == ["doc_id", "source", "text", "weight", "copy_no"] and got.count() == 2
    assert M.mix(df.limit(0)).count() == 0
