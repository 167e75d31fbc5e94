import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphward.llm import lm_score as S


def brute(docs, good, alpha=S.ALPHA, mu=S.MU):
    toks = [(i, re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t)) + ["</s>"]) for i, t in docs if t is not None]
    v = len({x for _, w in toks for x in w})
    out = []
    for k, (i, w) in enumerate(toks):
        ce = []
        for pick in (lambda i: i is not None and i in good, lambda i: True):
            one, two = Counter(), Counter()
            for at, (j, x) in enumerate(toks):
                if pick(j) and at != k:
                    one.update(x)
                    two.update(zip(["<s>", *x], x))
            n = sum(one.values())
            h = lambda x: one["</s>"] if x == "<s>" else one[x]  # noqa: B023, E731
            p = [(two[a, b] + mu * (one[b] + alpha) / (n + alpha * v)) / (h(a) + mu) for a, b in zip(["<s>", *w], w)]
            ce.append(-sum(map(math.log, p)) / len(p))
        out.append((i, len(w), *[round(x, 9) for x in (*ce, ce[0] - ce[1])]))
    return sorted(out, key=repr)


DOCS = [(1, "the cat sat on the mat"), (2, "The dog sat."), (3, ""), (4, None), (5, "zzz " * 30), (5, "zzz " * 30), (None, "the cat"), (6, "é ß the"), (7, "a b " * 40_000)]


@pytest.mark.parametrize("chunks", [1, 4])
def test_equals_brute_force(spark, chunks):
    docs = spark.createDataFrame([(i, t, 0, "b") for i, t in DOCS], "doc_id long, text string, quality int, bucket string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (6, 1, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(((r["doc_id"], r["n_events"], *[round(r[c], 9) for c in ("ce_target", "ce_background", "ce_diff")]) for r in S.score(docs, labels, n_chunks=chunks).collect()), key=repr)
    want = brute(DOCS, {1, 6})
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for a, b in zip(got, want):
        assert a[2:] == pytest.approx(b[2:], abs=1e-6)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert S.score(docs, labels).count() == 8 and S.score(docs.limit(0), labels).count() == 0


def test_equal_rows_and_null_ids_are_spread(spark):
    rows = [(5, "the same text")] * 4000 + [(None, "no id")] * 4000 + [(k, f"own text {k}") for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (11, 1)], "doc_id long, quality int")
    counts = {r["__chunk"]: r["count"] for r in S._spread(docs, labels, 16).filter("__kind = 0").groupBy("__chunk").count().collect()}
    assert len(counts) == 16 and max(counts.values()) < 1000
    got = S.score(docs, labels, n_chunks=16)
    assert got.count() == len(rows) and got.filter("doc_id = 5").select(F.round("ce_target", 6)).distinct().count() == 1
    whole = S.score(docs, labels, n_chunks=1)
    cols = ["doc_id", "n_events", *[F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "ce_diff")]]
    assert got.select(*cols).exceptAll(whole.select(*cols)).count() == 0


def test_a_second_copy_is_told_from_a_text_alone(spark):
    """Left out of its own model, a text that occurs once looks strange; one that occurs twice does not."""
    rows = [(k, " ".join(f"w{(k * 7919 + x * x) % 5003}" for x in range(80))) for k in range(40)]
    docs = spark.createDataFrame(rows + [(100 + k, rows[k][1]) for k in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: r["ce_background"] for r in S.score(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert max(got[k] for k in range(5)) < min(got[k] for k in range(5, 40))
