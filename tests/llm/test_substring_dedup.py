import random

from hypothesis import given, settings, strategies as st

import numpy as np

from glyphward.llm import substring_dedup as S
from glyphward.llm.common import TABLES, hash_tokens


def brute(rows, window):
    toks = [(i, (t or "").split()) for i, t in rows]
    seen = {}
    for r, (_, t) in enumerate(toks):
        for k in range(len(t) - window + 1):
            seen.setdefault(tuple(t[k : k + window]), []).append((r, k))
    cover = [set() for _ in toks]
    for places in seen.values():
        if len(places) > 1:
            for r, k in places:
                cover[r].update(range(k, k + window))
    out = []
    for (i, t), c in zip(toks, cover):
        k = 0
        while k < len(t):
            if k in c:
                e = k
                while e in c:
                    e += 1
                out.append((i, k, e))
                k = e
            else:
                k += 1
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    shared = [[f"s{p}_{k}" for k in range(rng.randrange(8, 30))] for p in range(4)]
    rows = []
    for i in range(40):
        t = []
        for _ in range(rng.randrange(0, 5)):
            t += rng.choice(shared) if rng.random() < 0.4 else [f"u{i}_{rng.randrange(999)}" for _ in range(rng.randrange(1, 25))]
        rows.append((i, " ".join(t)))
    return rows + [(None, None), (50, ""), (51, "a " * 40), (52, "short"), (53, rows[3][1]), (53, rows[3][1])]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunks in (1, 5):
        got = sorted(map(tuple, S.intervals(df, 8, chunks).collect()), key=repr)
        assert got == brute(rows, 8) and got


def test_removal(spark):
    shared = " ".join(f"p{k}" for k in range(10))
    rows = [(1, f"one {shared} two", 9), (2, f"{shared}\nthree", 9), (3, "clean  text\n", 9), (4, shared, 9), (5, None, None), (6, "", 0)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, n_chars long, bucket string, keys int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in S.remove(docs, 8, 3).collect()}
    assert got == {1: ("one two", 7), 2: ("three", 5), 3: ("clean  text\n", 9), 4: ("", 0), 5: (None, None), 6: ("", 0)}
    assert S.remove(docs, 8).columns == docs.columns
    assert S.remove(docs.limit(0)).count() == 0 and S.intervals(docs.limit(0)).count() == 0


def test_long_text(spark):
    rows = [(1, " ".join(f"x{k}" for k in range(120_000))), (2, " ".join(f"x{k}" for k in range(60_000, 60_100)))]
    got = sorted(map(tuple, S.intervals(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 60_000, 60_100), (2, 0, 100)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB é\n.", max_size=30), min_size=1, max_size=5), st.sampled_from([3, 7, 1 << 20]))
def test_tokens_do_not_depend_on_blocks(texts, block):
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    h, s, e, tok = hash_tokens(data, off, "space", ends=True, block=block)
    words = [[w for w in r.split()] for r in raw]
    assert np.diff(tok).tolist() == [len(w) for w in words]
    assert [data[a:b].tobytes() for a, b in zip(s, e)] == [w for x in words for w in x]
    same = {}
    for w, k in zip((w for x in words for w in x), h.tolist()):
        assert same.setdefault(w, k) == k
    assert set(TABLES) == {"space", "word", "blank"}
