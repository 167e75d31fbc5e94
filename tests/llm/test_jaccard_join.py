import glob
import random
import re
import time

import numpy as np
import pytest
from tests.comparing import duck

from glyphward.llm import jaccard_join as J


def grams(text, n=2):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, theta=0.8, n=2):
    sets = [grams(t, n) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a + 1, len(sets)):
            y = sets[b]
            if x and y and len(x & y) / len(x | y) >= theta:
                links[a] += 1
                links[b] += 1
                label[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, least[find(k)], links[k]) for k, (i, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect()), key=repr)


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows, i = [], 0
    for size in (1, 2, 3, 5, 9, 20, 45, 120, 400):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for k in range(4):
                t = list(base)
                for _ in range(k * max(1, size // 40)):
                    t[rng.randrange(size)] = rng.choice(words)
                rows.append((i, " ".join(t)))
                i += 1
    return rows


def hub(rng, members, size=60):
    """A group of near copies that are all unlike, each entry of which many share."""
    base = [f"h{k}" for k in range(size)]
    for k in range(members):
        t = list(base)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(size)] = f"v{k}"
        yield " ".join(t)


@pytest.mark.parametrize("theta", [0.6, 0.8, 0.9])
def test_equals_brute_force(spark, theta):
    rows = corpus()
    rows += [(1000 + k, "alike " * 3 + "many copies of one text " * 4) for k in range(30)]
    rows += [(2000 + k, t) for k, t in enumerate(hub(random.Random(5), 40))]
    # a shared passage ties texts that are not similar
    rows += [(3000 + k, " ".join([f"p{x}" for x in range(20)] + [f"q{k}x{x}" for x in range(30)])) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.similar(df, theta, hot=5, most=12, block=400)) == brute(rows, theta)


@pytest.mark.parametrize("strangers", [3, -4])
def test_segments_with_deletions_equal_brute_force(spark, monkeypatch, strangers):
    """Schemes with segments and deep segments forced, as a cost model of larger corpora would choose them."""
    monkeypatch.setattr(J.Plan, "_choose", lambda self, band: (0.0, max(1, round(self.his[band] / 1.5)), max(1, round(self.his[band] / 1.5))))
    monkeypatch.setattr(J, "_STRANGERS", strangers)
    rows = corpus(7) + [(2000 + k, t) for k, t in enumerate(hub(random.Random(6), 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for theta in (0.6, 0.9):
        assert got(J.similar(df, theta, hot=4, most=8)) == brute(rows, theta)


def test_sql(spark, tmp_path):
    rows = corpus(3) + [(1, "the same id"), (None, "the same id"), (None, None), (5000, None), (5001, "...")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duck(str(tmp_path)).sql(J.oracle()).fetchall()
    assert got(J.similar(spark.read.parquet(str(tmp_path / "documents.parquet")))) == sorted(want, key=repr) == brute(rows, J.THETA)


def test_edges(spark):
    long = "x y " * 30_000
    rows = [(1, None), (2, ""), (3, "..."), (4, "Same text here"), (5, "same TEXT here"), (5, "same TEXT here"), (None, "same text here"), (6, "one"), (7, "One"), (8, long), (9, long), (None, "alone"), (9, "another text of the id")]
    docs = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in rows], "doc_id long, text string, node int, component string, __n int")
    assert got(J.similar(docs)) == brute(rows)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted(
        [("1", ""), ("2", ""), ("3", "..."), ("4", "Same text here"), ("6", "one"), ("8", long), ("None", "alone"), ("9", "another text of the id")]
    )
    assert J.similar(docs.limit(0)).count() == 0 and J.keep_one(docs.limit(0)).count() == 0
    empty = docs.filter("doc_id < 4")
    assert J.similar(empty).count() == 3 and J.keep_one(empty).count() == 3


def test_of_equal_rows_one_stays(spark):
    docs = spark.createDataFrame([(1, "a b c", "z"), (1, "a b c", "y"), (1, "a b c", None), (1, "a b c", "z"), (1, "quite unlike it", "k"), (None, "n n m", "1"), (None, "n n m", "1")], "doc_id long, text string, source string")
    one = J.keep_one(docs)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted([(1, "a b c", "y"), (1, "quite unlike it", "k"), (None, "n n m", "1")], key=repr)


def test_groups_are_connected(spark):
    rows = [(i, " ".join(f"t{k}" for k in range(i, i + 60))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in J.keep_one(df, theta=0.9).collect()] == [0]


def test_bands_have_no_end():
    plan = J.Plan(np.zeros(0, np.uint64), np.zeros(0), 10**10, 0.8)
    assert plan.scheme(60)[1] >= 0 and plan.his[60] > 10**9
    plan.reach(10**12)
    assert plan.his[-1] >= 10**12


def test_segments_are_chosen_where_they_pay():
    """At a high threshold and with n-grams that are common one by one, segments and their neighbourhoods are cheaper."""
    chosen = [J.Plan(np.arange(1, 4001, dtype=np.uint64), np.full(4000, 12.0), n, 0.9).scheme(band) for n in (10**4, 10**7) for band in range(10, 30)]
    assert any(m > 0 for _, m, _ in chosen)


def test_production_threshold_catches_replaced_words(spark):
    """Near copies with 6-10 % of the words replaced, each costing two bigrams; and strangers that share half their text."""
    rng = random.Random(3)
    rows, copies, size = [], set(), 200
    for k, every in enumerate((16, 14, 12, 11, 10)):
        base = [f"b{k}x{rng.randrange(10**6)}" for _ in range(size)]
        copy = [f"c{k}x{i}" if i % every == every // 2 else w for i, w in enumerate(base)]
        stranger = base[: size // 2] + [f"s{k}x{i}" for i in range(size // 2)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(copy)), (10 * k + 2, " ".join(stranger))]
        copies.add((10 * k, 10 * k + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["class_id"], r["doc_id"]) for r in J.similar(df).collect() if r["doc_id"] != r["class_id"]} == copies
    assert {r["doc_id"] for r in J.keep_one(df).collect()} == {i for i, _ in rows} - {b for _, b in copies}


def test_common_ngrams_tie_no_strangers(spark):
    """Most n-grams are in more sets than lists may be long: partners meet on the rare ones, and strangers are not tied."""
    rng = random.Random(8)
    rows = []
    for k in range(150):
        text = [f"r{k}x{i}" for i in range(40)] + [f"c{rng.randrange(30)}" for _ in range(100)]
        rows.append((2 * k, " ".join(text)))
        if k < 10:
            text[rng.randrange(140)] = "other"
            rows.append((2 * k + 1, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n_bytes = sum(len(t) for _, t in rows)
    sizes = [r["count"] for r in J.candidate_components(df, n_bytes, hot=4, most=8).groupBy("component").count().collect()]
    assert sizes == [2] * 10
    assert got(J.similar(df, hot=4, most=8)) == brute(rows, J.THETA)


@pytest.mark.parametrize("hot, most", [(1, 2), (2, 5), (6, 9)])
def test_lists_of_many_lengths_equal_brute_force(spark, monkeypatch, hot, most):
    """Parts, extensions and near copies of few texts, in clusters longer than the lists, over several chunks and buckets."""
    monkeypatch.setattr(J, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(J, "BUCKET_BYTES", 9000)
    rng = random.Random(hot)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(10, 60) if rng.random() < 0.5 else 1000 * base + i}" for i in range(rng.choice((6, 15, 40, 90)))]
        for _ in range(rng.choice((3, 8, 20))):
            t = list(words[rng.randrange(1 + len(words) // 3) :])
            for _ in range(rng.randrange(1 + len(t) // 8)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(60)}"
            t += [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1 + len(t) // 2))]
            rows += [(len(rows), " ".join(t))] * rng.choice((1, 1, 2))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for theta in (0.6, 0.75):
        assert got(J.similar(df, theta, hot=hot, most=most)) == brute(rows, theta)


def test_shuffle_files_go_with_their_query(spark):
    """What is staged leaves no shuffle files behind, whenever the driver collects garbage."""
    where = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in where for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = held()
    pairs = spark.range(20_000).selectExpr("id % 1000 AS k", "id").groupBy("k").sum("id")
    kept = J.stage_table(pairs, "test", free=True)
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and kept.count() == 1000


def test_keep_one_stages_few_rows_a_text(spark, monkeypatch):
    """As the pipeline's second stage: n-grams that many sets have leave no rows of their own between index and pairs."""
    rng = random.Random(9)
    rows = [(k, " ".join([f"r{k // 2 if k < 20 else k}x{i}" for i in range(40)] + [f"c{rng.randrange(30)}" for _ in range(20 if k < 20 else 100)])) for k in range(160)]
    real, staged = J.stage_table, {}

    def counted(df, name, **how):
        out = real(df, name, **how)
        staged[name] = staged.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(J, "stage_table", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in J.keep_one(df, hot=4, most=8).collect()}
    assert kept == {c for _, c, _ in brute(rows, J.THETA)}
    assert max(v for k, v in staged.items() if k != "words") <= 2 * len(rows)


def test_pairs_of_common_ngrams_tie_no_strangers(spark):
    """As in the pipeline's second stage on large tables: even a set's rarest n-grams are in more sets than lists may be long."""
    rng = random.Random(18)
    rows = []
    for k in range(300):
        text = [f"r{k}x{i}" for i in range(20)] + [f"c{rng.randrange(60)}" for _ in range(100)]
        rows.append((2 * k, " ".join(text)))
        if k < 10:
            text[rng.randrange(120)] = "other"
            rows.append((2 * k + 1, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n_bytes = sum(len(t) for _, t in rows)
    sizes = [r["count"] for r in J.candidate_components(df, n_bytes, hot=2, most=6).groupBy("component").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 6
    assert got(J.similar(df, hot=2, most=6)) == brute(rows, J.THETA)


def test_no_round_of_verification_sends_more_than_the_texts(spark, monkeypatch):
    """A component of many blocks: its texts meet in all pairs of blocks, but are not all copied for all of them at once."""
    rows = list(enumerate(dict.fromkeys(hub(random.Random(2), 60)))) + [(100 + k, " ".join(f"o{k}x{i}" for i in range(60))) for k in range(60)]
    sent, rounds = spark.sparkContext.accumulator(0), []
    real_verify, real_stage = J._verify, J.stage_table

    def verify(theta, n):
        run = real_verify(theta, n)

        def counted(table):
            sent.add(table.num_rows)
            return run(table)

        return counted

    def stage(df, name, **how):
        before, out = sent.value, real_stage(df, name, **how)
        if name == "found":
            rounds.append(sent.value - before)
        return out

    monkeypatch.setattr(J, "_verify", verify)
    monkeypatch.setattr(J, "stage_table", stage)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.similar(df, hot=4, most=8, block=300)) == brute(rows, J.THETA)
    assert max(rounds) <= len(rows) and sum(rounds) > 2 * len(rows)
