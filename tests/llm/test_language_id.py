import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphward.llm import language_id as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{SF}/documents.parquet"), rows_per_language=60)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col("lang")).cast("double")), F.avg(F.col("accepted").cast("double"))).first()
    assert right[0] > 0.98 and right[1] > 0.99


def test_machine_separates():
    x = np.array([[1.0, 0], [2, 0.5], [0, 1], [0.2, 2]])
    y = np.array([1.0, 1, -1, -1])
    alpha, bias = L.fit_machine(x @ x.T, y)
    assert (np.sign(x @ (alpha @ x) + bias) == y).all()


def test_score_is_the_mean_of_weights():
    rng = np.random.default_rng(0)
    w = np.vstack([np.append(rng.standard_normal(L.DIMS), 0)])
    texts = ["The Éclair, x", "", "a", "zzz " * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    got, letters = L.scores(data, off, w)
    for i, t in enumerate(texts):
        m, _ = L.normalise(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        want = sum(w[0][L.columns(m, n)].mean() for n in (1, 2, 3, 4) if len(m) >= n)
        assert got[i, 0] == pytest.approx(want)
    assert letters.tolist() == [True, False, True, True]


def test_normalise_lowers_and_collapses():
    t = "ÉA  1-b".encode()
    assert L.normalise(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes().decode() == "éa b"


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the and of that which is in the"), (4, "the and of that which is in the"), (None, "der die und das ist nicht"), (5, "the and of " * 50_000)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, margin int, family string")
    got = sorted(map(tuple, L.identify(docs, model).collect()), key=repr)
    by = {r[0]: r for r in got}
    assert len(got) == 7 and by[1][1:] == by[2][1:] == by[3][1:] == (None, None, None, False)
    assert by[4][2] == "en" and by[4][4] and by[5][2] == "en" and by[None][2] == "de"
    kept = L.keep_accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 4, 5]
    assert L.identify(docs.limit(0), model).count() == 0


def test_models_without_choice(spark):
    one = spark.createDataFrame([(1, "abc", "en"), (2, None, "de"), (3, "x", None)], "doc_id long, text string, lang string")
    got = L.identify(one, L.fit(one)).orderBy("doc_id").collect()
    assert [(r["predicted"], r["margin"]) for r in got] == [("en", 1000.0), (None, None), ("en", 1000.0)]
    assert not L.identify(one, L.fit(one.limit(0))).filter("accepted").count()


def test_three_families():
    rng = np.random.default_rng(1)
    texts = {"en": "the of and that", "de": "der die und das", "fr": "le les une des", "ru": "и не что это"}
    rows = [(lang, " ".join(rng.choice(t.split(), 12))) for lang, t in texts.items() for _ in range(20)]
    feats = []
    for _, t in rows:
        m, _ = L.normalise(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        feats.append(sum(np.bincount(L.columns(m, n), minlength=L.DIMS) / (len(m) - n + 1) for n in (1, 2, 3, 4)))
    model = L.Model(list(texts), np.array(feats), np.array([r[0] for r in rows], object))
    data = "".join(t for _, t in rows).encode()
    off = np.cumsum([0] + [len(t.encode()) for _, t in rows])
    _, lang, _ = model.decide(np.frombuffer(data, np.uint8), off)
    assert lang == [r[0] for r in rows]
