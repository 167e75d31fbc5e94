import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from glyphward.llm import sentencepiece_codec as C, token_store as T
from glyphward.llm.bpe import model_of

BLOB = C.load_model()
OWN = sentencepiece.SentencePieceProcessor(model_proto=BLOB)
TEXTS = ["", " ", "  two  blanks ", "Hello, world!\nNext\tline", "ünïcödé ß 漢字 🎉 ​", "a" * 3000, "ababab" * 300, "▁mark", "\n\n x", "<s> </s> <unk> <0x41>", "1234567890" * 9, " \n \n"]


@pytest.mark.parametrize("text", TEXTS)
def test_encodes_as_the_library(text):
    m = model_of(BLOB)
    ids = m.encode(text)
    assert ids == OWN.encode(text)
    assert m.decode(ids) == text or "▁" in text


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("the and of in  \n.,éü▁漢"), st.characters(exclude_categories=["Cs"], exclude_characters="\0")), max_size=60))
def test_any_text(text):
    assert model_of(BLOB).encode(text) == OWN.encode(text)


def test_columns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (90, None), (1, TEXTS[1])]
    docs = spark.createDataFrame([(i, t, 3, "e") for i, t in rows], "doc_id long, text string, n_tokens int, exact string")
    got = C.encode(docs)
    by = {(r["doc_id"], r["n_tokens"]): r for r in got.collect()}
    assert len(got.collect()) == len(rows) and by[90, None]["token_ids"] is None and by[0, 0]["token_ids"] == []
    back = {r["doc_id"]: r["text"] for r in C.decode(got).collect()}
    assert all(back[i] == t for i, t in rows if i is not None and "▁" not in (t or ""))
    assert C.encode(docs.limit(0)).count() == 0


def test_documents_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in C.encode(docs).collect():
        assert r["token_ids"] == OWN.encode(texts[r["doc_id"]]) and r["exact"]


def test_store_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "word " * 40_000)], "doc_id long, text string")
    docs = docs.unionByName(extra)
    store = T.build(docs).persist()
    want = {r["doc_id"]: r["token_ids"] for r in C.encode(docs).collect()}
    ids = [*sorted(want)[:20], 9001, 9002, 9003, 77_777]
    got = {r["doc_id"]: r["token_ids"] for r in T.read(store, ids).collect()}
    assert got == {i: want[i] for i in ids if i in want}
    head = store.filter("kind = 'dictionary'").first()
    assert T.dict_hash(bytes(head["payload"])) == head["dict_hash"]
    shards = store.filter("kind = 'shard'").collect()
    assert sum(len(s["doc_ids"]) for s in shards) == docs.count() and all(s["dict_hash"] == head["dict_hash"] for s in shards)
    assert all(len(s["offsets"]) == len(s["doc_ids"]) + 1 and s["offsets"][-1] == len(s["payload"]) for s in shards)
    empty = T.build(docs.limit(0)).collect()
    assert len(empty) == 1 and T.read(store, []).count() == 0


def test_dictionaries_merge():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 300, 12).astype("<u2").tobytes() for _ in range(60)]
    make = lambda: b"".join(words[i] for i in rng.integers(0, 60, 20))
    dictionary = T.train([make() for _ in range(400)])
    assert dictionary[:4] == b"\x37\xa4\x30\xec" and T.train([]) == b"" and T.train([b"x" * 9]) == b"x" * 9
