import pytest

import corpus_pipeline
from glyphward.llm import jaccard_join, language_id, sentencepiece_codec, source_mix, substring_dedup
from glyphward.llm.queries import oracle_sql, queries

from ..comparing import duck, same
from .test_jaccard_join import brute as similar_brute
from .test_source_mix import brute as mix_brute
from .test_substring_dedup import brute as repeats_brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries()[name](spark, SF), duck(SF), oracle_sql()[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def test_pipeline_equals_brute_force(spark):
    """Each stage on the rows of the one before, by plain loops; the classifier and the tokenizer are the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((r["doc_id"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    said = {r["doc_id"] for r in language_id.identify(docs, language_id.fit(docs)).collect() if r["accepted"]}
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect() if r["doc_id"] in said]
    similar = similar_brute([(i, t) for i, _, t in rows], jaccard_join.THETA, jaccard_join.N)
    first = {i for i, c, _ in similar if i == c}
    rows = [r for r in rows if r[0] in first]
    cut = {}
    for i, a, b in repeats_brute([(i, t) for i, _, t in rows], substring_dedup.WINDOW):
        cut.setdefault(i, []).append((a, b))
    import re

    left = []
    for i, s, t in rows:
        spans = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", t)]
        for a, b in reversed(cut.get(i, [])):
            t = t[: spans[a][0]] + (t[spans[b][0] :] if b < len(spans) else "")
        left.append((i, s, t))
    drawn = mix_brute(left, source_mix.WEIGHTS, source_mix.OTHER)
    text = {i: t for i, _, t in left}
    model = sentencepiece_codec.model_of(sentencepiece_codec.load_model())
    assert got == sorted((i, tuple(model.encode(text[i]))) for i, _, _ in drawn)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "n_tokens", "token_ids", "exact"]


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty texts, repeated rows, one id with two texts, extra and clashing columns; and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "src0", None), (1, "", "en", None, 0), (2, "...", None, "src1", 3)], docs.schema)
    extra = docs.limit(40)
    twin = docs.limit(1).withColumn("doc_id", docs["doc_id"] + 1)
    wide = extra.unionByName(extra).unionByName(odd).unionByName(twin).selectExpr("*", "7 AS copy_no", "'x' AS node", "array(1) AS words", "'y' AS component")
    wide.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == table.columns, name
        seen.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
    assert seen.count() > 0 and seen.filter("copy_no <> 7 or copy_no is null").count() == 0
    got = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path))
    assert got.filter("token_ids is null").count() == 0
    table.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
