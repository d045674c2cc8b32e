"""Every column of the queries that have no SQL, on the smallest tables."""

import numpy as np
import plain
import pytest
from test_text_operators import base_counts

from millrace.llm import lang_id, quality_knn, quality_rules
from millrace.llm.queries import queries


@pytest.fixture(scope="module")
def documents(spark, small):
    return sorted((r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect())


def test_op1_token_store(spark, small, documents):
    got = sorted(map(tuple, queries()["op1_token_store"](spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    at, want = 0, []
    for (i, _, _), ids in zip(documents, plain.library("word_bpe_49k.json", [t for _, t, _ in documents]), strict=True):
        want.append((i, at, len(ids) + 1, plain.crc([*ids, 2])))
        at += len(ids) + 1
    assert got == want


def test_op2_lang_id(spark, small, documents):
    model = plain.Languages([(t, x) for i, t, x in documents if plain.remainder(i, 4) != 2 and t is not None and x is not None])
    got = {r.doc_id: r for r in queries()["op2_lang_id"](spark, small).collect()}
    assert len(got) == len(documents)
    for i, text, _ in documents:
        lang, score = model.judge(text)
        assert (got[i].held_out, got[i].lang_pred) == (plain.remainder(i, 4) == 2, lang), text
        assert abs(got[i].score - score) < 1e-3


def test_op3_quality_rules(spark, small, documents):
    got = {r.doc_id: r for r in queries()["op3_quality_rules"](spark, small).collect()}
    assert set(got) == {i for i, _, _ in documents}
    for i, text, _ in documents:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(text)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)


def test_op6_packing(spark, small, documents):
    got = queries()["op6_packing"](spark, small).toPandas()
    ids = {i: np.array([*x, 2], "<u4") for (i, _, _), x in zip(documents, plain.library("byte_bpe_50k.json", [t for _, t, _ in documents]), strict=True)}
    for i, own in got.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.length.sum() == len(ids[i]) and (own.length[1:] == 1024).all() and own.length.max() <= 1024 and len(own) == -(-len(ids[i]) // 1024)
        assert own.ids_crc32.tolist() == [plain.crc(ids[i][s : s + n]) for s, n in zip(own.start, own.length, strict=True)]
    assert set(got.doc_id) == set(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 1024 + 1


def test_op7_token_counts(spark, small, documents):
    got = sorted(tuple(r) for r in queries()["op7_token_counts"](spark, small).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    counts = [len(x) for x in plain.library("byte_bpe_50k.json", [t for _, t, _ in documents])]
    assert got == [(i, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(documents, counts, strict=True)]


def test_op8_quality_knn(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality IS NOT NULL").collect()
    texts = {i: t for i, t, _ in documents}
    labelled = [(texts[r.doc_id], r.quality) for r in labels if plain.remainder(r.doc_id, 5) and r.doc_id in texts]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    keep = spark.createDataFrame([(r.doc_id, r.quality) for r in labels if plain.remainder(r.doc_id, 5)], "doc_id long, quality int")
    model = quality_knn.train(docs, keep)
    got = {r.doc_id: r for r in queries()["op8_quality_knn"](spark, small).collect()}
    assert set(got) == set(texts)
    for i, score in zip(texts, plain.neighbour_scores(model, texts.values(), labelled), strict=True):
        assert got[i].held_out == (plain.remainder(i, 5) == 0) and got[i].predicted == int(got[i].score >= 0.3) and 0 <= got[i].score <= 1
        assert abs(got[i].score - score) < 2e-3
    # the directions hold nearly as much of the labelled texts as the best ones do
    x = np.array([np.log1p(plain.term_counts(t)) * model.idf for t, _ in labelled])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    best = (np.linalg.svd(x, compute_uv=False)[: model.basis.shape[1]] ** 2).sum()
    assert ((x @ model.basis) ** 2).sum() >= 0.99 * best


def test_languages_have_room(docs):
    """Many languages, each with words of its own: the model holds what was seen and no more."""
    names = [f"l{k}" for k in range(100)]
    rows = [(i, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{w}" for w in ("one", "two", "six"))) for i, k in enumerate([*range(100)] * 3)]
    df = docs(rows).drop("lang").selectExpr("*", "concat('l', doc_id % 100) AS lang")
    model = lang_id.train(df)
    assert sorted(model.languages) == sorted(names) and len(model.words.scores) == 300
    got = lang_id.identify(df, model).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 100}" for r in got)
    assert lang_id.identify(df.where("false"), model).count() == 0
    long = docs([(1, "aaone " * 200_000), (2, "ab" * 500_000)])
    assert {r.doc_id: r.lang_pred for r in lang_id.identify(long, model).collect()}[1] == "l0"
