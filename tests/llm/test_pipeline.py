import math
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import plain
import pytest
from pyspark.sql import functions as F
from test_text_operators import base_counts, hits, near_groups

from millrace.llm import quality_knn, quality_rules
from millrace.llm.queries import id_remainder
from millrace.session import written


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, f in cp.STAGES:
        out.append((name, docs, made := written(f(spark, docs, small), name)))
        docs = made
    return out


def kept_by_rules(docs, good):
    """Ids of documents that a plain count of the same hashed n-grams keeps."""
    rows = quality_rules._hashed(docs).select("doc_id", "text", F.transform(F.concat("h", "h2"), quality_rules.bucket).alias("b")).collect()
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(r.b)
        if r.doc_id in good:
            target.update(r.b)
    m, prior = quality_rules.BUCKETS, quality_rules.PRIOR * quality_rules.BUCKETS
    ratio = {b: math.log((target[b] / ((n + 1) / (raw.total() + m)) + prior) / (target.total() + prior)) for b, n in raw.items()}
    return [r.doc_id for r in rows if not base_counts(r.text)[5] and round(sum(ratio[b] for b in r.b) / len(r.b), 9) >= quality_rules.THRESHOLD]


def test_each_stage_against_a_plain_version(spark, small, stages):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.quality is not None]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    ids = [[r.doc_id for r in made.select("doc_id").collect()] for _, _, made in stages[:-1]]
    assert sorted(ids[0]) == sorted(kept_by_rules(docs, {i for i, q in labels if q == 1}))
    model = quality_knn.train(docs, spark.read.parquet(f"{small}/labels.parquet").where(id_remainder(5) != 0))
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = dict(zip(ids[0], plain.neighbour_scores(model, [texts[i] for i in ids[0]], [(texts[i], q) for i, q in labels if plain.remainder(i, 5)]), strict=True))
    near = {i for i, s in scores.items() if abs(s - 0.3) < 2e-3}
    assert {i for i, s in scores.items() if s >= 0.3} - near <= set(ids[1]) <= {i for i, s in scores.items() if s >= 0.3} | near
    rows = [(i, texts[i]) for i in ids[1]]
    assert sorted(ids[2]) == sorted({c for _, _, c in near_groups(rows)})
    assert sorted(ids[3]) == sorted(i for i in ids[2] if not hits(texts[i], items)[1])
    packed = stages[4][2].toPandas()
    tokens = {i: np.array([*x, 2], "<u4") for i, x in zip(ids[3], plain.library("byte_bpe_50k.json", [texts[i] for i in ids[3]]), strict=True)}
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed.itertuples()) == sorted(
        (i, s, n, plain.crc(x[s : s + n])) for i, x in tokens.items() for s, n in [(0, len(x) % 1024 or 1024), *((k, 1024) for k in range(len(x) % 1024 or 1024, len(x), 1024))]
    )
    for _, s in packed.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
    assert all(made.columns == docs.columns for _, _, made in stages[:-1])


def test_labelled_good_documents_stay(spark, small, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for k in (0, 1):
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in stages[k][1:])
        lost = before - after
        assert sum(labels.get(i) == 1 for i in lost) <= 0.05 * sum(labels.get(i) == 1 for i in before)


def test_run(spark, small, stages):
    rows = lambda df: sorted(map(tuple, df.drop("sequence_id", "offset").collect()))
    assert rows(cp.run(spark, small)) == rows(stages[-1][2])


@pytest.mark.parametrize("empty", [{"documents"}, {"labels"}, {"benchmark"}, {"documents", "labels", "benchmark"}])
def test_empty_tables(spark, small, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        (rows.where("false") if name in empty else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    got = cp.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert (got.count() == 0) == ("documents" in empty)


def test_odd_rows(spark, tmp_path, docs):
    """Null, empty, short, repeated and very long texts, null ids and columns of clashing names."""
    say = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, say(1, 50)), (1, say(1, 50)), (2, say(2, 60)), (None, say(3, 70)), (4, None), (5, ""), (6, "short"), (7, say(7, 60_000)), (8, say(2, 60) + " end"), (1, say(9, 40))]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, say(3, 12)), (2, None), (None, say(2, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, f in cp.STAGES[:-1]:
        left = written(f(spark, left, str(tmp_path)), name)
        seen.append(sorted((r.doc_id or 0, len(r.text)) for r in left.collect()))
    assert [len(x) for x in seen[2:]] == [5, 4] and (0, len(say(3, 70))) in seen[2] and (0, len(say(3, 70))) not in seen[3]
    assert {i for i, _ in seen[3]} == {1, 2, 7}
    assert left.columns == docs(rows).columns
    assert cp.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] > 60_000
