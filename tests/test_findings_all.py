from millrace.plans.queries import QUERIES


def test_no_document_is_left_out(spark, tmp_path):
    docs = [(i, "s", f'token = "{i:040d}"') for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    merged = QUERIES["findings_merge"](spark, str(tmp_path)).collect()
    assert len(merged) == 12 and {r.seen_count for r in merged} == {1, 2}
    stats = QUERIES["findings_stats"](spark, str(tmp_path)).first()
    assert (stats.n_new, stats.n_existing) == (6, 6)
    assert QUERIES["findings_query"](spark, str(tmp_path)).count() == 12
