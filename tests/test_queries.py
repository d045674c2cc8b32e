import pytest

from millrace.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, small, same, name):
    same(QUERIES[name](spark, small), SQL[name])


def test_counters_add_up(spark, small):
    m = QUERIES["run_metrics"](spark, small).first()
    assert m.n_read == m.n_accepted + m.n_rejected and m.n_accepted == m.n_unique + m.n_duplicates
    s = QUERIES["incremental_stats"](spark, small).first()
    assert s.n_accepted == s.n_new + s.n_skipped + s.n_duplicates
    assert QUERIES["incremental_new"](spark, small).count() == s.n_new


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
