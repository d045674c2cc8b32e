import pytest

from millrace.operators import dedup, incremental, lines, search


def test_overlapping_hits_and_byte_offsets(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "éaa"), (3, None), (4, "")], "doc_id int, line string")
    assert sorted((r.doc_id, r.offset) for r in search.occurrences(df, "aa").collect()) == [(1, 0), (1, 1), (1, 2), (2, 2)]
    assert sorted(r.doc_id for r in search.occurrences(df, "*").collect()) == [1, 2]


@pytest.mark.parametrize("bad", ["", "a\nb"])
def test_bad_needles(spark, bad):
    with pytest.raises(ValueError):
        search.matching(spark.range(1).selectExpr("'a' line"), bad)


def test_quoted_needle(spark):
    df = spark.createDataFrame([(1, r"a.b\Ec a.b\E")], "doc_id int, line string")
    assert [r.offset for r in search.occurrences(df, r"a.b\E").collect()] == [0, 7]


def test_exact_fit_is_not_capped(spark):
    df = spark.createDataFrame([(1, i) for i in range(3)] + [(2, i) for i in range(4)], "c int, o int")
    got = search.capped(df, ["c"], ["o"], 3)
    assert {(r.c, r.capped) for r in got.collect()} == {(1, False), (2, True)} and got.count() == 6


def test_first_of_key_and_nulls(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "w")], "k string, i int, v string")
    assert sorted(map(tuple, dedup.first_of_key(df, ["k"], ["i"]).collect()), key=repr) == [("a", 1, "y"), (None, 3, "z")]


def test_numbers_are_those_of_one_sort(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as x").repartition(7)
    got = dedup.numbered(df, ["x"])
    assert all(r.number == r.x + 1 for r in got.collect())
    assert dedup.part_numbers(df, ["x"], 300).groupBy("part").count().orderBy("part").collect()[-1]["count"] == 100


def test_second_run_adds_nothing(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",)], "line string")
    assert incremental.unseen(a, a, ["line"], []).count() == 0
    s = incremental.run_stats(a, a, ["line"]).first()
    assert (s.n_new, s.n_skipped, s.n_common_keys) == (0, 3, 2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found = lines.lines_of(none)
    assert found.count() == 0 and lines.metrics(found, found.line.isNotNull()).first().n_read == 0
    assert incremental.run_stats(found, found, ["line"]).first().n_new == 0
