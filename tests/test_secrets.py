import pytest
from pyspark.sql import functions as F

from millrace.operators import secrets

TOKEN = "0123456789abcdef0123456789abcdef01234567"


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(1, "s1", f'token = "{TOKEN}"'), (2, "s2", f'token = "{TOKEN}"'), (3, "s3", "nothing"), (4, "s4", None)], "doc_id long, source string, text string")


def test_no_raw_value_is_stored(docs):
    matches = secrets.scan(docs, secrets.select_rules(), "salt")
    found = secrets.findings(matches, F.lit("2024-01-01").cast("timestamp"))
    assert matches.count() == 2 and found.count() == 1
    for df in (matches, found):
        assert not any(TOKEN in str(v) for r in df.collect() for v in r)
    text = docs.select(secrets.redacted(F.col("text"), secrets.select_rules()).alias("t")).collect()
    assert text[0].t == "[REDACTED:generic-assigned-token]" and text[2].t == "nothing" and text[3].t is None


def test_merge_counts_runs_and_keeps_first_source(docs):
    day = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp")
    first = secrets.findings(secrets.scan(docs, secrets.select_rules(), "s"), day(1))
    again = secrets.findings(secrets.scan(docs.where("doc_id = 2"), secrets.select_rules(), "s"), day(2))
    got = secrets.merge(first, again).collect()
    assert len(got) == 1 and got[0].seen_count == 2 and got[0].source == "s1" and got[0].last_seen > got[0].first_seen
    assert secrets.query(secrets.merge(first, again), "TOKEN", day(2), 5).count() == 1
    assert secrets.query(first, None, day(2)).count() == 0


def test_rule_selection():
    assert [r.rule_id for r in secrets.select_rules(["*-token"], ["slack*"])] == ["generic-assigned-token", "github-token"]
    with pytest.raises(ValueError):
        secrets.select_rules(["nothing"])
    with pytest.raises(ValueError):
        secrets.select_rules(["[x"])
