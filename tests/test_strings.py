import pytest
from pyspark.sql import functions as F

from millrace.functions import strings as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_schemes_are_removed_whole(spark):
    assert one(spark, "sftp://x HTTPS://y ftp://z", S.strip_schemes) == "x y z"


@pytest.mark.parametrize("text, limit, want", [("abc", 5, "abc"), ("aéb", 2, "a"), ("aéb", 3, "aé"), ("😀", 3, ""), ("", 0, ""), (None, 3, None)])
def test_cap_is_between_characters(spark, text, limit, want):
    assert one(spark, text, lambda c: S.cap_bytes(c, limit)) == want


def test_trim_keeps_inner_carriage_returns(spark):
    assert one(spark, "a\rb\r\r\n", S.trim_line) == "a\rb"


@pytest.mark.parametrize("glob, yes, no", [("aws-*", "aws-x", "x-aws-"), ("a?c", "abc", "ac"), ("[!a]b", "cb", "ab"), ("a.b", "a.b", "axb")])
def test_globs(spark, glob, yes, no):
    for text, want in ((yes, True), (no, False)):
        assert one(spark, text, lambda c: F.rlike(c, F.lit(S.glob_to_regex(glob)))) is want


@pytest.mark.parametrize("bad", ["[abc", "[]"])
def test_bad_glob(bad):
    with pytest.raises(ValueError):
        S.glob_to_regex(bad)


def test_like_signs_stand_for_themselves(spark):
    df = spark.createDataFrame([("a%b",), ("axb",)], "v string")
    assert [r.v for r in df.where(S.like_filter(F.col("v"), "A%")).collect()] == ["a%b"]
    assert df.where(S.like_filter(F.col("v"), "*")).count() == 2
