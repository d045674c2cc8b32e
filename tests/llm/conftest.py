import random

import pytest
from pyspark.sql import types as T

from millrace.session import workers_import

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    workers_import(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """A maker of small documents tables from (doc_id, text) pairs, with columns of clashing names."""

    def make(rows):
        data = [(i, t, "en", "s", len(t) if t is not None else None, -1, 0, "x", True) for i, t in rows]
        clash = ["class", "n", "label", "row"]
        kinds = [T.LongType(), T.LongType(), T.StringType(), T.BooleanType()]
        return spark.createDataFrame(data, T.StructType([*DOCS.fields, *(T.StructField(c, k) for c, k in zip(clash, kinds, strict=True))]))

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of every awkward kind."""
    rng = random.Random(5)
    signs = [*" \n\t\r aAbeé'sdl.,!?0189ΣσİßǺ  　\x85\x1c\x0b中文😀ӏ", "'re", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", " \n", "don't", "the ", " of", "ing", "\x01", "word, ", " Word."]
    return ["", " ", "\n", "a", "a\n\n\nb", "x   y", *("".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(1500)), "the quick " * 5000, "z" * 20000]
