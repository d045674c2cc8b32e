import signal
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import packing, queries, token_counts, token_store
from millrace.llm import tokens as tk
from millrace.session import scratch

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_library_s(name, odd_texts):
    use = tk.Encoder(public_tokenizers.path(name), 2)
    for texts in (odd_texts, odd_texts[::-1], [None, "a b", None]):
        ids, at = use.encode(texts)
        for i, want in enumerate(library(name, texts)):
            assert ids[at[i] : at[i + 1]].tolist() == [*want, 2], texts[i]


def test_a_full_table_starts_anew(monkeypatch, odd_texts):
    monkeypatch.setattr(tk, "CACHE", 200)
    use = tk.Encoder(public_tokenizers.path(FILES[1]), 2)
    for i in range(0, 600, 60):
        ids, at = use.encode(odd_texts[i : i + 60])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[*x, 2] for x in library(FILES[1], odd_texts[i : i + 60])]


@pytest.mark.parametrize("name", FILES)
def test_a_block_of_more_chunks_than_slots(monkeypatch, odd_texts, name):
    monkeypatch.setattr(tk, "_SLOTS", 16)
    use = tk.Encoder(public_tokenizers.path(name), 2)
    text = " ".join(f"{i}, word{i}." for i in range(3000))

    def too_long(*_):
        raise TimeoutError("no slot is free")

    old = signal.signal(signal.SIGALRM, too_long)
    signal.alarm(60)
    try:
        for texts in ([text], odd_texts, [text, "a b"]):
            ids, at = use.encode(texts)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[*x, 2] for x in library(name, texts)]
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, old)
    assert 2 * use.slots_used <= len(use.slot_key)


@pytest.mark.parametrize("top", [2, 200, 60_000, 2**32 - 1])
def test_directly_addressable_codes(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        f = token_store.Part(token_store.pack(3, np.array([9], np.int64), np.array([0, n]), ids))
        assert (f.document(0) == ids).all()
        for i in rng.integers(0, n, 50) if n else ():
            assert f.token(int(i)) == ids[i]
        for a, b in rng.integers(0, n + 1, (20, 2)):
            assert (f.codes.range(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()


def test_a_broken_file_is_refused():
    good = token_store.pack(0, np.array([1], np.int64), np.array([0, 3]), np.array([1, 2, 300], np.uint32))
    with pytest.raises(ValueError):
        token_store.Part(good[:50] + b"\xff" + good[51:])


def test_store_round_trip(spark, docs, odd_texts):
    rows = [(3 * i % 1009, t) for i, t in enumerate([*odd_texts[:400], *odd_texts[-2:]])] + [(5, None), (5, None), (None, "null id")]
    folder = scratch(spark, "test")
    token_store.write_tokens(docs(rows), public_tokenizers.path(FILES[0]), folder, end=2)
    got = token_store.read_documents(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = {tuple([i, *x, 2]) for (i, _), x in zip(rows, library(FILES[0], [t for _, t in rows]), strict=True)}
    assert {(r.doc_id, *np.frombuffer(r.ids, "<u4").tolist()) for r in got} == want


def test_store_of_nothing(spark, docs):
    folder = scratch(spark, "test")
    manifest = token_store.write_tokens(docs([(1, "a")]).where("false"), public_tokenizers.path(FILES[0]), folder, end=2)
    assert manifest.count() == 0 and token_store.read_documents(spark, folder).count() == 0
    none = docs([(1, "a")]).where("false")
    assert packing.pack(packing.runs(none, public_tokenizers.path(FILES[1]), 2)).count() == 0
    assert token_counts.prefix_counts(none, public_tokenizers.path(FILES[1]), 5).count() == 0


@pytest.mark.parametrize("bins", [1, 4, 1024])
def test_best_fit(bins):
    lengths = np.random.default_rng(1).integers(1, 1025, 3000).tolist()
    ends: dict[int, int] = {}
    for n, (s, at) in zip(lengths, packing.best_fit(lengths, 1024, bins), strict=True):
        assert at == ends.get(s, 0)
        ends[s] = at + n
        assert ends[s] <= 1024
    if bins == 1024:
        assert len(ends) <= 1.03 * sum(lengths) / 1024


def test_packing(spark, docs, odd_texts):
    rows = list(enumerate(odd_texts)) + [(7, None), (7, None)]
    ids = {}
    for (i, t), x in zip(rows, library(FILES[1], [t for _, t in rows]), strict=True):
        ids[i, t] = np.array([*x, 2], "<u4")
    got = packing.pack(packing.runs(docs(rows), public_tokenizers.path(FILES[1]), 2)).toPandas()
    assert got.length.sum() == sum(len(ids[r]) for r in rows)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
    one = {i: x for (i, t), x in ids.items() if i != 7}
    for r in got[got.doc_id != 7].itertuples():
        assert zlib.crc32(one[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 1024
    some = [*rows[:50], *rows[-4:-2]]
    cut = {}
    for r in some:
        x, n = ids[r].tobytes(), 4 * (len(ids[r]) % 1024 or 1024)
        cut[r[0]] = [x[:n], *(x[k : k + 4096] for k in range(n, len(x), 4096))]
    for r in packing.sequences(docs(some), public_tokenizers.path(FILES[1]), 2).collect():
        at = 0
        for i in r.doc_ids:
            own = max((x for x in cut[i] if r.ids[at:].startswith(x)), key=len)
            cut[i].remove(own)
            at += len(own)
        assert at == len(r.ids) <= 4096
    assert not any(cut.values())


def test_full_runs_are_not_dealt(spark):
    made = spark.range(5000).select("id", F.when(F.col("id") % 1000 == 0, 7).otherwise(1024).cast("long").alias("length"))
    got = packing.pack(made).select("*", F.spark_partition_id().alias("part")).toPandas()
    assert sorted(got.id) == list(range(5000)) and got[got.length == 1024].sequence_id.is_unique
    full, rest = got[got.length == 1024], got[got.length < 1024]
    assert (full.offset == 0).all() and not set(full.sequence_id) & set(rest.sequence_id)
    assert len(full) == 4995 and not set(full.part) & set(rest.part)


def test_every_prefix_is_counted(odd_texts):
    path = public_tokenizers.path(FILES[1])
    use, t = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    for text in [x for x in odd_texts if len(x) < 60][:500]:
        table = use.table(text)
        want = [len(e.ids) for e in t.encode_batch_fast([text[: k + 1] for k in range(len(text))], add_special_tokens=False)]
        places = np.cumsum([len(c.encode()) for c in text]) - 1 if text else []
        assert [int(table[p]) for p in places] == want, text


def test_counts_and_budgets(docs, odd_texts):
    rows = [*enumerate(odd_texts), (-1, None)]
    got = token_counts.prefix_counts(docs(rows), public_tokenizers.path(FILES[1]), budget=10).toPandas().set_index("doc_id")
    for (i, t), x in zip(rows, library(FILES[1], [t for _, t in rows]), strict=True):
        r = got.loc[i]
        assert (r.n_tokens, r.n_bytes) == (len(x), len((t or "").encode()))
        table = np.frombuffer(r.table, "<u4")
        assert len(table) == r.n_bytes and (r.fitting == r.n_bytes) == (len(x) <= 10 or r.fitting == r.n_bytes)
        assert r.fitting == 0 or table[r.fitting - 1] <= 10


def test_the_query_stores_every_table(spark, small, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "scratch", lambda *_: f"{tmp_path}/tables")
    got = {r.doc_id: r for r in queries.op7_token_counts(spark, small).collect()}
    stored = spark.read.parquet(f"{tmp_path}/tables").collect()
    want = token_counts.prefix_counts(spark.read.parquet(f"{small}/documents.parquet"), public_tokenizers.path(FILES[1]), 512, store=False).collect()
    assert len(stored) == len(got) == len(want) and all(len(r.table) == 4 * r.n_bytes for r in stored)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.bytes_within_512) for r in got.values()} == {r.doc_id: (r.n_bytes, r.n_tokens, r.fitting) for r in want}
    for r in stored:
        table = np.frombuffer(r.table, "<u4")
        assert got[r.doc_id].n_tokens == (table[-1] if len(table) else 0)
