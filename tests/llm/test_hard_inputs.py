"""Long texts, repeats and floods of small rows: time and memory stay in proportion."""

import random
import time
import tracemalloc

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import hits, near_groups, shingles

import millrace.llm.jaccard_join as jj
from millrace.llm import chat_format, decontaminate, packing, quality_knn, quality_rules, token_counts, token_store, url_filter
from millrace.llm import tokens as tk
from millrace.llm import words as W
from millrace.llm.queries import event_log
from millrace.session import scratch

BYTE = public_tokenizers.path("byte_bpe_50k.json")


class within:
    def __init__(self, seconds):
        self.seconds = seconds

    def __enter__(self):
        self.began = time.process_time()

    def __exit__(self, *_):
        assert time.process_time() - self.began < self.seconds


def test_three_million_distinct_chunks():
    text = " ".join(str(i) for i in range(3_000_000))
    use = tk.Encoder(BYTE, 2)
    with within(120):
        ids, at = use.encode([text])
    assert at.tolist() == [0, len(ids)]
    # long digit strings are pieces of their own, so a part of the text is encoded as it is within the whole
    tail = text[text.index(" 2999000") :]
    want = [*plain.library("byte_bpe_50k.json", [tail])[0], 2]
    assert ids[-len(want) :].tolist() == want


@pytest.mark.parametrize("text", ["z" * 1_000_000, "the" * 300_000, " " * 300_000, "\n\n x" * 100_000, "-" * 200_000, "é" * 200_000])
def test_one_piece_of_a_text(text):
    use = token_counts.PrefixCounter(BYTE)
    with within(40):
        table = use.table(text)
    assert len(table) == len(text.encode()) and int(table[-1]) == len(plain.library("byte_bpe_50k.json", [text])[0])
    cut = random.Random(1).choices(range(1, 3000), k=40)
    for k, ids in zip(cut, plain.library("byte_bpe_50k.json", [text[:k] for k in cut]), strict=True):
        assert int(table[len(text[:k].encode()) - 1]) == len(ids)


def test_one_word_over_and_over(spark, docs):
    items = spark.createDataFrame([(1, "same " * 2000), (2, "same " * 10), (3, "same " * 3), (4, "other " * 2000)], "item_id long, text string")
    rows = [(1, "same " * 20_000), (2, "x " * 300_000), (3, "same " * 9 + "x " * 5 + "same"), (4, None), (5, ("same " * 12 + "y ") * 3000)]
    use = decontaminate.Items(np.array([1, 2, 3, 4]), pa.array([r.text for r in items.orderBy("item_id").collect()], pa.large_string()))
    raw = np.frombuffer(rows[0][1].encode(), np.uint8)
    with within(5):
        found = use.spans(W.words(raw, np.array([0, len(raw)]), W.ALNUM, True))
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == [(0, k, 0, 20_000) for k in range(3)]
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r.item_ids)) for r in decontaminate.report(decontaminate.shared_spans(docs(rows), items)).collect()}
    assert got == {1: (20_000, 20_000, [1, 2, 3]), 2: (300_000, 0, []), 3: (15, 9, [3]), 4: (0, 0, []), 5: (39_000, 36_000, [1, 2, 3])}
    assert got[3] == hits(rows[2][1], [tuple(r) for r in items.collect()])


def test_both_ways_of_decontamination_agree(spark, docs, monkeypatch):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choices("a b c d".split(), k=n))
    items = spark.createDataFrame([(i, say(rng.choice([2, 8, 10, 12, 40]))) for i in range(30)], "item_id long, text string")
    rows = docs([(i, say(rng.randint(0, 80))) for i in range(60)] + [(3, "a b c d"), (None, say(30))])
    read = lambda df: sorted((repr(r.doc_id), r.n_words, sorted(map(tuple, r.spans))) for r in df.collect())
    one = read(decontaminate.shared_spans(rows, items))
    clean = sorted(repr(tuple(r)) for r in decontaminate.without_contaminated(rows, items).collect())
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 1)
    monkeypatch.setattr(decontaminate, "HOT", 5)
    assert read(decontaminate.shared_spans(rows, items)) == one
    assert sorted(repr(tuple(r)) for r in decontaminate.without_contaminated(rows, items).collect()) == clean
    none = items.where("item_id < 0")
    assert decontaminate._joined(rows.select("doc_id", "text"), none).agg(F.sum(F.size("spans"))).first()[0] == 0
    assert decontaminate._joined(rows.select("doc_id", "text").where("false"), items).count() == 0


def test_a_hundred_thousand_turns(spark):
    rows = spark.range(100_000).selectExpr("1L conv_id", "id turn", "id seq", "'message' kind", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id) text")
    began = time.time()
    r = chat_format.read_back(chat_format.format_chats(rows)).selectExpr("size(turns) n", "trained[49999] last", "size(trained) m", "size(loss) k").first()
    assert (r.n, r.last, r.m, r.k) == (100_000, "t99999", 50_000, 50_000) and time.time() - began < 60


def test_the_log_of_the_query_holds_every_kind(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "abc"), (1, 1, "assistant", "abc"), (1, 1, "assistant", None), (2, 5, None, "x")], "conv_id long, turn long, role string, text string")
    log = event_log(rows)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"} and log.count() == 30
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(chat_format.format_chats(log)).collect()}
    assert got == {1: [("user", "hello"), ("assistant", ""), ("assistant", "abc"), ("assistant", "abc")], 2: [("", "x")]}


def test_many_one_letter_texts():
    texts = pa.array(["x"] * 30_000 + ["word " * 100_000], pa.large_string())
    model = quality_knn.Model(np.array([plain.term_counts(t) for t in ("x", "yy zz", "word word")]), np.array([1.0, 0, 1]))
    tracemalloc.start()
    got = [model.scores(quality_knn.term_counts(data, offsets)) for _, offsets, data in W.blocks(texts, quality_knn.BLOCK, quality_knn.ROWS)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, got)) == 30_001 and peak < 150e6


@pytest.mark.parametrize("partners, cell", [((2, 4, None), 8), ((None,), 3), ((3, None), 2048)])
def test_long_lists_in_rounds_and_cells(docs, monkeypatch, partners, cell):
    """Documents that share most of their rarest shingles but fall into many components."""
    monkeypatch.setattr(jj, "PARTNERS", partners)
    monkeypatch.setattr(jj, "CELL", cell)
    monkeypatch.setattr(jj, "PAIRS", 50)
    monkeypatch.setattr(jj, "LIST_LIMIT", 4)
    monkeypatch.setattr(jj, "HEADS", 0)
    monkeypatch.setattr(jj, "WINDOW", 0)
    rng = random.Random(sum(map(str, partners).__str__().encode()) + cell)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for family in range(12):
        own = [f"f{family}w{i}" for i in range(rng.choice([8, 14, 20, 26]))]
        for _ in range(rng.randint(1, 5)):
            mine = list(own)
            mine[rng.randrange(len(mine))] = f"x{rng.random()}"
            texts.append(" ".join(passage + mine))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = near_groups(rows)
    assert len({c for _, _, c in want}) > 2
    assert sorted(map(tuple, jj.near_duplicates(docs(rows)).collect())) == want


def test_two_texts_of_one_id(docs):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (0, "p q r s t u v"), (5, "a b c d e f g"), (7, ""), (7, ""), (8, None), (0, "p q r s t u v"), (None, "a b c d e f g")]
    got = sorted(map(repr, map(tuple, jj.near_duplicates(docs(rows)).collect())))
    assert got == sorted(map(repr, [(1, 3, 1), (1, 3, 0), (0, 3, 0), (0, 3, 0), (5, 3, 1), (7, 0, 7), (7, 0, 7), (8, 0, 8), (None, 3, 1)]))
    kept = sorted(repr((r.doc_id, r.text)) for r in jj.without_copies(docs(rows)).collect())
    assert kept == sorted(map(repr, [(1, "a b c d e f g"), (0, "p q r s t u v"), (7, ""), (7, ""), (8, None)]))


def test_sketches_never_bound_below_the_overlap():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 70_000, dtype=np.uint64)
    sets = [np.unique(rng.choice(base[:n], max(1, int(n * f)), replace=False)) for n in (3, 40, 300, 3000, 70_000) for f in (1, 0.9, 0.5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([jj.signature(s) for s in sets], pa.binary())], names=["class", "ranges"])
    sketch = jj._Sketches(next(jj._sketches([batch])).column(1).to_pylist())
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    for a, b, bound in zip(i, j, sketch.bound(i, j).tolist(), strict=True):
        assert bound >= len(np.intersect1d(sets[a], sets[b]))


@pytest.mark.parametrize("bins", [1, 2, 5, 300])
def test_best_fit_by_the_plain_rule(bins):
    """As many sequences, and as full, as by the plain rule: of sequences with equal free space any may be taken."""
    rng = random.Random(bins)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 20)]) for _ in range(1500)]
    fill = lambda placed: sorted(sum(n for n, (s, _) in zip(lengths, placed, strict=True) if s == k) for k in {s for s, _ in placed})
    assert fill(list(packing.best_fit(lengths, 64, bins))) == fill(plain.best_fit(lengths, 64, bins))


def test_looking_ahead_needs_no_more_sequences(spark):
    made = spark.range(20_000).select("id", (1 + F.pmod(F.xxhash64("id"), F.lit(1023))).cast("long").alias("length"))
    count = lambda **k: packing.pack(made, **k).select("sequence_id").distinct().count()
    least = -(-made.agg(F.sum("length")).first()[0] // 1024)
    plainly, ahead = count(turn=1), count()
    assert least <= ahead <= plainly <= 1.05 * least


def test_a_token_file_of_many_parts(spark, docs, monkeypatch, odd_texts):
    monkeypatch.setattr(token_store, "PART_TOKENS", 200)
    rows = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 300)], pa.int64()), pa.array(odd_texts[:300])], names=["doc_id", "text"])
    parts = list(token_store._parts(4, (rows.slice(k, 20) for k in range(0, 300, 20)), tk.encoder(BYTE, 2)))
    folder = scratch(spark, "file")
    docs_n, tokens_n = token_store.save(folder, "tokens-00000004.dac", iter(parts))
    again = token_store.save(folder, "tokens-00000004.dac", iter(parts[:1]))  # a task that runs again leaves the whole file
    f = token_store.TokenFile(folder, "tokens-00000004.dac")
    want = [[*x, 2] for x in plain.library("byte_bpe_50k.json", odd_texts[:300])]
    flat = [t for x in want for t in x]
    assert (f.n_docs, f.n_tokens, f.shard) == (300, len(flat), 4) == (docs_n, tokens_n, 4) and again[0] < 300
    assert [f.document(k).tolist() for k in range(300)] == want
    assert all(f.token(i) == flat[i] for i in random.Random(2).choices(range(len(flat)), k=300))
    assert f.part(0).nulls.tolist()[:3] == [True, False, False]
    f.close()
    with pytest.raises(ValueError):
        token_store.Part(parts[0][0][:-1] + b"\0")


def test_ids_at_the_ends_of_their_range(spark, docs):
    folder = scratch(spark, "file")
    rows = [(-(2**63), "least"), (2**63 - 1, "most"), (None, "none")]
    token_store.write_tokens(docs(rows), BYTE, folder, end=None)
    assert [r.doc_id for r in token_store.read_documents(spark, folder).orderBy("start").collect()] == [None, -(2**63), 2**63 - 1]


def test_long_texts_and_urls(spark, docs):
    long = "word another thing " * 100_000
    rows = docs([(1, long), (2, "short text"), (3, None)])
    trusted = spark.createDataFrame([(2,)], "doc_id long")
    got = {r.doc_id: r for r in quality_rules.judge(rows, trusted).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (300_000, 300_000, True)
    assert len(shingles(long)) == 3 and {r.doc_id: r.n_shingles for r in jj.near_duplicates(rows).collect()} == {1: 3, 2: 1, 3: 0}
    urls = spark.createDataFrame([(1, "http://" + "a." * 3000 + "b.net/" + "p/" * 100_000 + "?q"), (2, "x" * 500_000)], "page_id long, url string")
    rule = spark.createDataFrame([("b.net", "/p/", "block")], "host string, path string, action string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(urls, rule).collect()} == {1: "block", 2: "allow"}


def test_urls_dealt_over_groups(spark, monkeypatch):
    """With more copies of rules than are allowed, URLs are dealt by their domain too; verdicts are the same."""
    rng = random.Random(6)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rules = spark.createDataFrame([(host(), rng.choice(["/", "/x"]), rng.choice(["allow", "block"])) for _ in range(30)], "host string, path string, action string")
    urls = spark.createDataFrame([(i, f"http://{host()}/x{i}") for i in range(200)] + [(-1, None)], "page_id long, url string")
    one = sorted(map(repr, url_filter.filter_urls(urls, rules).collect()))
    monkeypatch.setattr(url_filter, "COPIES", 1)
    monkeypatch.setattr(url_filter, "MIN_SALTS", 2)
    assert sorted(map(repr, url_filter.filter_urls(urls, rules).collect())) == one


def test_cells_without_an_entry_away():
    n = pa.array([5, 5], pa.int64())
    cells = pa.table({"shingle": n, "i": n, "j": n, "x": pa.array([False, False]), "y": pa.array([True, True]), "class": pa.array([1, 2], pa.int64()), "n": n, "pos": n, "before": n, "part": n, "away": pa.array([False, False]), "sketch": pa.array([b"\1", b"\1"], pa.binary())})
    assert list(jj._cell_pairs(cells, 80)) == []


def test_classifier_learns_a_bounded_sample_of_repeated_ids(spark, docs):
    """Ids of many rows, equal or not, and labels that are repeated: what the driver collects and sends stays small."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 3, "doc_id long, quality int")
    equal = docs([(i, f"text number {i} of ten") for i in range(10) for _ in range(40)])
    assert len(quality_knn.train(equal, labels, sample=20).labels) == 10
    other = docs([(i, f"text {i} as written in copy{k} of many") for i in range(10) for k in range(200)])
    assert 40 <= len(quality_knn.train(other, labels, sample=100).labels) <= 160
    once = quality_knn.train(docs([(i, f"text number {i} of ten") for i in range(10)]), labels.distinct(), sample=20)
    assert np.array_equal(once.labels, quality_knn.train(equal, labels, sample=20).labels)
