import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import millrace.llm.jaccard_join as jj
from millrace.llm import components, decontaminate, lang_id, quality_knn, quality_rules
from millrace.llm import words as W
from millrace.llm.queries import OP5_SQL, OP9_SQL, SQL, queries

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, small, same, name):
    same(queries()[name](spark, small), SQL[name])


def test_words_are_those_of_the_patterns(odd_texts):
    import pyarrow as pa

    for table, pattern, low in ((W.NOT_SPACE, SPACED, False), (W.ALNUM, ALNUM, True)):
        seen: dict[str, int] = {}
        for at, offsets, data in W.blocks(pa.array(odd_texts), 4096):
            w = W.words(data, offsets, table, low)
            for i in range(len(offsets) - 1):
                text = odd_texts[at + i].translate(lower) if low else odd_texts[at + i]
                want = pattern.findall(text)
                a, b = w.first[i], w.first[i + 1]
                assert [w.data[x:y].tobytes().decode() for x, y in zip(w.start[a:b], w.stop[a:b], strict=True)] == want
                for word, h in zip(want, w.hash[a:b].tolist(), strict=True):
                    assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def shingles(text):
    w = SPACED.findall((text or "").translate(lower))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_groups(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, i), i)
    return sorted((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label, strict=True))


def family(rng, n, size, edits):
    """n variants of one text, each with some words replaced; and a chain of them."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(size)] = f"v{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
        if rng.random() < 0.2:
            base = own
    return out


@pytest.mark.parametrize("seed, hot", [(1, 500_000), (2, 10)])
def test_near_duplicates_are_all_found(docs, monkeypatch, seed, hot):
    monkeypatch.setattr(jj, "HOT", hot)
    rng = random.Random(seed)
    texts = [t for size, n, edits in ((150, 60, 5), (60, 25, 2), (300, 12, 14), (12, 20, 1), (4, 5, 1)) for t in family(rng, n, size, edits)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(30)]
    texts += ["", None, "one", "one", "ONE", "a b c", "A b\tc", " \n"]
    rng.shuffle(texts)
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    got = jj.near_duplicates(docs(rows))
    assert sorted(map(tuple, got.collect())) == near_groups(rows)
    kept = jj.without_copies(docs([*rows, rows[3]]))
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in near_groups(rows)})


@pytest.mark.parametrize("hot", [500_000, 10])
def test_every_link_between_texts_is_given(docs, monkeypatch, hot):
    monkeypatch.setattr(jj, "HOT", hot)
    rng = random.Random(4)
    texts = [t for size, n, edits in ((150, 60, 5), (60, 25, 2), (12, 20, 1)) for t in family(rng, n, size, edits)] + ["one", "ONE", "", None]
    base = [f"w{i}" for i in range(150)]
    texts += [" ".join(f"v{rng.random()}" if k in edits else w for k, w in enumerate(base)) for edits in (rng.sample(range(150), rng.randint(0, 2)) for _ in range(60))]
    sets = [shingles(t) for t in texts]
    pairs, members = jj.links(docs(list(enumerate(texts))))
    of = {r.doc_id: r["class"] for r in members.collect()}
    assert set(of) == {i for i, s in enumerate(sets) if s}
    want = {tuple(sorted((of[i], of[j]))) for i in of for j in of if i < j and sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert all((of[i] == of[j]) == (sets[i] == sets[j]) for i in of for j in of)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 500


def test_near_duplicates_of_odd_tables(docs):
    assert jj.near_duplicates(docs([(1, "x")]).where("false")).count() == 0
    got = jj.near_duplicates(docs([(1, "a"), (1, "a"), (None, "b"), (2, "b")])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 2), (2, 1, 2)], key=repr)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)] + [(300, 200), (200, 300)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def hits(text, items):
    w = ALNUM.findall((text or "").translate(lower))
    hit, found = set(), set()
    for i, t in items:
        q = ALNUM.findall((t or "").translate(lower))
        n = min(10, len(q))
        grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(i)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [10**6, 40])
def test_every_shared_run_is_found(spark, docs, monkeypatch, block):
    rng = random.Random(3)
    vocabulary = [f"W{i}" for i in range(6)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(1, 25)] + [(90, None), (91, "..."), (92, items_text := say(15)), (93, items_text)]
    rows = [(i, say(rng.randint(0, 60)) + rng.choice(["", ", ", "!"]) + rng.choice(items)[1].__str__()) for i in range(120)] + [(500, None), (501, ""), (501, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", block)
    monkeypatch.setattr(decontaminate, "HOT", 20)
    got = decontaminate.report(decontaminate.shared_spans(docs(rows), bench)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, sorted(r.item_ids)) for r in got) == sorted((i, *hits(t, items)) for i, t in rows)
    clean = decontaminate.without_contaminated(docs(rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in rows if not hits(t, items)[1])
    none = bench.where("false")
    assert decontaminate.report(decontaminate.shared_spans(docs(rows), none)).agg(F.sum("n_hit")).first()[0] == 0


def base_counts(text):
    w = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed


def test_quality_rules_by_hand(spark, docs, odd_texts):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["the", "of", "and", "ship", "sea", "wind"], k=rng.randint(20, 60))) for _ in range(60)]
    bad = [" | ".join(rng.choices(["buy", "now", "click"], k=rng.randint(20, 60))) for _ in range(20)]
    repeated = "one two three four five six seven eight nine ten\n"
    texts = [*good, *bad, repeated * 3, repeated + repeated[4:] + "x " * 30, "a b\na b\n\n \na", *odd_texts[:200], None]
    rows = [*enumerate(texts), (2, texts[2])]
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(None,), (3,)], "doc_id long")
    got = quality_rules.judge(docs(rows), trusted).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept or by[i].base_failed for i in range(60))
    assert max(by[i].score for i in range(60, 80)) < min(by[i].score for i in range(60))
    # the same ratio, counted in Python over the buckets that Spark gives each n-gram
    hashed = quality_rules._hashed(docs(rows)).select("doc_id", F.transform(F.concat("h", "h2"), quality_rules.bucket).alias("b")).collect()
    raw, target = Counter(), Counter()
    for r in hashed:
        raw.update(r.b)
        if r.doc_id < 40:
            target.update(r.b)
    n_raw, n_target, m, prior = raw.total(), target.total(), quality_rules.BUCKETS, quality_rules.PRIOR * quality_rules.BUCKETS
    p = lambda b: (raw[b] + 1) / (n_raw + m)
    for r in hashed:
        if r.b:
            score = sum(math.log((target[b] / p(b) + prior) / (n_target + prior)) for b in r.b) / len(r.b)
            assert abs(score - by[r.doc_id].score) < 1e-6
    kept = quality_rules.without_rejected(docs(rows), trusted)
    assert kept.columns == docs(rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality_rules.judge(docs(rows).where("false"), trusted).count() == 0


def test_languages(spark, small):
    got = queries()["op2_lang_id"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_tables(docs):
    rows = docs([(1, "the cat and the dog"), (2, None), (3, "123 !"), (4, "zzqx"), (4, "zzqx"), (None, "The DOG")])
    model = lang_id.train(rows)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in lang_id.identify(rows, model).collect()), key=repr)
    assert [x[1] for x in got] == ["en", "und", "und", "en", "en", "en"] and got[1][2] == 0
    nothing = lang_id.train(rows.where("false"))
    assert {r.lang_pred for r in lang_id.identify(rows, nothing).collect()} == {"und"}


def test_quality_neighbours(spark, small):
    got = queries()["op8_quality_knn"](spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_of_odd_tables(spark, docs):
    rows = docs([(1, "fine words here"), (2, "BAD!! BAD!!"), (3, None), (3, None), (4, ""), (None, "fine")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (9, 1)], "doc_id long, quality int")
    model = quality_knn.train(rows, labels)
    got = {r.doc_id: r.score for r in quality_knn.score(rows, model).collect()}
    assert got[1] > 0.9 and got[2] < 0.1 and got[3] == got[4] == 0.5
    empty = quality_knn.train(rows, labels.where("false"))
    assert {r.score for r in quality_knn.score(rows, empty).collect()} == {0.5}
    assert sorted((r.doc_id for r in quality_knn.without_rejected(rows, model, 0.3).collect()), key=str) == [1, 3, 3, 4, None]


def test_digest_of_items_is_that_of_sorted_strings(spark, small):
    r = queries()["op9_decontaminate"](spark, small).where("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest() and not r.contaminated and OP9_SQL and OP5_SQL
