"""Benchmark decontamination by winnowing.

Texts become words (ASCII letters lower-cased, ASCII digits, all beyond ASCII). Of every WINDOW consecutive
K-grams of words the one of the least hash is a fingerprint, so any shared run of WINDOW + K - 1 = SPAN words
shares one: two texts that agree on SPAN words agree on the K-grams there and so on which is least. The
fingerprints of items and documents are joined by their hashes. A fingerprint stands with its context, the
SPAN - K words on both sides: as far as the contexts agree the hit is extended, and a run of SPAN words or
more is shared. Every shared window of SPAN words holds a fingerprint, so these runs cover all of them. A text
has each context once, with its places, so a text that repeats itself costs no more than its length. Items
of fewer words than SPAN are looked up whole: by the hash of each run of as many words.

Two ways give the same rows. Up to ITEM_WORDS words of benchmark (its bytes are summed first, and bound them),
the items' fingerprints are broadcast and one pass over the documents joins them; documents are not moved.
Beyond it both sides are tables joined by a shuffle: documents give the fingerprints that pass a filter of a
fixed size, and those that are frequent among them are dealt over salts.

Defined results: null text and a null item text have no words; items without words are left out;
equal items are each reported. Repeated documents each get a row. Null item_ids are ignored. Extra
columns are ignored. Without items nothing is hit. Texts may have any length and repeat any word. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.session import written

SPAN = 10
K = 6
WINDOW = SPAN - K + 1
#: Words that a context has on each side of its fingerprint.
SIDE = SPAN - K
#: Words of benchmark that are broadcast at most.
ITEM_WORDS = 2_000_000
#: The filter of the shuffled way tells fingerprints apart by so many bits.
FILTER_BITS = 22
#: Documents' rows of one fingerprint that go to one task of the shuffled way, about; no more than so many are frequent.
HOT, MOST_HOT = 100_000, 100_000
U64 = np.uint64


def fingerprints(g: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions of the K-grams g that are least of some WINDOW consecutive valid ones."""
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = g[:n].copy()
    whole = valid[:n].copy()
    for i in range(1, WINDOW):
        np.minimum(least, g[i : i + n], out=least)
        whole &= valid[i : i + n]
    chosen = np.zeros(len(g), bool)
    for i in range(WINDOW):
        chosen[i : i + n] |= whole & (g[i : i + n] == least)
    return np.flatnonzero(chosen)


def _inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n runs of k words lie within one text."""
    ok = np.ones(n, bool)
    for back in range(1, k):
        edge = first[1:-1] - back
        ok[edge[(edge >= 0) & (edge < n)]] = False
    return ok


def contexts(h: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, edge: int) -> np.ndarray:
    """The words from SIDE before to SIDE after each fingerprint; what lies outside its text (begin to end) is edge."""
    place = at[:, None] + np.arange(-SIDE, K + SIDE)
    out = h[np.clip(place, 0, max(len(h) - 1, 0))] if len(h) else np.zeros(place.shape, U64)
    out[(place < begin[:, None]) | (place >= end[:, None])] = U64(edge)
    return out


_WEIGHTS = np.random.default_rng(20240209).integers(1, 2**63, K + 2 * SIDE, dtype=U64) * U64(2) + U64(1)


def context_hashes(c: np.ndarray) -> np.ndarray:
    return W.mix((c * _WEIGHTS).sum(1, dtype=U64))


def agreement(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the pair shares SPAN words or more, words that agree on the left, and on the right, of the fingerprint)."""
    same = x == y
    left = np.cumprod(same[:, SIDE - 1 :: -1], axis=1).sum(1)
    right = np.cumprod(same[:, SIDE + K :], axis=1).sum(1)
    return same[:, SIDE : SIDE + K].all(1) & (left + right + K >= SPAN), left, right


def merged(text: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, first, words): the union of the runs of each text and item, as stretches that don't touch."""
    if not len(text):
        return text, item, first, end
    order = np.lexsort((first, item, text))
    text, item, first, end = text[order], item[order], first[order], end[order]
    group = np.concatenate([[0], np.cumsum((text[1:] != text[:-1]) | (item[1:] != item[:-1]))])
    apart = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * apart)
    new = np.flatnonzero(np.concatenate([[True], first[1:] + group[1:] * apart > reach[:-1]]))
    return text[new], item[new], first[new], np.append(reach[new[1:] - 1], reach[-1]) - group[new] * apart - first[new]


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of n numbers each, one after the other."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def prints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the fingerprints of texts whose words are h, cut at first."""
    g = W.grams(h, K)
    at = fingerprints(g, _inside(first, len(g), K))
    return g[at], at


def text_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, "right") - 1


class Items:
    """Words, fingerprints (one for each context of an item) and short items of a benchmark."""

    def __init__(self, ids: np.ndarray, texts: pa.Array) -> None:
        hashes, sizes = [], []
        for _, offsets, data in W.blocks(texts):
            w = W.words(data, offsets, W.ALNUM, True)
            hashes.append(w.hash)
            sizes.append(np.diff(w.first))
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.ids = np.asarray(ids, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        g, at = prints(self.hash, self.first)
        text = text_of(self.first, at)
        whole = context_hashes(self._contexts(at, text))
        order = np.lexsort((whole, text, g))
        g, at, text, whole = g[order], at[order], text[order], whole[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
        self.print, self.at, self.text = g[new], at[new], text[new]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.print >> U64(44)).astype(np.int64)] = True
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, SPAN):
            own = np.flatnonzero(size == m)
            if len(own):
                h = np.array([W.grams(self.hash[self.first[i] : self.first[i + 1]], m)[0] for i in own], U64)
                order = np.argsort(h, kind="stable")
                self.short[m] = h[order], own[order]

    def _contexts(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        return contexts(self.hash, self.first[text], self.first[text + 1], at, 1)

    def spans(self, w: W.Words) -> tuple[np.ndarray, ...]:
        """(text, item, first word, words) of each stretch that is covered by shared runs, words counted within the text."""
        found = [*self._runs(w), *self._short(w)]
        return merged(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 4

    def _runs(self, w: W.Words) -> Iterator[tuple[np.ndarray, ...]]:
        if not len(self.print):
            return
        g, at = prints(w.hash, w.first)
        may = self.filter[(g >> U64(44)).astype(np.int64)]
        g, at = g[may], at[may]
        text = text_of(w.first, at)
        own = contexts(w.hash, w.first[text], w.first[text + 1], at, 0)
        _, one, which = np.unique(context_hashes(own), return_index=True, return_inverse=True)
        lo = np.searchsorted(self.print, g[one])
        n = np.searchsorted(self.print, g[one], "right") - lo
        mine, theirs = np.repeat(np.arange(len(one)), n), _ranges(lo, n)
        ok, left, right = agreement(own[one[mine]], self._contexts(self.at[theirs], self.text[theirs]))
        mine, item, left, right = mine[ok], self.text[theirs[ok]], left[ok], right[ok]
        # each context with all its places
        by = np.searchsorted(mine, which)
        n = np.searchsorted(mine, which, "right") - by
        pair, place = _ranges(by, n), np.repeat(np.arange(len(at)), n)
        begin = at[place] - w.first[text[place]]
        yield text[place], item[pair], begin - left[pair], begin + K + right[pair]

    def _short(self, w: W.Words) -> Iterator[tuple[np.ndarray, ...]]:
        for m, (h, own) in self.short.items():
            g = W.grams(w.hash, m)
            lo = np.searchsorted(h, g)
            n = np.where(_inside(w.first, len(g), m), np.searchsorted(h, g, "right") - lo, 0)
            place = np.repeat(np.arange(len(g)), n)
            text = text_of(w.first, place)
            yield text, own[_ranges(lo, n)], place - w.first[text], place - w.first[text] + m


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("item_id IS NOT NULL AND text IS NOT NULL")


def _few(items: DataFrame) -> bool:
    """Whether the items have at most ITEM_WORDS words for certain: a word has a byte and a byte before the next."""
    return (items.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0) <= 2 * ITEM_WORDS


def _loaded(items: DataFrame) -> Items:
    got = items.toArrow().combine_chunks()
    return Items(got.column(0).to_numpy(), pa.chunked_array(got.column(1)).combine_chunks().cast(pa.large_string()))


_SPANS = "spans array<struct<item_id:long,first:long,words:long>>"
_SPAN = pa.struct([("item_id", pa.int64()), ("first", pa.int64()), ("words", pa.int64())])


def _lists(n: int, text: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """Arrow lists of n texts from (item_id, first, words) sorted by text."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_SPAN)))


def shared_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans): for each document the stretches (item_id, first word, words) that runs of an item cover."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _items(benchmark, item_col, item_text)
    if not _few(items):
        return _joined(docs, items).select("doc_id", "n_words", "spans")
    sent = docs.sparkSession.sparkContext.broadcast(_loaded(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = sent.value
        for b in batches:
            for at, offsets, data in W.blocks(b.column(1)):
                w = W.words(data, offsets, W.ALNUM, True)
                n = len(offsets) - 1
                text, item, first, words = use.spans(w)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(np.diff(w.first), pa.int64()), _lists(n, text, use.ids[item], first, words)], names=["doc_id", "n_words", "spans"])

    return docs.mapInArrow(run, f"doc_id long, n_words long, {_SPANS}")


_PRINT = pa.schema([("size", pa.int32()), ("print", pa.int64()), ("context", pa.binary()), ("id", pa.int64())])
_FOUND = pa.schema([*_PRINT, ("text_hash", pa.int64()), ("places", pa.binary()), ("n_words", pa.int64())])


def _binaries(c: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in c], pa.binary())


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, spans) by a join of two tables of fingerprints."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, offsets, data in W.blocks(b.column(1)):
                own = Items(b.column(0).slice(at, len(offsets) - 1).to_numpy(), b.column(1).slice(at, len(offsets) - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own.at), SPAN), pa.int32()), pa.array(own.print.view(np.int64)), _binaries(own._contexts(own.at, own.text)), pa.array(own.ids[own.text], pa.int64())], schema=_PRINT
                )
                for m, (h, k) in own.short.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), m), pa.int32()), pa.array(h.view(np.int64)), pa.nulls(len(k), pa.binary()), pa.array(own.ids[k], pa.int64())], schema=_PRINT)

    theirs = written(items.mapInArrow(of_items, "size int, print long, context binary, id long").distinct(), "items")
    sizes = [r[0] for r in theirs.select("size").distinct().collect()]  # SPAN at most
    cells = theirs.select(F.shiftrightunsigned("print", 64 - FILTER_BITS).alias("cell")).distinct().toArrow().column(0).to_numpy()
    passed = np.zeros(1 << FILTER_BITS, bool)
    passed[cells] = True
    sent = docs.sparkSession.sparkContext.broadcast((sorted(sizes), np.packbits(passed)))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bits = sent.value
        passed = np.unpackbits(bits).astype(bool)
        for b in batches:
            for at, offsets, data in W.blocks(b.column(1)):
                w = W.words(data, offsets, W.ALNUM, True)
                n = len(offsets) - 1
                doc, key = b.column(0).slice(at, n), b.column(2).slice(at, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), doc, key, pa.nulls(n, pa.binary()), pa.array(np.diff(w.first), pa.int64())], schema=_FOUND)
                for m in sizes:
                    g, p = prints(w.hash, w.first) if m == SPAN else (W.grams(w.hash, m), np.flatnonzero(_inside(w.first, max(0, len(w.hash) - m + 1), m)))
                    g = g if m == SPAN else g[p]
                    may = passed[(g >> U64(64 - FILTER_BITS)).astype(np.int64)]
                    g, p = g[may], p[may]
                    text = text_of(w.first, p)
                    c = contexts(w.hash, w.first[text], w.first[text + 1], p, 0) if m == SPAN else None
                    order = np.lexsort((p, g if c is None else context_hashes(c), text))
                    key_of = (g if c is None else context_hashes(c))[order]
                    new = np.ones(len(p), bool)
                    new[1:] = (key_of[1:] != key_of[:-1]) | (text[order][1:] != text[order][:-1])
                    head = np.flatnonzero(new)
                    one = order[head]
                    begin = (p - w.first[text])[order].astype("<i8")
                    for k in range(0, len(one), 4096):
                        u, cut = one[k : k + 4096], np.append(head, len(p))[k : k + 4097]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(u), m), pa.int32()), pa.array(g[u].view(np.int64)), pa.nulls(len(u), pa.binary()) if c is None else _binaries(c[u]),
                                doc.take(pa.array(text[u])), key.take(pa.array(text[u])), pa.array([begin[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)], pa.binary()), pa.nulls(len(u), pa.int64()),
                            ],
                            schema=_FOUND,
                        )

    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    mine = written(keyed.mapInArrow(of_docs, "size int, print long, context binary, id long, text_hash long, places binary, n_words long"), "prints")
    found = mine.where("size > 0").drop("n_words")
    many = max(HOT, -(-found.count() // MOST_HOT))
    hot = found.groupBy("size", "print").agg(F.count("*").alias("rows")).where(F.col("rows") >= many).select("size", "print", F.ceil(F.col("rows") / many).alias("salts"))
    hot = F.broadcast(hot)  # MOST_HOT rows at most
    salts = F.coalesce("salts", F.lit(1))
    x = found.join(hot, ["size", "print"], "left").withColumn("salt", F.pmod(F.xxhash64("id", "text_hash"), salts)).drop("salts")
    y = theirs.join(hot, ["size", "print"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    pairs = x.join(y.select("size", "print", "salt", F.col("context").alias("theirs"), F.col("id").alias("item_id")), ["size", "print", "salt"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(0).to_numpy()
            ok, left, right = np.ones(len(size), bool), np.zeros(len(size), np.int64), size.astype(np.int64)
            long = np.flatnonzero(size == SPAN)
            if len(long):
                both = [np.frombuffer(b"".join(b.column(k).take(pa.array(long)).to_pylist()), U64).reshape(len(long), -1) for k in (1, 2)]
                ok[long], left[long], right[long] = agreement(*both)
                right[long] += K
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (3, 4, 5, 6)), pa.array(left), pa.array(right)], names=["id", "text_hash", "item_id", "places", "left", "right"]).filter(pa.array(ok))

    hits = pairs.select("size", "context", "theirs", "id", "text_hash", "item_id", "places").mapInArrow(verify, "id long, text_hash long, item_id long, places binary, left long, right long")
    by = hits.groupBy("id", "text_hash").agg(F.collect_list(F.struct("item_id", "places", "left", "right")).alias("hits"))
    every = mine.where("size = 0").select("id", "text_hash", "n_words")
    # a null text has a hash too, so only the id may be null
    both = every.join(by.withColumnRenamed("id", "of").withColumnRenamed("text_hash", "own"), F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("own")), "left")

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, item, first, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, got in enumerate(b.column(3)):
                for h in got.as_py() or ():
                    p = np.frombuffer(h["places"], "<i8")
                    t.append(np.full(len(p), i))
                    item.append(np.full(len(p), h["item_id"]))
                    first.append(p - h["left"])
                    end.append(p + h["right"])
            text, *rest = merged(*(np.concatenate(x) for x in (t, item, first, end)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _lists(b.num_rows, text, *rest)], names=["doc_id", "text_hash", "n_words", "spans"])

    return both.select("id", "text_hash", "n_words", "hits").mapInArrow(union, f"doc_id long, text_hash long, n_words long, {_SPANS}")


def report(spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids): hit words counted once, item_ids distinct."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["first"].alias("first"), (s["first"] + s["words"]).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate(
        ordered, start,
        lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["end"], s["first"]))).alias("n")),
    )["n"]
    return spans.select("doc_id", "n_words", hit.alias("n_hit"), F.array_distinct(F.transform("spans", lambda s: s["item_id"])).alias("item_ids"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that share no run with an item, with their columns."""
    items = _items(benchmark, item_col, item_text)
    if not _few(items):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        dirty = _joined(rows, items).where(F.size("spans") > 0).select(F.col("doc_id").alias("dirty id"), F.col("text_hash").alias("dirty text")).distinct()
        same = F.col(id_col).cast("long").eqNullSafe(F.col("dirty id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("dirty text"))
        return docs.join(dirty, same, "left_anti")
    at_text = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(_loaded(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, offsets, data in W.blocks(b.column(at_text)):
                keep = np.ones(len(offsets) - 1, bool)
                keep[sent.value.spans(W.words(data, offsets, W.ALNUM, True))[0]] = False
                yield b.slice(at, len(keep)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
