"""Near-duplicate documents by an exact Jaccard self-join over word shingles.

A document's set holds the 64-bit hashes of its distinct runs of K lower-cased words (fewer words:
the whole sequence). Documents of equal sets are one class; the join runs between classes.

1. One pass gives each document's class and size, and counts shingles: every block of BLOCK_SHINGLES
   reports those it saw LOCAL times or more; those whose sums reach a share SHARE of all shingles are
   frequent (1 / SHARE at most, which bounds the broadcast table).
2. Rare first: sets are ordered by (frequent, count, hash). Sets of Jaccard s or more share a shingle
   among their first n - ceil(s n) + 1. These prefixes are dealt by shingle as packed arrays, each
   class once a block; a shingle that counts as very frequent is dealt over several buckets.
3. In each posting list, ordered by size, pairs pass the length filter and the positional filter; a pair
   that also shares the shingle before this one in both prefixes is left to that list. Short lists give
   all such pairs. Lists over LIST_LIMIT entries give each entry's WINDOW predecessors and the list's
   first HEADS entries, and are kept but for entries that can pass these filters with no other entry of the
   list: once the pairs are verified and joined into components, only pairs of different components are left
   to look at, those of entries outside the list's largest component with all others: in lists with many such
   entries first within groups of some PARTNERS, in the last round all that are still apart. A long list is
   dealt over cells of CELL entries a side, so no list is one task's; in a cell the suffix filter is applied
   before a pair is given out, and no pair is verified twice. So no link between components is lost, and a
   group of thousands of copies costs a few comparisons for each copy and not all its pairs.
4. Every candidate pair is verified once: a suffix filter bounds the overlap by what both sets hold of
   each of many hash ranges; for the pairs left, the texts are read again and the exact overlap decides.
5. Components by alternating minimum labels and pointer jumping, after a spanning forest per partition.

Defined results: null text or no word: empty set, linked with nothing, its own component. Equal sets
link, also below K words. A row is a document: rows of one doc_id each get a row and, if their texts
differ, maybe different components, each named by the least doc_id of its rows. A null doc_id gets the
component of its class. Extra columns are ignored. Texts may have any length. Set sizes are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.components import components
from millrace.operators.dedup import first_of_key
from millrace.session import few, release, written

K = 5
PER_100 = 80
SHARE = 2e-7
LOCAL = 3
BLOCK_SHINGLES = 4 << 20
LIST_LIMIT = 6
WINDOW = 3
HEADS = 2
#: Entries of the groups in which lists with more entries than that outside their largest component meet, in each round
#: across components; None: all lists, and all entries.
PARTNERS = (32, 256, None)
#: Entries on each side of a cell of a long list, about, and pairs that are looked at together.
CELL, PAIRS = 2048, 1 << 20
#: Hash ranges of a sketch, for the suffix filter within cells.
SKETCH = 256
#: Entries of one shingle that go to one bucket, about; lists that are longer by the counts are dealt over several.
HOT = 500_000
_DEALT = 1 << 31
#: Rows of ids or names that are broadcast; tables of more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Entries that are dealt to buckets together, each class once.
HELD = 1 << 19
#: Bytes of packed prefixes that a task takes, about.
BUCKET_BYTES = 8 << 20
U64 = np.uint64


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for at, offsets, data in W.blocks(column):
        w = W.words(data, offsets, W.NOT_SPACE, True)
        g = W.grams(w.hash, K)
        for i in range(len(offsets) - 1):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= K:
                yield at + i, np.unique(g[a : b - K + 1])
            elif b > a:
                yield at + i, W.mix(W.grams(w.hash[a:b], int(b - a)) + U64(b - a))
            else:
                yield at + i, np.zeros(0, U64)


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(W.mix(np.array([np.add.reduce(W.mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64) + U64(len(s))], U64)).view(np.int64)[0])


def _frequent_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of LOCAL sets or more, their counts); empties the list, and works in little more than one copy."""
    s = np.concatenate(sets)
    sets.clear()
    s.sort()
    start = np.flatnonzero(s[: len(s) - LOCAL + 1] == s[LOCAL - 1 :])
    start = start[(start == 0) | (s[start - 1] != s[start])]
    u = s[start]
    return u, np.searchsorted(s, u, "right") - start


_FIRST = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("ranges", pa.binary()), ("shingle", pa.int64()), ("seen", pa.int64())])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        cls, ns, ranges = [0] * b.num_rows, [0] * b.num_rows, [b""] * b.num_rows
        for i, s in shingle_sets(b.column(1)):
            cls[i], ns[i], ranges[i] = class_of(s), len(s), signature(s)
            held.append(s)
            size += len(s)
            if size >= BLOCK_SHINGLES:
                yield _seen(*_frequent_of(held))
                held, size = [], 0
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cls, pa.int64()), pa.array(ns, pa.int64()), pa.array(ranges, pa.binary()), none, none], schema=_FIRST)
    if size:
        yield _seen(*_frequent_of(held))


def _seen(u: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(u), pa.binary()), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], schema=_FIRST)


def rare_first(s: np.ndarray, frequent: np.ndarray, count: np.ndarray, filt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s with its frequent shingles last, in the order of their counts, those counts); s is sorted."""
    maybe = filt[(s >> U64(44)).astype(np.int64)]
    if not maybe.any():
        return s, np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    hot = frequent[at] == s
    if not hot.any():
        return s, np.zeros(0, np.int64)
    last, n = s[hot], count[at[hot]]
    order = np.lexsort((last, n))
    return np.concatenate([s[~hot], last[order]]), n[order]


def prefix_length(n: int, per_100: int) -> int:
    return n - (per_100 * n + 99) // 100 + 1


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int, per_100: int) -> DataFrame:
    """(bucket, data): packed (shingle, class, size, position) entries."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = sent.value
        filt = np.zeros(1 << 20, bool)
        filt[(hot >> U64(44)).astype(np.int64)] = True
        held, salts, known, size = [], [], set(), 0
        for b in batches:
            for _, s in shingle_sets(b.column(0)):
                n = len(s)
                if n and (c := class_of(s)) not in known:
                    known.add(c)
                    p = prefix_length(n, per_100)
                    e = np.empty(p, ENTRY)
                    order, counts = rare_first(s, hot, count, filt)
                    e["shingle"], e["class"], e["n"], e["pos"] = order[:p], c, n, np.arange(p)
                    e["before"][0], e["before"][1:] = U64(c & (2**64 - 1)), e["shingle"][:-1]
                    parts = np.concatenate([np.ones(n - len(counts), np.int64), 1 + counts // HOT])[:p]
                    e["pos"][parts > 1] += np.uint32(_DEALT)
                    salts.append(c % parts)
                    held.append(e)
                    size += p
                if size > HELD:
                    yield deal(held, salts)
                    held, salts, known, size = [], [], set(), 0
        if held:
            yield deal(held, salts)

    def deal(held: list[np.ndarray], salts: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(held)
        to = (W.mix(e["shingle"] + np.concatenate(salts).astype(U64)) % U64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        e = e[order]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([e[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())], names=["bucket", "data"])

    return docs.select("text").mapInArrow(pack, "bucket int, data binary")


ENTRY = np.dtype([("shingle", "<u8"), ("class", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("before", "<u8")])


def _pairs(e: np.ndarray, i: np.ndarray, j: np.ndarray, per_100: int) -> np.ndarray:
    """Those of the pairs (i, j) of entries of one list that pass the length and positional filters."""
    a, b = e[i], e[j]
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    least = least_overlap(na, nb, per_100)
    rest = 1 + np.minimum(na - a["pos"] - 1, nb - b["pos"] - 1)
    ok = (100 * np.minimum(na, nb) >= per_100 * np.maximum(na, nb)) & (rest >= least) & (a["class"] != b["class"]) & (a["before"] != b["before"])
    x, y = a["class"][ok], b["class"][ok]
    return np.stack([np.minimum(x, y), np.maximum(x, y)], 1)


def list_pairs(e: np.ndarray, per_100: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidate pairs, entries of long lists) of posting lists, sorted by (shingle, size, class). A list that is
    dealt over several buckets is long whatever its share here."""
    dealt = e["pos"] >= _DEALT
    e = e.copy()
    e["pos"][dealt] -= np.uint32(_DEALT)
    new = np.concatenate([[True], e["shingle"][1:] != e["shingle"][:-1]])
    head = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    size = np.diff(np.concatenate([head, [len(e)]]))[of]
    place = np.arange(len(e)) - head[of]
    many = (size > 1) | dealt
    e, of, size, place, dealt = e[many], of[many], size[many], place[many], dealt[many]
    i = np.flatnonzero(place == 0)
    head = np.repeat(i, size[i])
    long = (size > LIST_LIMIT) | dealt
    held = []
    for d in range(1, min(LIST_LIMIT, int(size.max(initial=1)))):
        j = np.flatnonzero((place >= d) & ~long if d > WINDOW else place >= d)
        held.append(_pairs(e, j - d, j, per_100))
    for h in range(HEADS):
        j = np.flatnonzero(long & (place > h))
        held.append(_pairs(e, head[j] + h, j, per_100))
    pairs = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
    kept, of, whole = e[long], of[long], ~dealt[long]
    for _ in range(2):
        may = ~whole | has_partner(kept, of, per_100)
        kept, of, whole = kept[may], of[may], whole[may]
    return np.unique(pairs, axis=0), kept


def has_partner(e: np.ndarray, of: np.ndarray, per_100: int) -> np.ndarray:
    """Which entries of lists (sorted by list and size; of names the list) have some other entry of a size that the length
    filter and their own place allow, in a list whose entries don't all have the same shingle before this one."""
    if not len(e):
        return np.zeros(0, bool)
    n = e["n"].astype(np.int64)
    most = np.minimum(100 * n // per_100, (100 + per_100) * (n - e["pos"]) // per_100 - n)
    least = -(-per_100 * n // 100)
    base = of.astype(np.int64) << 33
    key = base + n
    partners = np.searchsorted(key, base + most, "right") - np.searchsorted(key, base + least) - ((least <= n) & (n <= most))
    new = np.concatenate([[True], of[1:] != of[:-1]])
    head = np.flatnonzero(new)
    mixed = np.minimum.reduceat(e["before"], head) != np.maximum.reduceat(e["before"], head)
    return (partners > 0) & mixed[np.cumsum(new) - 1]


def candidates(packed: DataFrame, buckets: int, per_100: int) -> DataFrame:
    """(a, b, shingle, class, n, pos, before): candidate pairs of classes, and the entries of long lists (a is null)."""

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                kept.setdefault(k, []).append(np.frombuffer(d.as_py(), ENTRY))
        for k in list(kept):
            e = np.concatenate(kept.pop(k))
            e = e[np.lexsort((e["class"], e["n"], e["shingle"]))]
            again = np.zeros(len(e), bool)
            again[1:] = (e["shingle"][1:] == e["shingle"][:-1]) & (e["class"][1:] == e["class"][:-1])
            pairs, long = list_pairs(e[~again], per_100)
            for at in range(0, len(pairs), ROWS):
                p = pairs[at : at + ROWS]
                yield _rows(p[:, 0], p[:, 1], *[None] * 5)
            for at in range(0, len(long), ROWS):
                x = long[at : at + ROWS]
                yield _rows(None, None, x["shingle"].view(np.int64), x["class"], x["n"].astype(np.int64), x["pos"].astype(np.int64), x["before"].view(np.int64))

    return packed.repartition(buckets, "bucket").mapInArrow(of_part, "a long, b long, shingle long, class long, n long, pos long, before long")


_CANDIDATE = pa.schema([(n, pa.int64()) for n in ("a", "b", "shingle", "class", "n", "pos", "before")])
ROWS = 1 << 16


def _rows(*columns: np.ndarray | None) -> pa.RecordBatch:
    n = max(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(np.ascontiguousarray(c)) for c in columns], schema=_CANDIDATE)


def signature(s: np.ndarray) -> bytes:
    """How many elements each of 2^r equal hash ranges holds (255 at most), one or two on average."""
    r = max(0, len(s).bit_length() - 1)
    counts = np.bincount((s >> U64(63 - r) >> U64(1)).astype(np.int64), minlength=1 << r)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def suffix_bound(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """An upper bound of the overlap of two sets from their signatures: as much as both hold of each range."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if max(a.max(initial=0), b.max(initial=0)) == 255:
        return min(nx, ny)
    a, b = a.astype(np.int64), b.astype(np.int64)
    m = min(len(a), len(b))
    return int(np.minimum(a.reshape(m, -1).sum(1), b.reshape(m, -1).sum(1)).sum())


def least_overlap(na: int, nb: int, per_100: int) -> int:
    return -(-per_100 * (na + nb) // (100 + per_100))


def linked(a: np.ndarray, b: np.ndarray, per_100: int) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) >= least_overlap(len(a), len(b), per_100)


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, per_100: int) -> DataFrame:
    """A written table of those pairs (a, b) of classes that link. reps: (class, doc_id, n, ranges); docs: (doc_id, text)."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, nx, ny = b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist()
            ok = [suffix_bound(x[i].as_buffer(), y[i].as_buffer(), nx[i], ny[i]) >= least_overlap(nx[i], ny[i], per_100) for i in range(b.num_rows)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    x, y = (reps.select(F.col("class").alias(k), F.col("ranges").alias(f"r{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    pairs = written(pairs.join(x, "a").join(y, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(bounded, "a long, b long"), "bounded")
    need = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(reps.select("class", "doc_id"), "class")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, out = b.column(0).to_pylist(), {}
            for i, s in shingle_sets(b.column(1)):
                if class_of(s) == own[i]:  # a repeated doc_id may have other texts
                    out[own[i]] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["class", "data"])

    need = written(need, "needed")
    text = docs.join(_few(need), docs["doc_id"].eqNullSafe(need["doc_id"])).select("class", "text")
    held = written(text.mapInArrow(sets, "class long, data binary"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            ok = [linked(np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64), per_100) for i in range(b.num_rows)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(held.select(F.col("class").alias("a"), F.col("data").alias("x")), "a").join(held.select(F.col("class").alias("b"), F.col("data").alias("y")), "b")
    out = written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
    release(pairs, need, held)
    return out


def _candidates_of(docs: DataFrame, id_col: str, text_col: str, per_100: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs as doc_id and text, their classes, a representative of each class, candidates); all but docs are written."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_first_pass, "doc_id long, text_hash long, class long, n long, ranges binary, shingle long, seen long")
    first = written(first, "shingles")
    members = first.where("n is not null").select("doc_id", "text_hash", "class", "n", "ranges")
    total = members.agg(F.sum("n")).first()[0] or 0
    seen = first.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(LOCAL, SHARE * total))
    hot = seen.orderBy(F.expr("shingle ^ -9223372036854775808")).toArrow()  # 1 / SHARE rows at most, as flat arrays; unsigned order
    frequent = (hot.column(0).to_numpy().view(U64), hot.column(1).to_numpy()) if len(hot) else (np.array([2**64 - 1], U64), np.array([0]))
    buckets = int(max(docs.sparkSession.sparkContext.defaultParallelism, total * (100 - per_100 + 1) // 100 * ENTRY.itemsize // BUCKET_BYTES, 1))
    found = written(candidates(prefixes(docs, frequent, buckets, per_100), buckets, per_100), "candidates")
    reps = members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("ranges").alias("ranges"))
    return docs, members, written(reps, "classes"), found


def _grouped(docs: DataFrame, id_col: str, text_col: str, per_100: int) -> DataFrame:
    """(doc_id, text_hash, n, part): part names the component of each row, null for rows without a word."""
    docs, members, reps, found = _candidates_of(docs, id_col, text_col, per_100)
    tested = [written(found.where("a is not null").select("a", "b").distinct(), "pairs")]
    links = verify(tested[0], reps, docs, per_100)
    labels = components(links)
    at, mixed = mixed_lists(found.where("shingle is not null").select("shingle", "class", "n", "pos", "before"), labels)
    for partners in PARTNERS:
        now = mixed.where(F.col("n_away") > partners) if partners else mixed
        if now.isEmpty():
            continue
        more = across(at, now, reps, per_100, partners)
        for t in tested:
            more = more.join(_few(t), ["a", "b"], "left_anti")
        more = written(more, "pairs")
        tested.append(more)
        new = verify(more, reps, docs, per_100)
        if new.isEmpty():
            release(new)
            continue
        old, was = links, labels
        links = written(old.unionByName(new), "links")
        labels = components(links)
        release(new, old, was)
        if partners:
            before = at, mixed
            at, mixed = mixed_lists(at.select("shingle", "class", "n", "pos", "before"), labels)
            release(*before)
    release(found, reps, links, at, mixed, *tested)
    named = members.select("doc_id", "text_hash", "class", "n").join(_few(labels.select(F.col("node").alias("class"), "label")), "class", "left")
    return named.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("label", "class")).alias("part"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_100: int = PER_100) -> DataFrame:
    """(id_col, n_shingles, component_id): one row for each row of docs."""
    named = _grouped(docs, id_col, text_col, per_100)
    least = named.where("n > 0").groupBy("part").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("part", "least")
    out = named.join(_few(written(least, "least")), "part", "left")  # who is alone is in no row of it, and names itself
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_100: int = PER_100) -> tuple[DataFrame, DataFrame]:
    """((a, b) of every two classes that link, a < b; (id_col, class) of every row with a word). Rows of one class link
    too. No link is left out, so a long list costs all its pairs that pass the filters."""
    docs, members, reps, found = _candidates_of(docs, id_col, text_col, per_100)
    at = found.where("shingle is not null").select("shingle", "class", "n", "pos", "before", F.col("class").alias("part"), F.lit(True).alias("away"))
    sizes = at.groupBy("shingle").agg(F.count("*").alias("size"), F.count("*").alias("n_away"))
    pairs = found.where("a is not null").select("a", "b").unionByName(_met(at.join(_few(sizes), "shingle"), reps, per_100, None))
    return verify(pairs.distinct(), reps, docs, per_100), members.where("n > 0").select(F.col("doc_id").alias(id_col), "class")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_100: int = PER_100) -> DataFrame:
    """docs with one row of each component: that of its least doc_id (then of the least text hash, and then the least in
    all columns). Rows without a word all stay. Only rows that go are looked up, so texts are moved only if they are many."""
    named = _grouped(docs, id_col, text_col, per_100).where("n > 0")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = written(named.select("part", key.alias("key")), "grouped")
    kept = written(named.groupBy("part").agg(F.min("key").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("part", "least"), "least")
    placed = named.join(_few(kept), "part")
    go = written(placed.where("key != least").select("key.doc_id", "key.text_hash").distinct(), "copies")
    again = written(placed.where("key = least").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key.doc_id", "key.text_hash"), "repeated")
    release(named, kept)
    one = docs.join(_few(go), _is(docs, go, id_col, text_col), "left_anti")
    if again.isEmpty():
        return one
    rest = one.join(_few(again), _is(docs, again, id_col, text_col), "left_anti")
    return rest.unionByName(first_of_key(one.join(_few(again), _is(docs, again, id_col, text_col), "left_semi"), [id_col, text_col], []))


def _few(ids: DataFrame) -> DataFrame:
    return few(ids, BROADCAST_IDS)


def _is(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str):
    return docs[id_col].cast("long").eqNullSafe(ids["doc_id"]) & (F.xxhash64(docs[text_col].cast("string")) == ids["text_hash"])


def mixed_lists(lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with their component, (shingle, size, n_away, largest)) of the long lists that hold several components,
    n_away entries outside the largest; a list of one component needs no further look. Both are written."""
    every = lists.join(_few(labels.select(F.col("node").alias("class"), "label")), "class", "left")
    every = written(every.select("shingle", "class", "n", "pos", "before", F.coalesce("label", "class").alias("part")), "entries")
    parts = every.groupBy("shingle", "part").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("shingle").agg(F.max(F.struct("size", "part")).alias("largest"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    mixed = written(mixed.select("shingle", "size", (F.col("size") - F.col("largest.size")).alias("n_away"), F.col("largest.part").alias("largest")), "lists")
    at = written(every.join(_few(mixed.select("shingle")), "shingle", "left_semi"), "entries")
    release(every)
    return at, mixed


def across(at: DataFrame, lists: DataFrame, reps: DataFrame, per_100: int, partners: int | None) -> DataFrame:
    """Candidate pairs of entries of some of the mixed lists whose components differ: those within groups of about
    `partners` entries, or all."""
    at = at.join(_few(lists), "shingle").withColumn("away", F.col("part") != F.col("largest")).drop("largest")
    return _met(at, reps, per_100, partners)


def _met(at: DataFrame, reps: DataFrame, per_100: int, partners: int | None) -> DataFrame:
    """Distinct candidate pairs (a, b) of entries (shingle, class, n, pos, before, part, away, size, n_away) of one list:
    those of different parts, one of them away, that pass all filters. size: entries of the list; n_away: those away."""
    need = _few(written(at.select("class").distinct(), "needed"))
    at = at.join(reps.join(need, "class").select("class", "ranges").mapInArrow(_sketches, "class long, sketch binary"), "class")
    no, yes, zero = F.lit(False), F.lit(True), F.lit(0).cast("long")
    if partners:
        group = F.pmod(F.xxhash64("class", F.lit(partners)), F.ceil(F.col("size") / partners))
        at = at.withColumn("cell", F.array(F.struct(group.alias("i"), zero.alias("j"), F.col("away").alias("x"), yes.alias("y"))))
    else:
        rows, columns = F.ceil(F.col("n_away") / CELL), F.ceil(F.col("size") / CELL)
        mine, theirs = F.pmod(F.xxhash64("class", F.lit(-1)), rows), F.pmod(F.xxhash64("class", F.lit(-2)), columns)
        x = F.transform(F.sequence(zero, columns - 1), lambda j: F.struct(mine.alias("i"), j.alias("j"), yes.alias("x"), no.alias("y")))
        y = F.transform(F.sequence(zero, rows - 1), lambda i: F.struct(i.alias("i"), theirs.alias("j"), no.alias("x"), yes.alias("y")))
        at = at.withColumn("cell", F.when(F.col("away"), F.concat(x, y)).otherwise(y))
    entry = ["class", "n", "pos", "before", "part", "away", "sketch"]
    dealt = at.select("shingle", F.explode("cell").alias("c"), *entry).select("shingle", "c.*", *entry)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _whole_cells(batches):
            yield from _cell_pairs(cells, per_100)

    return dealt.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j").mapInArrow(pairs, "a long, b long").distinct()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures folded to SKETCH ranges at most."""
    for b in batches:
        out = []
        for r in b.column(1):
            s = np.frombuffer(r.as_buffer(), np.uint8)
            wide = len(s) // SKETCH
            whole = s.max(initial=0) == 255
            out.append((np.full(SKETCH, 255, np.uint8) if whole else np.minimum(s.reshape(SKETCH, -1).sum(1, dtype=np.int64), 255).astype(np.uint8)).tobytes() if wide > 1 else s.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["class", "sketch"])


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, sorted by their first three columns, as tables that no group of these is cut by."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
        same = held and all(held[-1].column(k)[-1] == b.column(k)[0] for k in range(3))
        cut = int(change[-1]) + 1 if len(change) else 0 if same else None
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _cell_pairs(cells: pa.Table, per_100: int) -> Iterator[pa.RecordBatch]:
    keys = np.stack([cells.column(k).to_numpy() for k in range(3)], 1)
    group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
    x, y, away = (cells.column(k).to_numpy() for k in ("x", "y", "away"))
    cls, n, pos, before, part = (cells.column(k).to_numpy() for k in ("class", "n", "pos", "before", "part"))
    sketch = _Sketches(cells.column("sketch").to_pylist())
    xs, ys = np.flatnonzero(x), np.flatnonzero(y)
    lo = np.searchsorted(group[ys], group[xs])
    many = np.searchsorted(group[ys], group[xs], "right") - lo
    if not len(xs):
        return
    cuts = np.flatnonzero(np.diff((np.cumsum(many) - many) // PAIRS, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(xs)), strict=True):
        k = many[a:b]
        i = np.repeat(xs[a:b], k)
        j = ys[np.repeat(lo[a:b] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        ok = (part[i] != part[j]) & (before[i] != before[j]) & (~away[j] | (cls[i] < cls[j]))
        i, j = i[ok], j[ok]
        need = -(-per_100 * (n[i] + n[j]) // (100 + per_100))
        ok = (100 * np.minimum(n[i], n[j]) >= per_100 * np.maximum(n[i], n[j])) & (1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= need)
        i, j, need = i[ok], j[ok], need[ok]
        ok = sketch.bound(i, j) >= need
        got = np.unique(np.stack([np.minimum(cls[i[ok]], cls[j[ok]]), np.maximum(cls[i[ok]], cls[j[ok]])], 1), axis=0)
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])


class _Sketches:
    def __init__(self, raw: list[bytes]) -> None:
        self.raw, self.size = raw, np.fromiter(map(len, raw), np.int64, len(raw))
        self.folded: dict[int, np.ndarray] = {}

    def _of(self, m: int) -> np.ndarray:
        """All sketches of m ranges or more folded to m; a range that is full may hold anything."""
        if m not in self.folded:
            out = np.zeros((len(self.raw), m), np.uint16)
            for size in np.unique(self.size[self.size >= m]).tolist():
                at = np.flatnonzero(self.size == size)
                s = np.frombuffer(b"".join(self.raw[k] for k in at), np.uint8).reshape(len(at), m, -1)
                out[at] = np.where((s == 255).any(2), 65535, s.sum(2, dtype=np.int64))
            self.folded[m] = out
        return self.folded[m]

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """An upper bound of the overlap of each pair."""
        out, least = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for m in np.unique(least).tolist():
            of, at = self._of(m), np.flatnonzero(least == m)
            for k in range(0, len(at), 1 << 13):
                own = at[k : k + (1 << 13)]
                out[own] = np.minimum(of[i[own]], of[j[own]]).sum(1, dtype=np.int64)
        return out
