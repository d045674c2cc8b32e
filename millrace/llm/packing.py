"""Packing of token runs into sequences: bounded-space online best fit.

A document's ids are cut into runs of CAPACITY from its end, so that only its first run may be shorter.
Runs arrive in a hashed order. `turn` of them arrive together, the longest first: 1 is plain online packing,
TURN looks that far ahead, which needs fewer sequences in the same space. A fixed number of sequences is
open; a bitset has a bit for every free space that some open sequence has. A run goes where it leaves least free (the lowest set bit from its
length up). If none fits, a sequence is opened, and when BINS are open already the fullest is closed
first. Each partition packs by itself, with PER_TASK runs, so what stays open at the end is a small
share; runs are dealt evenly whatever their ids or texts. A run of CAPACITY is a sequence of its own: it
stays in the partition it was read in and no task holds it.

Defined results: null text is empty (its run is the end id alone); without an end id an empty document
has no run. Equal rows are packed each. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.tokens import encoder
from millrace.session import written

CAPACITY = 1024
BINS = 1024
#: Runs that arrive together, the longest first; 1: each by itself.
TURN = 1024
#: Runs of less than CAPACITY that one task packs, about.
PER_TASK = 200_000
#: Sequences of one run of CAPACITY are numbered from here.
FULL = 1 << 62


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, bins: int = BINS) -> Iterator[tuple[int, int]]:
    """(sequence, offset) of each run, sequences numbered as they are opened."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = n_open = opened = 0
    for n in lengths:
        fit = bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            at = open_at[free].pop()
            if not open_at[free]:
                bits ^= 1 << free
            n_open -= 1
        else:
            at, free = opened, capacity
            opened += 1
        yield at, capacity - free
        free -= n
        if free:
            if n_open == bins:
                least = (bits & -bits).bit_length() - 1
                if least < free:
                    open_at[least].pop()
                    if not open_at[least]:
                        bits ^= 1 << least
                    n_open -= 1
                else:
                    continue  # the new one is the fullest
            open_at[free].append(at)
            bits |= 1 << free
            n_open += 1


def runs(docs: DataFrame, vocabulary: str, end: int | None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every run of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(vocabulary, end)
        for b in batches:
            for at, ends, raw in W.blocks(b.column(1)):
                rows = len(ends) - 1
                flat, offsets = use.block(raw, ends)
                data = memoryview(flat.astype("<u4")).cast("B")
                size = np.diff(offsets)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = size - capacity * (pieces - 1)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                a = offsets[:-1][doc] + start
                spans = list(zip((4 * a).tolist(), (4 * (a + length)).tolist(), strict=True))
                out = [
                    b.column(0).slice(at, rows).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(data[x:y]) for x, y in spans], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([bytes(data[x:y]) for x, y in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(made: DataFrame, capacity: int = CAPACITY, bins: int = BINS, turn: int = TURN) -> DataFrame:
    """made (of runs(), or any table with a length) with sequence_id and offset. The runs are written once."""
    made = written(made, "runs")
    shorter = made.where(F.col("length") < capacity)
    tasks = 1 + shorter.count() // PER_TASK
    names = made.columns
    schema = made.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        part = TaskContext.get().partitionId() << 40
        t = pa.Table.from_batches(held)
        length = t.column("length").to_numpy()
        order = np.lexsort((-length, np.arange(len(length)) // turn))
        at = np.empty((len(length), 2), np.int64)
        at[order] = list(best_fit(length[order].tolist(), capacity, bins))
        t = t.append_column("sequence_id", pa.array(part + at[:, 0])).append_column("offset", pa.array(at[:, 1]))
        yield from t.to_batches(1 << 16)

    dealt = shorter.repartition(tasks).withColumn("turn", F.xxhash64(*names)).sortWithinPartitions("turn").drop("turn")
    own = (F.lit(FULL) + F.monotonically_increasing_id()).alias("sequence_id")
    full = made.where(F.col("length") == capacity).select("*", own, F.lit(0).cast("long").alias("offset"))
    return dealt.mapInArrow(place, schema).unionByName(full)


def sequences(docs: DataFrame, vocabulary: str, end: int | None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, ids as little-endian unsigned 32-bit integers. Runs are
    packed by their lengths alone, so no task holds the ids of more than the sequences it puts together."""
    made = written(runs(docs, vocabulary, end, capacity, with_ids=True).withColumn("run", F.monotonically_increasing_id()), "ids")
    placed = pack(made.select("run", "length"), capacity).drop("length")
    own = placed.join(made.select("run", "ids", "doc_id"), "run").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("r"))
    empty = F.lit(b"").cast("binary")
    return own.select("sequence_id", F.aggregate("r", empty, lambda acc, x: F.concat(acc, x["ids"])).alias("ids"), F.transform("r", lambda x: x["doc_id"]).alias("doc_ids"))
