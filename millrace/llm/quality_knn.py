"""Quality by nearest neighbours in a latent-semantic space.

A text's terms are its words (as written and lower-cased), the shapes of its words (runs of capitals,
small letters, digits and other signs) and whether words repeat the one before; they are hashed into
TERMS columns, weighted by log frequency and inverse document frequency, and normalised. A truncated
singular value decomposition of the labelled texts gives RANK directions. Every document is projected,
its cosine to every labelled vector is computed exactly (a matrix product in blocks), and its NEIGHBOURS
nearest labelled texts vote with their similarity to the power SHARP.

Learning: labelled rows are sampled by a hash of their id so that about SAMPLE are used whatever their
number; if ids are of many rows, the rows found are sampled once more, by a hash of id and text. So the
broadcast vectors have a fixed size, and the driver holds no more than that.

Defined results: null and empty texts (and all texts if there is no label) are like nothing, so their
score is the labelled share of ones (0.5 without labels). Ties among neighbours go to the earlier in
hash order. Null labels are not learnt from; of several labels of a document each counts, and so does each
text under its id, but equal rows (of one id, label and terms) are learnt once. Repeated rows each get a
score; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.lang_id import sampled

TERMS = 4096
RANK = 64
SAMPLE = 4000
#: Times SAMPLE that the rows of the sampled ids may be before they are sampled themselves.
SLACK = 1.25
NEIGHBOURS = 15
SHARP = 4
#: Bytes (one text at least) and texts of a block; its dense matrix has a row for each text.
BLOCK, ROWS = 1 << 20, 512
PRIOR = 0.05
_CLASS = np.array([ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)], np.uint8)
_SPACE = ~W.NOT_SPACE


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x TERMS counts of hashed terms."""
    n = len(offsets) - 1
    out = np.zeros(n * TERMS, np.int32)

    def add(w: W.Words, h: np.ndarray, salt: int, text: np.ndarray | None = None) -> None:
        column = (W.mix(h ^ W.U64(salt)) % W.U64(TERMS)).astype(np.int64)
        cell, times = np.unique((w.text_of_word() if text is None else text) * TERMS + column, return_counts=True)
        out[cell] += times.astype(np.int32)

    lower = W.words(data, offsets, W.ALNUM, True)
    add(lower, lower.hash, 1)
    raw = W.words(data, offsets, W.NOT_SPACE, False)
    add(raw, raw.hash, 2)
    of = raw.text_of_word()
    again = np.flatnonzero((raw.hash[1:] == raw.hash[:-1]) & (of[1:] == of[:-1])) + 1
    add(raw, np.full(len(again), 7, W.U64), 3, of[again])
    shape = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | _SPACE[data[1:]]
    inner = offsets[1:-1]
    keep[inner[inner < len(data)]] = True
    shapes = W.words(shape[keep], np.concatenate([[0], np.cumsum(keep)])[offsets], W.NOT_SPACE, False)
    add(shapes, shapes.hash, 4)
    return out.reshape(n, TERMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


class Model:
    def __init__(self, counts: np.ndarray, labels: np.ndarray) -> None:
        """counts: labelled texts x TERMS; labels: 0 or 1."""
        n = len(labels)
        self.prior = float(labels.mean()) if n else 0.5
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = weighted(counts, self.idf)
        rank = min(RANK, n)
        basis = np.random.default_rng(7).standard_normal((TERMS, min(n, rank + 16))).astype(np.float32) if n else np.zeros((TERMS, 0), np.float32)
        for _ in range(4 if n else 0):  # subspace iteration
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        if n:
            _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
            basis = basis @ right[:rank].T
        self.basis = basis.astype(np.float32)
        self.vectors = self.project(x)

    def project(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.basis
        return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        n = len(counts)
        if not len(self.labels):
            return np.full(n, self.prior)
        cosine = self.project(weighted(counts, self.idf)) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARP
        return ((w * self.labels[near]).sum(1) + PRIOR * self.prior) / (w.sum(1) + PRIOR)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().distinct()
    chosen = sampled(known, F.col("doc_id"), sample)  # about `sample` rows, so they are broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    if texts.select("doc_id").count() > SLACK * sample:
        texts = _few_texts(texts, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, offsets, data in W.blocks(b.column(2), BLOCK, ROWS):
                c = term_counts(data, offsets)
                cells = [np.flatnonzero(r) for r in c]
                n = len(c)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array([x.astype("<u2").tobytes() for x in cells], pa.binary()), pa.array([r[x].astype("<u4").tobytes() for r, x in zip(c, cells, strict=True)], pa.binary())],
                    names=["doc_id", "label", "at", "n"],
                )

    got = texts.mapInArrow(count, "doc_id long, label int, at binary, n binary").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "at", "n").collect()
    got = [r for r, before in zip(got, [None, *got], strict=False) if r != before]
    counts = np.zeros((len(got), TERMS), np.int32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
    return Model(counts, np.array([r["label"] for r in got], np.float32))


def _few_texts(texts: DataFrame, sample: int) -> DataFrame:
    """About sample of the distinct rows of texts (doc_id, label, text); all if there are no more."""
    keyed = texts.withColumn("hash", F.xxhash64("text"))
    n = keyed.select("doc_id", "label", "hash").distinct().count()  # numbers are moved, no text
    if n > sample:
        keyed = keyed.where(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    return keyed.dropDuplicates(["doc_id", "label", "hash"]).drop("hash")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score): one row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, offsets, data in W.blocks(b.column(1), BLOCK, ROWS):
                got = sent.value.scores(term_counts(data, offsets))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(got)), pa.array(got)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumnRenamed("doc_id", id_col)


def without_rejected(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score threshold or more, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, offsets, data in W.blocks(b.column(at_text), BLOCK, ROWS):
                got = sent.value.scores(term_counts(data, offsets))
                yield b.slice(at, len(got)).filter(pa.array(got >= threshold))

    return docs.mapInArrow(run, docs.schema)
