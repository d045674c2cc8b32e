"""Language identification by words, backing off to character n-grams.

For each language the model has the logarithm of the relative frequency of its words, and of the
character n-grams (1 to LONGEST letters, words padded by a space on both sides). A word of a text that
some language knows is scored by its frequency in each; an unknown one by the mean over its n-grams of
the greatest length at which some n-gram is known. A language without the word or n-gram gets PENALTY.
A text's language has the highest mean over its words.

Learning: labelled rows are sampled by a hash of their id so that about SAMPLE are used whatever their
number (all, if there are fewer); nothing else bounds the model. It holds each word and n-gram of the sample
once, with a number for each language that has it, so many languages cost no more than their own words. A
cutoff (a relative frequency in the language below which words and n-grams are not known) makes it smaller;
it is 0 unless the caller sets it.

Defined results: `und` with score 0 for null texts and texts without a letter, and for every text if
nothing was learnt. The score is the language's share among the learnt ones (a softmax of the means,
sharpened with the number of words up to SHARP). Equal means go to the first language in order. Labels
that are null, and null texts, are not learnt from. Repeated rows each get a row; extra columns are
ignored; texts may have any length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.session import release, written

SAMPLE = 20_000
PENALTY = -7.0
LONGEST = 5
SHARP = 10
#: Numbers (one a word and language) that a worker keeps for words that it has met.
CACHE = 4_000_000
#: Texts, and their bytes (one text at least), that are worked on together.
TEXTS, TEXT_BYTES = 256, 1 << 20
_WORD = regex.compile(r"\p{L}+")


def sampled(labelled: DataFrame, key: Column, bound: int) -> DataFrame:
    """About bound rows of labelled, chosen by a hash of key; all if there are no more."""
    n = labelled.count()
    if n <= bound:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(bound / n * (1 << 40)))


class Table:
    """Scores of items in the languages that have them: those of item i are at starts[i] to starts[i + 1]."""

    def __init__(self, found: pa.Table, languages: list[str]) -> None:
        """found: (item, lang, score), sorted by item."""
        found = found.combine_chunks()
        items, lang = found.column(0).combine_chunks() if found.num_rows else pa.array([], pa.string()), found.column(1)
        runs = pc.run_end_encode(items)
        self.items = runs.values
        self.starts = np.concatenate([[0], runs.run_ends.to_numpy()]).astype(np.int64)
        self.lang = pc.index_in(lang, pa.array(languages, pa.string())).to_numpy().astype(np.int32)
        self.scores = found.column(2).to_numpy().astype(np.float32)

    def rows(self, at: np.ndarray, n: int) -> np.ndarray:
        """at x n scores, PENALTY for languages without the item."""
        size = self.starts[at + 1] - self.starts[at]
        places = np.repeat(self.starts[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out = np.full((len(at), n), PENALTY, np.float32)
        out[np.repeat(np.arange(len(at)), size), self.lang[places]] = self.scores[places]
        return out

    def index(self) -> dict[str, int]:
        names = self.items.to_pylist()
        return dict(zip(names, range(len(names)), strict=True))


class Model:
    def __init__(self, languages: list[str], words: Table, grams: Table) -> None:
        self.languages, self.words, self.grams = languages, words, grams


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, cutoff: float = 0.0) -> Model:
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    words = sampled(rows, F.col("id"), sample).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("item"))
    counts = written(words.groupBy("lang", "item").agg(F.count("*").alias("n")), "words")
    padded = F.concat(F.lit(" "), F.col("item"), F.lit(" "))
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(padded)))
    grams = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length(padded) - k + 1), lambda i: F.substring(padded, i, k))))
    of = counts.select("lang", "n", F.explode(grams).alias("item")).where("item != ' '")
    gram_counts = written(of.groupBy("lang", "item").agg(F.sum("n").alias("n")), "grams")

    def table(found: DataFrame, kind: Column) -> tuple[pa.Table, list[str]]:
        totals = found.groupBy("lang", kind.alias("kind")).agg(F.sum("n").alias("total"))  # a row a language and length
        kept = found.withColumn("kind", kind).join(F.broadcast(totals), ["lang", "kind"]).where(F.col("n") >= cutoff * F.col("total"))
        return kept.select("item", "lang", F.log10(F.col("n") / F.col("total")).cast("float").alias("score")).orderBy("item", "lang").toArrow(), sorted(r[0] for r in totals.select("lang").distinct().collect())

    word_rows, languages = table(counts, F.lit(0))
    gram_rows, _ = table(gram_counts, F.length("item"))
    release(counts, gram_counts)
    return Model(languages, Table(word_rows, languages), Table(gram_rows, languages))


class Scorer:
    """Scores words with a model; what it has worked out it keeps, up to CACHE numbers."""

    def __init__(self, model: Model) -> None:
        self.model, self.n = model, len(model.languages)
        self.words, self.grams = model.words.index(), model.grams.index()
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, self.n), np.float32)

    def unknown(self, word: str) -> np.ndarray:
        padded = f" {word} "
        grams, at = self.grams, []
        for k in range(min(LONGEST, len(padded)), 0, -1):
            at = [i for j in range(len(padded) - k + 1) if (i := grams.get(padded[j : j + k])) is not None]
            if at:
                return self.model.grams.rows(np.array(at), self.n).mean(0)
        return np.full(self.n, PENALTY, np.float32)

    def learn(self, fresh: list[str]) -> None:
        first = len(self.index)
        self.index.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        if first + len(fresh) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(len(fresh), len(self.scores)), self.n), np.float32)])
        out = self.scores[first : first + len(fresh)]
        at = np.fromiter((self.words.get(w, -1) for w in fresh), np.int64, len(fresh))
        known = np.flatnonzero(at >= 0)
        out[known] = self.model.words.rows(at[known], self.n)
        for i in np.flatnonzero(at < 0).tolist():
            out[i] = self.unknown(fresh[i])

    def means(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(mean score of each text and language, number of words of each text)."""
        if len(self.index) * max(1, self.n) > CACHE:
            self._forget()
        split = [_WORD.findall(t.lower()) if t else [] for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            self.learn(list(dict.fromkeys(words[i] for i in new)))
            at[new] = [self.index[words[i]] for i in new]
        out = np.zeros((len(texts), len(self.model.languages)))
        full = np.flatnonzero(n)
        if len(full):
            starts = (np.cumsum(n) - n)[full]
            out[full] = np.add.reduceat(self.scores[at].astype(np.float64), starts, axis=0) / n[full, None]
        return out, n


_scorers: dict[str, Scorer] = {}


def _scorer(key: str, sent: Broadcast) -> Scorer:
    """The worker's scorer for a model, kept from task to task."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(sent.value)
    return _scorers[key]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score): one row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _scorer(key, sent)
        names = np.array([*use.model.languages, "und"], object)
        for b in batches:
            for at, offsets, _ in W.blocks(b.column(1), TEXT_BYTES, TEXTS):
                part = b.slice(at, len(offsets) - 1)
                mean, n = use.means(part.column(1).to_pylist())
                known = (n > 0) & bool(use.model.languages)
                if mean.shape[1]:
                    best = mean.argmax(1)
                    share = np.exp((mean - mean.max(1, keepdims=True)) * np.log(10) * np.minimum(n, SHARP)[:, None])
                    score = 1 / share.sum(1)
                else:
                    best, score = np.zeros(len(n), np.int64), np.zeros(len(n))
                lang = names[np.where(known, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.tolist(), pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)
