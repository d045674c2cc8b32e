"""Quality rules with a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials over the buckets are
counted: the raw one over all documents (with add-one smoothing), the target's over the trusted ones
(with the raw one as prior). A document's score is the mean, over its words and pairs, of log(p_target / p_raw); it is kept if the score
is THRESHOLD or more and the base rules hold. Both are counted over whole tables: the n-grams of every
document are exploded, summed partially before the shuffle, and only BUCKETS numbers are left, which
the scoring pass gets as one array (a scalar subquery).

The base counts come from the words of the row itself, without a shuffle: n_dup_lines are lines with a
word that equal an earlier line; n_repeat_words are words within 8-word windows that occur twice or
more in the text (windows are compared by a 64-bit hash within the text).

Defined results: a null text, or one without words, has only zeros, base_failed and not kept. Repeated
rows each get a row and count each. Trusted ids that are null or repeated count once or not at all.
Without trusted documents every ratio is that of the smoothing alone. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Weight of the raw multinomial in the target's, in n-grams for each bucket: few trusted documents say little.
PRIOR = 4
THRESHOLD = -0.13
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PER_100 = 30
#: Trusted ids that are broadcast to the documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SPACES = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def joined(a: Column, step: int) -> Column:
    """Hashes of the elements of a with those step further on."""
    n = F.size(a) - step
    return F.when(n > 0, F.zip_with(F.slice(a, 1, n), F.slice(a, step + 1, n), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def _hashed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (not null), words, h (their hashes) and h2 (those of neighbours)."""
    found = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words(F.col("text")))
    return found.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("h2", joined(F.col("h"), 1))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with `weights`: log(p_target / p_raw) of each bucket."""
    ids = trusted.select(F.col("doc_id").alias("good")).dropna().distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    marked = docs.join(ids, F.col("doc_id") == F.col("good"), "left")
    grams = _hashed(marked, "good").select(F.col("good").isNotNull().alias("target"), F.explode(F.concat("h", "h2")).alias("gram"))
    grams = grams.select("target", bucket(F.col("gram")).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("target").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    cells = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "target", "raw"))).alias("c"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    raw = lambda c: (c["raw"] + 1) / (F.col("raws") + BUCKETS)
    ratio = lambda c: F.log((c["target"] / raw(c) + PRIOR * BUCKETS) / (F.col("targets") + PRIOR * BUCKETS))
    return cells.select(F.transform("c", ratio).alias("weights"))


def _repeated(h8: Column) -> Column:
    """Words that lie in a window that occurs twice or more, from the windows' hashes."""
    placed = F.transform(h8, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    twice = F.transform(
        F.array(F.sort_array(placed)),
        lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"])), lambda x: x["i"])),
    )
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = lambda places: F.aggregate(places, start, lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n")))["n"]
    return F.transform(twice, covered)[0]


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, *more, h, h2, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.col("text")
    rows = _hashed(docs, *more).withColumn("h4", joined(F.col("h2"), 2))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    # a repeated window of 8 words repeats 5 runs of 4
    may = F.size("h4") - F.size(F.array_distinct("h4")) >= WINDOW - 3
    rows = rows.withColumn("lines", lines).withColumn("h8", F.when(may, joined(F.col("h4"), 4)))
    again = F.col("h8").isNotNull() & (F.size("h8") > F.size(F.array_distinct("h8")))
    rows = rows.select(
        "doc_id", *more, "h", "h2", F.size("h").cast("long").alias("n_words"), F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(again, _repeated(F.col("h8"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PER_100 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, whole: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of each row of docs.

    trusted: the doc_ids of the target's documents. whole: with a column `row` that holds the row judged.
    """
    row, more = (F.struct(*(docs[c] for c in docs.columns)).alias("row"),) if whole else (), ("row",) if whole else ()
    docs = docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = log_ratios(docs.select("doc_id", "text"), trusted)
    rows = measured(docs, *more).withColumn("weights", weights.scalar())
    total = F.aggregate(F.concat("h", "h2"), F.lit(0.0), lambda acc, g: acc + F.get("weights", bucket(g)))
    score = F.when(F.col("n_words") > 0, F.round(total / (2 * F.col("n_words") - 1), 9))
    rows = rows.withColumn("score", score)
    return rows.select(
        *more, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
    )


def without_rejected(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    # pushed below the projections, the filter would work out every expression under `kept` anew at each mention;
    # it stays above a column that is not deterministic
    judged = judge(docs, trusted, threshold, whole=True).withColumn("at", F.monotonically_increasing_id())
    return judged.where("kept AND at >= 0").select("row.*")
