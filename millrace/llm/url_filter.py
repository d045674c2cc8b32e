"""URL filtering as a sort-merge range join.

A host's labels in reverse order, each followed by a dot, are its canonical key. All subdomains of
a rule's host have keys that start with the rule's key, so the rule covers one interval of the key
order, and two such intervals are nested or disjoint. URLs and rule starts are sorted together by
key. Every rule start carries the stack of rules that are open there; the sweep (a running window)
hands each URL the stack of the last start before it, and rules whose interval has ended by then
are popped. The rules that remain are those of the URL's host; the path decides among them.

URLs are dealt over all partitions by the position of the row alone, so one host (or one row, repeated) with
any share of the URLs is spread evenly, and the rules are copied to every partition. Of more than COPIES
copies in all, URLs are dealt over groups of partitions by their last two labels, and within the group by
position; rules of two labels or more are then copied to their group only (of MIN_SALTS partitions at least).

Defined results: a null URL, or one without "://", has empty host and path, no rule and the default
verdict. Rules with a null host, path or action are ignored; of two that fit, the longer one
(host + path) wins, then the longer host, then block before allow. Repeated rules count once,
repeated URLs each get a row. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of rules that are made at most, but for groups of MIN_SALTS partitions.
COPIES, MIN_SALTS = 10_000_000, 32


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def _domain(key: Column) -> Column:
    return F.substring_index(key, ".", 2)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, labels, stack): for each rule host the rules open at its key, its own included."""
    rules = (
        rules.select(ascii_lower(F.col("host").cast("string")).alias("host"), F.col("path").cast("string").alias("path"), F.col("action").cast("string").alias("action"))
        .dropna()
        .distinct()
        .withColumn("key", host_key("host"))
    )
    nodes = rules.groupBy("key").agg(F.collect_list(F.struct(F.col("key").alias("node"), "path", F.concat("host", "path").alias("rule"), "action")).alias("own"))
    labels = F.size(F.split("key", r"\.")) - 1
    above = nodes.select("key", F.explode(F.transform(F.sequence(F.lit(1), labels), lambda n: F.concat(F.call_function("substring_index", F.col("key"), F.lit("."), n), F.lit(".")))).alias("node"))
    stacks = above.join(nodes.select(F.col("key").alias("node"), "own"), "node").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))
    return stacks.select("key", labels.alias("labels"), "stack")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict): one row for each row of pages. rules: (host, path, action)."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stacks = rule_stacks(rules)
    salts = parts if parts <= MIN_SALTS else min(parts, max(MIN_SALTS, COPIES // max(1, stacks.count())))
    groups = -(-parts // salts)
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    group = F.pmod(F.xxhash64(_domain(F.col("key"))), F.lit(groups)) * salts
    points = urls.withColumn("key", host_key("host")).select(
        (group + F.pmod(F.monotonically_increasing_id(), F.lit(salts))).alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path",
    )
    every = F.sequence(F.lit(0).cast("long"), F.lit(groups * salts - 1).cast("long"))
    places = F.when(F.col("labels") == 1, every).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")), lambda s: group + s))
    starts = stacks.select(F.explode(places).alias("part"), "key", F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = points.unionByName(starts, allowMissingColumns=True).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("open", lambda r: F.startswith("key", r["node"]) & F.startswith("path", r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), F.length(r["node"]).alias("h"), r["action"].alias("action"), r["rule"].alias("rule"))))
    return swept.withColumn("best", best).select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
