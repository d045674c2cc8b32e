"""Detection and redaction of secrets. A raw value never leaves the expression that finds it: findings hold a
salted fingerprint and a masked preview."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import strings as S
from millrace.operators.dedup import once_per_content

VALUE_BYTES = 4096


@dataclass(frozen=True)
class Rule:
    """pattern's first group is the value; it keeps to what Java and RE2 both read."""

    rule_id: str
    name: str
    pattern: str
    severity: str | None = None


#: Published shapes of tokens.
RULES = (
    Rule("aws-access-key-id", "AWS access key id", r"\b(AKIA[A-Z0-9]{16})\b", "high"),
    Rule("generic-assigned-token", "Token assigned in text", r"\b(?:token|secret|api_key|apikey)\b ?[=:] ?\"([A-Za-z0-9_-]{16,})\"", "medium"),
    Rule("github-token", "GitHub token", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b", "high"),
    Rule("google-api-key", "Google API key", r"\b(AIza[A-Za-z0-9_-]{35})", "high"),
    Rule("private-key-header", "Private key", r"(-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----)", "critical"),
    Rule("slack-token", "Slack token", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})", "high"),
)


def select_rules(allow: list[str] | None = None, deny: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules whose id matches some glob of allow (all, if none is given) and none of deny. A bad glob, or no rule left, is an error."""
    import re

    yes, no = ([re.compile(S.glob_to_regex(p)) for p in ps or ()] for ps in (allow, deny))
    left = [r for r in rules if (not yes or any(p.match(r.rule_id) for p in yes)) and not any(p.match(r.rule_id) for p in no)]
    if not left:
        raise ValueError("no rule is left")
    return left


def normalised(value: Column) -> Column:
    return S.cap_bytes(S.collapse_controls(value), VALUE_BYTES)


def fingerprint(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), value), 256)


def preview(value: Column) -> Column:
    """The first four characters, at most a quarter of the value, and four stars."""
    return F.concat(F.substr(value, F.lit(1), F.least(F.lit(4), F.floor(F.length(value) / 4).cast("int"))), F.lit("****"))


def _any(rules: list[Rule]) -> str:
    """One pattern that holds wherever some rule's does: most texts are looked at once and no more."""
    return "|".join(f"(?:{r.pattern})" for r in rules)


def scan(docs: DataFrame, rules: list[Rule], salt: str, id_col: str = "doc_id", text_col: str = "text", source: str = "source") -> DataFrame:
    """(id_col, source, rule_id, rule_name, severity, fingerprint, preview): a row for each match. Texts are scanned
    where they are read: moving them to spare equal ones a cheap pattern would cost more than it saves."""
    per_rule = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).cast("string").alias("severity"), F.regexp_extract_all(text_col, F.lit(r.pattern), F.lit(1)).alias("values")) for r in rules))
    some = docs.where(F.rlike(text_col, F.lit(_any(rules))))
    found = some.select(id_col, source, F.inline(F.filter(per_rule, lambda r: F.size(r["values"]) > 0))).select(id_col, source, "rule_id", "rule_name", "severity", F.explode("values").alias("value"))
    found = found.withColumn("value", normalised(F.col("value"))).where("value != ''")
    return found.select(id_col, source, "rule_id", "rule_name", "severity", fingerprint(F.col("value"), salt).alias("fingerprint"), preview(F.col("value")).alias("preview"))


def scan_once(docs: DataFrame, rules: list[Rule], salt: str, id_col: str = "doc_id", text_col: str = "text", source: str = "source") -> DataFrame:
    """As scan(), but equal texts are scanned once, by their digests, and the matches given to every document that has
    the text: for rules that cost more than moving a digest and an id. scan_stats() counts what is spared. Ids are unique."""
    keyed = docs.select(id_col, source, F.sha2(text_col, 256).alias("digest"))
    first = once_per_content(docs.where(F.col(text_col).isNotNull()), text_col, [id_col]).select(F.col(id_col).alias("_first"))
    one = docs.join(first, F.col(id_col) == F.col("_first"), "left_semi").select(F.sha2(text_col, 256).alias("digest"), text_col, source)
    found = scan(one, rules, salt, "digest", text_col, source).drop(source)
    return keyed.join(found, "digest").select(id_col, source, "rule_id", "rule_name", "severity", "fingerprint", "preview")


def findings(matches: DataFrame, now: Column, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each (rule_id, fingerprint) of this run; its source is that of the least id."""
    one = matches.groupBy("rule_id", "fingerprint").agg(
        F.min("rule_name").alias("rule_name"), F.min("severity").alias("severity"), F.min("preview").alias("preview"), F.min(F.struct(id_col, source)).alias("first")
    )
    return one.select("rule_id", "rule_name", "fingerprint", "preview", "severity", F.col(f"first.{source}").alias("source"), now.alias("first_seen"), now.alias("last_seen"), F.lit(1).cast("long").alias("seen_count"))


def merge(old: DataFrame, run: DataFrame) -> DataFrame:
    """The next version of the findings table: known findings are seen once more (first source kept), new ones added."""
    o, r = old.alias("o"), run.alias("r")
    both = o.join(r, (F.col("o.rule_id") == F.col("r.rule_id")) & (F.col("o.fingerprint") == F.col("r.fingerprint")), "full_outer")
    had, got = F.col("o.rule_id").isNotNull(), F.col("r.rule_id").isNotNull()
    keep = [F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in ("rule_id", "rule_name", "fingerprint", "preview", "severity", "source", "first_seen")]
    last = F.when(got, F.greatest("r.last_seen", "o.last_seen")).otherwise(F.col("o.last_seen")).alias("last_seen")
    count = (F.coalesce("o.seen_count", F.lit(0)) + got.cast("long")).alias("seen_count")
    return both.select(*keep, last, count)


def merge_stats(old: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: new and known findings of the run, and matches beyond the first of each finding."""
    keys = ["rule_id", "fingerprint"]
    per = matches.groupBy(*keys).agg(F.count("*").alias("n")).join(old.select(*keys, F.lit(True).alias("known")), keys, "left")
    known = F.coalesce("known", F.lit(False))
    return per.agg(F.count_if(~known).alias("n_new"), F.count_if(known).alias("n_existing"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"))


def scan_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: texts that scan_once() scans, and scans it skips because an equal text is scanned already."""
    n = F.countDistinct(F.sha2(text_col, 256))
    return docs.agg(n.alias("n_scanned"), (F.count(text_col) - n).alias("n_skipped_scans"))


def query(found: DataFrame, kind: str | None = None, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Findings whose rule id or name holds `kind`, last seen at `since` or later; newest first, then by rule and fingerprint."""
    out = found.where(S.like_filter(F.col("rule_id"), kind) | S.like_filter(F.col("rule_name"), kind))
    if since is not None:
        out = out.where(F.col("last_seen") >= since)
    out = out.orderBy(F.desc("last_seen"), "rule_id", "fingerprint")
    return out.limit(limit) if limit is not None else out


def redacted(text: Column, rules: list[Rule]) -> Column:
    """text with each match of a rule replaced by [REDACTED:rule id]."""
    replaced = reduce(lambda c, r: F.regexp_replace(c, r.pattern, f"[REDACTED:{r.rule_id}]"), rules, text)
    return F.when(F.rlike(text, F.lit(_any(rules))), replaced).otherwise(text)
