"""Named queries over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import strings as S
from millrace.operators import dedup, incremental, lines, search, secrets
from millrace.plans import round_trips
from millrace.session import scratch, table
from millrace.streaming import dedup as stream_dedup

SALT = "millrace"
NEEDLE = "the"
#: Two days on which the findings of two runs are taken, for the merge.
DAY_1, DAY_2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_of(documents(spark, sf_dir).select("doc_id", "text"))


def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).groupBy("line").agg(F.count("*").alias("n"))


def lines_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_by(doc_lines(spark, sf_dir), S.within_bound(F.col("line")))[0]


def lines_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = lines.split_by(doc_lines(spark, sf_dir), S.within_bound(F.col("line")))[1]
    return lines.reject_records(rejected, F.col("doc_id"), F.col("pos"), F.col("line"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.metrics(doc_lines(spark, sf_dir), S.within_bound(F.col("line")))


def dedup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_of_content(documents(spark, sf_dir).select("doc_id", "text", "source"), "text", ["doc_id"])


def dedup_pages_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", S.url_without_query(F.col("url")).alias("url"))
    return dedup.first_of_key(pages, ["url"], ["page_id"])


def distinct_over_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir)
    return dedup.union_distinct(rows.where("doc_id % 2 = 0").select("line"), rows.where("doc_id % 2 = 1").select("line"))


def once_per_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.once_per_content(documents(spark, sf_dir), "text", ["doc_id"]).select("digest", "doc_id", "n_rows")


def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.part_numbers(documents(spark, sf_dir).select("doc_id", "source"), ["doc_id"], 300)


def _batch_and_library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = doc_lines(spark, sf_dir)
    return rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0")


def incremental_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, library = _batch_and_library(spark, sf_dir)
    return incremental.unseen(batch, library, ["line"], ["doc_id", "pos"])


def incremental_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, library = _batch_and_library(spark, sf_dir)
    return incremental.seen(batch, library, ["line"]).select("doc_id", "pos", "line")


def incremental_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, library = _batch_and_library(spark, sf_dir)
    return incremental.run_stats(batch, library, ["line"])


def library_without_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = doc_lines(spark, sf_dir).select(F.concat(F.lit("r"), F.col("doc_id") % 3).alias("run_id"), "line")
    return incremental.other_runs(runs, "r1").groupBy("run_id").agg(F.countDistinct("line").alias("n_keys"))


def search_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(documents(spark, sf_dir), NEEDLE, "text").select("doc_id")


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.occurrences(doc_lines(spark, sf_dir), "ea", "line").select("doc_id", "pos", "offset")


def search_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.occurrences(doc_lines(spark, sf_dir), "haha", "line").select("doc_id", "pos", "offset")


def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(doc_lines(spark, sf_dir), "*")


def search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.occurrences(doc_lines(spark, sf_dir), NEEDLE, "line").select("doc_id", "pos", "offset")
    return search.capped(hits, ["doc_id"], ["pos", "offset"], 5)


def search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.occurrences(doc_lines(spark, sf_dir), NEEDLE, "line").select("doc_id", "pos", "offset")
    return search.limited(hits, ["doc_id", "pos", "offset"], 100)


def strip_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.strip_schemes(F.col("url")).alias("url"))


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(S.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.url_host(url).alias("host"), S.url_path(url).alias("path"), S.url_query(url).alias("query"))


def url_no_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.url_without_query(F.col("url")).alias("url"))


def collapse_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", S.collapse_controls(F.col("text")).alias("text"))


def cap_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", S.cap_bytes(F.col("text"), 1000).alias("text"))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", S.content_digest(F.col("text")).alias("digest"))


def filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(S.like_filter(F.col("source"), "C1")).select("doc_id", "source")


def filter_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.rlike("source", F.lit(S.glob_to_regex("src[1-3]?")))).select("doc_id", "source")


def _matches(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return secrets.scan(documents(spark, sf_dir).where(where).select("doc_id", "source", "text"), secrets.select_rules(), SALT)


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("doc_id", "rule_id", "severity", "fingerprint", "preview")


def secret_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.sha2(secrets.redacted(F.col("text"), secrets.select_rules()), 256).alias("digest"))


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The findings of a first run over the even documents, and the matches of a second run over all."""
    return secrets.findings(_matches(spark, sf_dir, "doc_id % 2 = 0"), F.lit(DAY_1).cast("timestamp")), _matches(spark, sf_dir)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, matches = _two_runs(spark, sf_dir)
    return secrets.merge(first, secrets.findings(matches, F.lit(DAY_2).cast("timestamp")))


def findings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


def findings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.merge_stats(*_two_runs(spark, sf_dir))


def findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.query(_merged(spark, sf_dir), "TOKEN", F.lit(DAY_2).cast("timestamp"), 20)
    return found.select("rule_id", "fingerprint", "seen_count")


def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


def stream_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_dedup.stream(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    folder, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-state")
    stream_dedup.run_once(stream_dedup.first_seen(events, ["event_id"]), folder, checkpoint)
    return spark.read.parquet(folder).select("event_id", "user_id", "event_type")


_LINES = r"""l AS (
  SELECT doc_id, pos, line FROM (
    SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, regexp_replace(unnest(string_split(text, chr(10))), '[\r\n]+$', '') AS line FROM documents)
  WHERE line != '')"""
_RULES = "(VALUES " + ", ".join(f"('{r.rule_id}', '{r.name}', '{r.pattern}', '{r.severity}')" for r in secrets.RULES) + ") AS r(rule_id, rule_name, pattern, severity)"


def _matches_sql(where: str = "true") -> str:
    return f"""(SELECT doc_id, source, rule_id, rule_name, severity, sha256('{SALT}' || v) AS fingerprint, left(v, CAST(least(4, floor(length(v) / 4)) AS BIGINT)) || '****' AS preview
  FROM (SELECT doc_id, source, rule_id, rule_name, severity, translate(unnest(regexp_extract_all(text, pattern, 1)), chr(13) || chr(10) || chr(9), '   ') AS v FROM documents, {_RULES} WHERE {where}) WHERE v != '')"""


def _findings_sql(where: str, day: str) -> str:
    return f"""(SELECT rule_id, fingerprint, min(rule_name) AS rule_name, min(severity) AS severity, min(preview) AS preview, arg_min(source, doc_id) AS source, '{day}' AS day
  FROM {_matches_sql(where)} GROUP BY rule_id, fingerprint)"""


_MERGED = f"""m AS (
  SELECT coalesce(o.rule_id, n.rule_id) AS rule_id, coalesce(o.rule_name, n.rule_name) AS rule_name, coalesce(o.fingerprint, n.fingerprint) AS fingerprint,
    coalesce(o.preview, n.preview) AS preview, coalesce(o.severity, n.severity) AS severity, coalesce(o.source, n.source) AS source,
    coalesce(o.day, n.day) AS first_seen, coalesce(n.day, o.day) AS last_seen, CAST((o.rule_id IS NOT NULL)::INT + (n.rule_id IS NOT NULL)::INT AS BIGINT) AS seen_count
  FROM {_findings_sql("doc_id % 2 = 0", DAY_1)} o FULL JOIN {_findings_sql("true", DAY_2)} n ON o.rule_id = n.rule_id AND o.fingerprint = n.fingerprint)"""


def _redact_sql() -> str:
    out = "text"
    for r in secrets.RULES:
        out = f"regexp_replace({out}, '{r.pattern}', '[REDACTED:{r.rule_id}]', 'g')"
    return out


def _hits_sql(needle: str) -> str:
    n = len(needle)
    return f"""(SELECT doc_id, pos, CAST(strlen(substr(line, 1, i - 1)) AS INT) AS "offset" FROM (
  SELECT doc_id, pos, line, unnest(list_filter(range(1, length(line) - {n - 2}), lambda i: substr(line, i, {n}) = '{needle}')) AS i FROM l WHERE contains(line, '{needle}')))"""


#: Name: query, SQL.
_PAIRS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "dedup_lines": (dedup_lines, f"WITH {_LINES} SELECT line, count(*) AS n FROM l GROUP BY line"),
    "lines_clean": (lines_clean, f"WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, line FROM l WHERE strlen(line) <= 4096"),
    "lines_rejected": (lines_rejected, rf"""WITH {_LINES}, e AS (
  SELECT concat_ws(chr(9), doc_id, pos, replace(replace(replace(line, '\', '\\'), chr(9), '\t'), chr(13), '\r')) AS w FROM l WHERE strlen(line) > 4096)
SELECT CASE WHEN strlen(w) <= 8192 THEN w ELSE (SELECT max_by(substr(w, 1, k), k) FROM (SELECT unnest(range(2000, 8185)) AS k) WHERE strlen(substr(w, 1, k)) <= 8184) || '...[cut]' END AS record FROM e"""),
    "run_metrics": (run_metrics, f"""WITH {_LINES} SELECT count(*) AS n_read, count(*) FILTER (strlen(line) <= 4096) AS n_accepted, count(*) FILTER (strlen(line) > 4096) AS n_rejected,
  count(DISTINCT line) FILTER (strlen(line) <= 4096) AS n_unique, count(*) FILTER (strlen(line) <= 4096) - count(DISTINCT line) FILTER (strlen(line) <= 4096) AS n_duplicates,
  CAST(coalesce(sum(strlen(line)), 0) AS BIGINT) AS n_bytes FROM l"""),
    "dedup_docs": (dedup_docs, "SELECT min(doc_id) AS doc_id, text, arg_min(source, doc_id) AS source FROM documents GROUP BY text"),
    "dedup_pages_by_url": (dedup_pages_by_url, "SELECT min(page_id) AS page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages GROUP BY 2"),
    "distinct_over_runs": (distinct_over_runs, f"WITH {_LINES} SELECT line FROM l WHERE doc_id % 2 = 0 UNION SELECT line FROM l WHERE doc_id % 2 = 1"),
    "once_per_content": (once_per_content, "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY text"),
    "part_numbers": (part_numbers, "SELECT doc_id, source, (row_number() OVER (ORDER BY doc_id) - 1) // 300 + 1 AS part FROM documents"),
    "incremental_new": (incremental_new, f"""WITH {_LINES} SELECT arg_min(doc_id, (doc_id, pos)) AS doc_id, CAST(arg_min(pos, (doc_id, pos)) AS INT) AS pos, line FROM l
WHERE doc_id % 2 = 1 AND line NOT IN (SELECT line FROM l WHERE doc_id % 2 = 0) GROUP BY line"""),
    "incremental_skipped": (incremental_skipped, f"WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, line FROM l WHERE doc_id % 2 = 1 AND line IN (SELECT line FROM l WHERE doc_id % 2 = 0)"),
    "incremental_stats": (incremental_stats, f"""WITH {_LINES}, k AS (SELECT line, count(*) AS n, line IN (SELECT line FROM l WHERE doc_id % 2 = 0) AS known FROM l WHERE doc_id % 2 = 1 GROUP BY line)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_accepted, count(*) FILTER (NOT known) AS n_new, CAST(coalesce(sum(n) FILTER (known), 0) AS BIGINT) AS n_skipped,
  count(*) FILTER (known) AS n_common_keys, CAST(coalesce(sum(n - 1) FILTER (NOT known), 0) AS BIGINT) AS n_duplicates FROM k"""),
    "library_without_run": (library_without_run, f"WITH {_LINES} SELECT 'r' || (doc_id % 3) AS run_id, count(DISTINCT line) AS n_keys FROM l WHERE doc_id % 3 != 1 GROUP BY 1"),
    "search_contains": (search_contains, f"SELECT doc_id FROM documents WHERE contains(text, '{NEEDLE}')"),
    "search_hits": (search_hits, f'WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, "offset" FROM {_hits_sql("ea")}'),
    "search_overlapping": (search_overlapping, f'WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, "offset" FROM {_hits_sql("haha")}'),
    "search_all": (search_all, f"WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, line FROM l"),
    "search_capped": (search_capped, f"""WITH {_LINES}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, "offset") AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {_hits_sql(NEEDLE)})
SELECT doc_id, CAST(pos AS INT) AS pos, "offset", n > 5 AS capped FROM h WHERE k <= 5"""),
    "search_limit": (search_limit, f'WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, "offset" FROM {_hits_sql(NEEDLE)} ORDER BY ALL LIMIT 100'),
    "strip_scheme": (strip_scheme, "SELECT page_id, regexp_replace(url, '(https|http|ftps|sftp|ftp|wss|ws)://', '', 'gi') AS url FROM pages"),
    "url_host": (url_host, "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1"),
    "url_parts": (url_parts, r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages"""),
    "url_no_query": (url_no_query, "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages"),
    "collapse_controls": (collapse_controls, "SELECT doc_id, translate(text, chr(13) || chr(10) || chr(9), '   ') AS text FROM documents"),
    "cap_bytes": (cap_bytes, """SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE (SELECT max_by(substr(text, 1, k), k) FROM (SELECT unnest(range(250, 1001)) AS k) WHERE strlen(substr(text, 1, k)) <= 1000) END AS text FROM documents"""),
    "content_digest": (content_digest, "SELECT doc_id, sha256(text) AS digest FROM documents"),
    "filter_like": (filter_like, "SELECT doc_id, source FROM documents WHERE lower(source) LIKE '%c1%'"),
    "filter_glob": (filter_glob, "SELECT doc_id, source FROM documents WHERE source GLOB 'src[1-3]?'"),
    "secret_findings": (secret_findings, f"SELECT doc_id, rule_id, severity, fingerprint, preview FROM {_matches_sql()}"),
    "secret_redacted": (secret_redacted, f"SELECT doc_id, sha256({_redact_sql()}) AS digest FROM documents"),
    "findings_merge": (findings_merge, f"WITH {_MERGED} SELECT * FROM m"),
    "findings_stats": (findings_stats, f"""WITH o AS {_findings_sql("doc_id % 2 = 0", DAY_1)}, k AS (SELECT rule_id, fingerprint, count(*) AS n FROM {_matches_sql()} GROUP BY ALL)
SELECT count(*) FILTER (o.rule_id IS NULL) AS n_new, count(*) FILTER (o.rule_id IS NOT NULL) AS n_existing, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicate
FROM k LEFT JOIN o ON o.rule_id = k.rule_id AND o.fingerprint = k.fingerprint"""),
    "findings_query": (findings_query, f"""WITH {_MERGED} SELECT rule_id, fingerprint, seen_count FROM m
WHERE (lower(rule_id) LIKE '%token%' OR lower(rule_name) LIKE '%token%') AND last_seen >= '{DAY_2}' ORDER BY last_seen DESC, rule_id, fingerprint LIMIT 20"""),
    "newest_first": (newest_first, "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "stream_dedup": (stream_dedup_events, "SELECT DISTINCT event_id, user_id, event_type FROM events"),
}

_PAIRS |= round_trips.PAIRS
_PAIRS["secret_once"] = (round_trips.secret_once, _PAIRS["secret_findings"][1])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for name, (q, _) in _PAIRS.items()}
SQL: dict[str, str] = {name: s for name, (_, s) in _PAIRS.items() if s}
