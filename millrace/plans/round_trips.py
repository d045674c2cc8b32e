"""Queries that write a table to the shared folder, go through a source, sink, library or run, and return what comes
back; with the SQL that gives the same rows from the table alone."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import config
from millrace.functions import strings as S
from millrace.operators import file_search, lines, search, secrets
from millrace.operators.library import Library
from millrace.run import run
from millrace.session import remove, scratch, table
from millrace.sources import sinks, text

NEEDLE = "ea"
FIRST, SECOND = "20240101-AAAAAA", "20240102-AAAAAA"
#: Decoded bytes of the frames that are written; lines cross them.
FRAME_BYTES = 50_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line) of every document, without carriage returns, at which Spark's reader would end a line."""
    rows = lines.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.translate("line", "\r", " ").alias("line"))


def _text(rows: DataFrame, what: str = "text") -> str:
    folder = scratch(rows.sparkSession, what)
    sinks.write(rows.select("line"), folder, "text")
    return folder


def _wide(found: Iterator[str], part: int) -> Iterator[bytes]:
    order = "le" if part % 2 else "be"
    yield b"\xff\xfe" if part % 2 else b"\xfe\xff"
    for line in found:
        yield (line + "\n").encode(f"utf-16-{order}")


def _frames(found: Iterator[str], part: int) -> Iterator[bytes]:
    import zstandard

    held = b""
    for line in found:
        held += line.encode() + b"\n"
        while len(held) > FRAME_BYTES:
            yield zstandard.ZstdCompressor().compress(held[:FRAME_BYTES])
            held = held[FRAME_BYTES:]
    yield zstandard.ZstdCompressor().compress(held)


def _zstd(rows: DataFrame) -> str:
    folder = scratch(rows.sparkSession, "zstd")
    sinks.write_encoded(rows, folder, ".zst", _frames)
    return folder


def _row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).cast("long" if isinstance(v, int) and not isinstance(v, bool) else "boolean" if isinstance(v, bool) else "string").alias(k) for k, v in values.items()))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("line").agg(F.count("*").alias("n"))


def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return _counted(text.read_lines(spark, [_text(rows.where("doc_id % 2 = 0")), _text(rows.where("doc_id % 2 = 1"))]))


def source_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folder = _lines(spark, sf_dir), scratch(spark, "wide")
    even = rows.where("doc_id % 2 = 0")
    if even.rdd.getNumPartitions() < 4:  # files of both byte orders; a larger table has as many as partitions, and moves no line
        even = even.repartition(4)
    sinks.write_encoded(even, folder, ".txt", _wide)
    return _counted(text.read_sniffed(spark, [folder, _text(rows.where("doc_id % 2 = 1"))]))


def source_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folder = _lines(spark, sf_dir), scratch(spark, "wide")
    sinks.write_encoded(rows.repartition(4), folder, ".txt", _wide)
    return text.sniffed(spark, [folder, _text(rows)]).select("encoding").distinct()


def source_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(text.read_zstd_lines(spark, [_zstd(_lines(spark, sf_dir))]))


def source_zstd_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index is made, found again, and lines are read by it."""
    folder, at = _zstd(_lines(spark, sf_dir)), scratch(spark, "index")
    text.saved_frame_index(spark, [folder], at)
    return _counted(text.read_zstd_lines(spark, [folder], index=text.saved_frame_index(spark, [folder], at)))


def source_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = text.frame_index(spark, [_zstd(_lines(spark, sf_dir))])
    return index.agg(F.sum("size").alias("n_bytes"), F.count("error").alias("n_errors"))


def source_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = datetime.now(UTC) - text.parse_age("1d6h")
    return text.files(spark, [_text(_lines(spark, sf_dir))], since=since).agg(F.sum("length").alias("n_bytes"))


def source_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    within, beyond = text.bounded(text.read_lines(spark, [_text(_lines(spark, sf_dir))]), 200)
    count = lambda rows, name: rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).alias("n_bytes")).select(F.lit(name).alias("part"), "n", "n_bytes")
    return count(within, "within").unionByName(count(beyond, "beyond"))


def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    hits, _ = file_search.search_files(spark, [_text(rows.where("doc_id % 2 = 0")), _zstd(rows.where("doc_id % 2 = 1"))], NEEDLE)
    return hits.groupBy("line", "offset").agg(F.count("*").alias("n"))


def search_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be read on are listed, and all others searched."""
    folder = _zstd(_lines(spark, sf_dir))
    sinks.write_encoded(spark.range(1, numPartitions=1).select(F.lit("no frame").alias("line")), f"{folder}/broken", ".zst", lambda found, part: (x.encode() for x in found))
    hits, errors = file_search.search_files(spark, [folder], NEEDLE)
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(hits, "hits").unionByName(count(errors, "errors"))


def search_first_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search.occurrences(rows, NEEDLE, "line", matched=60).select("doc_id", "pos", "offset", "cut")


def _library(spark: SparkSession, sf_dir: str, version: int = 1) -> Library:
    """A library of two runs: the even documents, then all."""
    lib, rows = Library(spark, scratch(spark, "library"), ["line"], version), _lines(spark, sf_dir)
    lib.add(rows.where("doc_id % 2 = 0"), ["doc_id"], FIRST)
    lib.add(rows, ["doc_id"], SECOND)
    return lib


def library_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).data().select("doc_id", "line", F.col("run_id").cast("string").alias("run_id"))


def library_dry(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib, rows = Library(spark, scratch(spark, "library"), ["line"]), _lines(spark, sf_dir)
    lib.add(rows.where("doc_id % 2 = 0"), ["doc_id"], FIRST)
    run_id, stats = lib.add(rows, ["doc_id"], dry=True)
    return _row(spark, **stats, n_runs=len(lib.runs()), written=run_id is not None)


def library_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one run are gone, those of the other are of an older version; all are made anew."""
    old = _library(spark, sf_dir)
    remove(spark, f"{old.folder}/keys/run_id={FIRST}")
    lib = Library(spark, old.folder, ["line"], version=2)
    lib.rebuild()
    return lib.key_table().select("line", "run_id", "key_version")


def library_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What classify() says before and after the keys of a run are lost, and of a newer version."""
    lib = _library(spark, sf_dir)
    states = [("made", lib.classify())]
    remove(spark, f"{lib.folder}/keys/run_id={FIRST}")
    states += [("lost", lib.classify()), ("newer", Library(spark, lib.folder, ["line"], version=2).classify())]
    rows = [(when, r, s) for when, found in states for r, s in found.items()]
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("step", "run_id", "state"), r, strict=True))) for r in rows))
    return spark.range(1).select(F.inline(made))


def library_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part that can't be read is left out of the keys and listed."""
    lib = _library(spark, sf_dir)
    remove(spark, f"{lib.folder}/keys/run_id={FIRST}")
    sinks.write_encoded(spark.range(1, numPartitions=1).select(F.lit("no table").alias("line")), f"{lib.folder}/data/run_id={FIRST}", ".parquet", lambda found, part: (x.encode() for x in found))
    lib.rebuild()
    n = len(lib.corrupt)
    return lib.key_table().groupBy("run_id").agg(F.countDistinct("line").alias("n_keys")).withColumn("n_corrupt", F.lit(n).cast("long"))


def library_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark, sf_dir)
    remove(spark, f"{lib.folder}/data/run_id={SECOND}")
    lib.sweep()
    return lib.key_table().select("line", "run_id")


def library_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark, sf_dir)
    low, high = lib.key_range(-(2**63), 0, exclude=FIRST), lib.key_range(0, 2**63 - 1, exclude=FIRST)
    return low.select("line").unionByName(high.select("line"))


def sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark.read.text(_text(_lines(spark, sf_dir))).withColumnRenamed("value", "line"))


def sink_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows come back whole, no file has more than the limit, and without rows nothing is written."""
    rows, folder, none = _lines(spark, sf_dir), scratch(spark, "parts"), scratch(spark, "none")
    sinks.write(rows, folder, per_part=500)
    wrote = sinks.write(rows.where("line IS NULL"), none) or sinks.exists(spark, none)
    back = spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.count_if(F.length("line") > 0).alias("full"))
    return back.agg(F.sum("n").alias("n_rows"), F.sum("full").alias("n_full"), F.count_if(F.col("n") > 500).alias("n_over")).select("*", F.lit(sinks.exists(spark, f"{folder}/_SUCCESS")).alias("whole"), F.lit(wrote).alias("empty_written"))


def run_from_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs by a settings file: even documents as text, then all as zstd, with keys in lower case."""
    rows, lib = _lines(spark, sf_dir), scratch(spark, "library")
    found = {}
    for inputs in (_text(rows.where("doc_id % 2 = 0")), _zstd(rows)):
        with tempfile.NamedTemporaryFile("w", suffix=".toml", delete=False) as f:  # the driver's own
            f.write(f'[millrace]\ninputs = ["{inputs}"]\nlibrary = "{lib}"\nkey = "lower(line)"\nmax_line_bytes = 2000\n')
        found = run(spark, config.load(f.name))
        os.unlink(f.name)
    return _row(spark, **{k: v for k, v in found.items() if k != "run_id"})


def run_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run writes: the first line of each key, and the rejected ones as records."""
    rows, out, bad = _lines(spark, sf_dir), scratch(spark, "out"), scratch(spark, "rejected")
    run(spark, config.load(None, {"inputs": (_text(rows),), "output": out, "rejected": bad, "max_line_bytes": 100, "kind": "text"}))
    count = lambda folder, name: spark.read.text(folder).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(out, "output").unionByName(count(bad, "rejected"))


def key_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).agg(F.countDistinct(S.row_key("line")).alias("n_hashes"), F.countDistinct(F.struct(S.row_key("doc_id", "line"))).alias("n_pairs"))


def _rules() -> list[secrets.Rule]:
    return secrets.select_rules(["*token*", "aws-*"], ["slack-*"])


def secret_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), _rules(), "millrace")
    return found.groupBy("rule_id").agg(F.count("*").alias("n"))


def secret_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_once(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), secrets.select_rules(), "millrace")
    return found.select("doc_id", "rule_id", "severity", "fingerprint", "preview")


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_stats(table(spark, sf_dir, "documents"))


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused before any work is done."""
    docs = table(spark, sf_dir, "documents")
    tries: dict[str, Callable[[], object]] = {
        "empty pattern": lambda: search.matching(docs, "", "text"),
        "pattern of two lines": lambda: search.matching(docs, "a\nb", "text"),
        "output over input": lambda: sinks.check_apart(spark, f"{sf_dir}/documents.parquet/out", [f"{sf_dir}/documents.parquet"]),
        "standard input": lambda: text.files(spark, ["-"]),
        "age of nothing": lambda: text.parse_age("0d"),
        "no rule left": lambda: secrets.select_rules(["nothing-*"]),
        "bad glob": lambda: secrets.select_rules(["[a"]),
        "unknown setting": lambda: config.load(None, {"nonsense": 1}),
    }
    out = []
    for name, attempt in tries.items():
        try:
            attempt()
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    made = F.array(*(F.struct(F.lit(n).alias("what"), F.lit(r).alias("refused")) for n, r in out))
    return spark.range(1).select(F.inline(made))


_L = r"""l AS (
  SELECT doc_id, pos, line FROM (
    SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, regexp_replace(unnest(string_split(text, chr(10))), '[\r\n]+$', '') AS line FROM documents)
  WHERE line != '')"""
_C = f"{_L}, c AS (SELECT doc_id, replace(line, chr(13), ' ') AS line FROM l)"
_COUNTED = f"WITH {_C} SELECT line, count(*) AS n FROM c GROUP BY line"
_N_BYTES = "CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes"


def _hits(of: str, columns: str, line: str = "line") -> str:
    return f"""(SELECT {columns}, CAST(strlen(substr(s, 1, i - 1)) AS INT) AS "offset" FROM (
  SELECT *, unnest(list_filter(range(1, length(s)), lambda i: substr(s, i, {len(NEEDLE)}) = '{NEEDLE}')) AS i FROM (SELECT *, {line} AS s FROM {of}) WHERE contains(s, '{NEEDLE}')))"""


_FIRST_OF = f"""WITH {_C}, f AS (SELECT line, min(doc_id) AS doc_id, min(doc_id) FILTER (doc_id % 2 = 0) AS even FROM c GROUP BY line),
k AS (SELECT coalesce(even, doc_id) AS doc_id, line, CASE WHEN even IS NULL THEN '{SECOND}' ELSE '{FIRST}' END AS run_id FROM f)"""
_RULES = ", ".join(f"('{r.rule_id}', '{r.pattern}')" for r in secrets.RULES if r.rule_id in {"aws-access-key-id", "generic-assigned-token", "github-token"})

#: Name: query, SQL.
PAIRS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "source_text": (source_text, _COUNTED),
    "source_utf16": (source_utf16, _COUNTED),
    "source_encodings": (source_encodings, "SELECT * FROM (VALUES ('UTF-8'), ('UTF-16LE'), ('UTF-16BE')) AS v(encoding)"),
    "source_zstd": (source_zstd, _COUNTED),
    "source_zstd_index": (source_zstd_index, _COUNTED),
    "source_frames": (source_frames, f"WITH {_C} SELECT {_N_BYTES}, CAST(0 AS BIGINT) AS n_errors FROM c"),
    "source_since": (source_since, f"WITH {_C} SELECT {_N_BYTES} FROM c"),
    "source_bounded": (source_bounded, f"""WITH {_C} SELECT 'within' AS part, count(*) AS n, CAST(coalesce(sum(strlen(line)), 0) AS BIGINT) AS n_bytes FROM c WHERE strlen(line) <= 200
UNION ALL SELECT 'beyond', count(*), CAST(coalesce(sum(strlen(line)), 0) AS BIGINT) FROM c WHERE strlen(line) > 200"""),
    "search_files": (search_files, f'WITH {_C} SELECT line, "offset", count(*) AS n FROM {_hits("c", "line")} GROUP BY ALL'),
    "search_damaged": (search_damaged, f"WITH {_C} SELECT 'hits' AS what, count(*) AS n FROM {_hits('c', 'line')} UNION ALL SELECT 'errors', 1"),
    "search_first_part": (search_first_part, f'WITH {_L} SELECT doc_id, CAST(pos AS INT) AS pos, "offset", length(line) > 60 AS cut FROM {_hits("l", "doc_id, pos, line", "substr(line, 1, 60)")}'),
    "library_runs": (library_runs, f"{_FIRST_OF} SELECT doc_id, line, run_id FROM k"),
    "library_dry": (library_dry, f"""WITH {_C}, k AS (SELECT line, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) > 0 AS known FROM c GROUP BY line)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_accepted, count(*) FILTER (NOT known) AS n_new, CAST(coalesce(sum(n) FILTER (known), 0) AS BIGINT) AS n_skipped, count(*) FILTER (known) AS n_common_keys,
  CAST(coalesce(sum(n - 1) FILTER (NOT known), 0) AS BIGINT) AS n_duplicates, CAST(1 AS BIGINT) AS n_runs, false AS written FROM k"""),
    "library_rebuilt": (library_rebuilt, f"{_FIRST_OF} SELECT line, run_id, 2 AS key_version FROM k"),
    "library_states": (library_states, f"""SELECT * FROM (VALUES ('made', '{FIRST}', 'fresh'), ('made', '{SECOND}', 'fresh'), ('lost', '{FIRST}', 'missing'), ('lost', '{SECOND}', 'fresh'),
  ('newer', '{FIRST}', 'missing'), ('newer', '{SECOND}', 'stale')) AS v(step, run_id, state)"""),
    "library_corrupt": (library_corrupt, f"{_FIRST_OF} SELECT run_id, count(*) AS n_keys, CAST(1 AS BIGINT) AS n_corrupt FROM k GROUP BY run_id"),
    "library_swept": (library_swept, f"{_FIRST_OF} SELECT line, run_id FROM k WHERE run_id = '{FIRST}'"),
    "library_ranges": (library_ranges, f"{_FIRST_OF} SELECT line FROM k WHERE run_id = '{SECOND}'"),
    "sink_text": (sink_text, _COUNTED),
    "sink_parts": (sink_parts, f"WITH {_C} SELECT count(*) AS n_rows, count(*) AS n_full, CAST(0 AS BIGINT) AS n_over, true AS whole, false AS empty_written FROM c"),
    "run_from_settings": (run_from_settings, f"""WITH {_C}, a AS (SELECT doc_id, lower(line) AS k, strlen(line) AS b, line FROM c), g AS (SELECT k, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) > 0 AS known FROM a WHERE b <= 2000 GROUP BY k)
SELECT (SELECT count(*) FROM a) AS n_read, (SELECT count(*) FROM a WHERE b > 2000) AS n_rejected, (SELECT count(DISTINCT line) FROM a WHERE b <= 2000) AS n_unique, (SELECT CAST(sum(b) AS BIGINT) FROM a) AS n_bytes,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS n_accepted, count(*) FILTER (NOT known) AS n_new, CAST(coalesce(sum(n) FILTER (known), 0) AS BIGINT) AS n_skipped, count(*) FILTER (known) AS n_common_keys,
  CAST(coalesce(sum(n - 1) FILTER (NOT known), 0) AS BIGINT) AS n_duplicates FROM g"""),
    "run_output": (run_output, f"WITH {_C} SELECT 'output' AS part, count(DISTINCT line) AS n FROM c WHERE strlen(line) <= 100 UNION ALL SELECT 'rejected', count(*) FROM c WHERE strlen(line) > 100"),
    "key_hashes": (key_hashes, f"WITH {_C} SELECT count(DISTINCT line) AS n_hashes, count(DISTINCT (doc_id, line)) AS n_pairs FROM c"),
    "secret_selected": (secret_selected, f"SELECT rule_id, count(*) AS n FROM (SELECT rule_id, unnest(regexp_extract_all(text, pattern, 1)) AS v FROM documents, (VALUES {_RULES}) AS r(rule_id, pattern)) WHERE v != '' GROUP BY rule_id"),
    "secret_once": (secret_once, None),
    "scan_stats": (scan_stats, "SELECT count(DISTINCT text) AS n_scanned, count(text) - count(DISTINCT text) AS n_skipped_scans FROM documents"),
    "guards": (guards, """SELECT what, true AS refused FROM (VALUES ('empty pattern'), ('pattern of two lines'), ('output over input'), ('standard input'), ('age of nothing'), ('no rule left'), ('bad glob'), ('unknown setting')) AS v(what)"""),
}
