"""A run from settings to counters: inputs are read, cleaned, deduplicated against the library and written.

    python -m millrace.run SETTINGS.toml
"""

from __future__ import annotations

import json
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import config
from millrace.functions import strings as S
from millrace.operators import incremental, lines
from millrace.operators.library import Library
from millrace.session import written
from millrace.sources import sinks, text


def read(spark: SparkSession, settings: config.Settings) -> DataFrame:
    """(path, pos, line) of all text and zstd inputs; pos rises within a file."""
    paths = list(settings.inputs)
    since = datetime.now(UTC) - text.parse_age(settings.since) if settings.since else None
    parts = []
    for glob, reader in ((text.TXT, text.read_sniffed if settings.sniff else text.read_lines), (text.ZST, text.read_zstd_lines)):
        try:
            found = text.files(spark, paths, glob, since)
        except FileNotFoundError:
            continue
        parts.append(reader(spark, [r.path for r in found.select("path").toLocalIterator()] if since else paths, glob))
    if not parts:
        raise FileNotFoundError(f"no input in {paths}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.withColumn("pos", F.monotonically_increasing_id())


def run(spark: SparkSession, settings: config.Settings) -> dict[str, int | str | None]:
    """Counters of the run. Lines beyond max_line_bytes are rejected (and kept in `rejected`, if that is set); of the
    others, the first with each key that neither the run nor the library has is written to `output` and added to
    `library`, whichever are set. dry counts and writes nothing."""
    for out in (settings.output, settings.rejected, settings.library):
        if out:
            sinks.check_apart(spark, out, list(settings.inputs))
    rows = written(read(spark, settings), "lines")
    ok = S.within_bound(F.col("line"), settings.max_line_bytes)
    good, bad = lines.split_by(rows, ok)
    counters: dict[str, int | str | None] = dict(lines.metrics(rows, ok).first().asDict())
    keyed = good.withColumn("key", F.expr(settings.key)).where("key IS NOT NULL")
    order = ["path", "pos", "line"]
    library = Library(spark, settings.library, ["key"]) if settings.library else None
    if library and not settings.dry:
        library.rebuild()
    known = library.key_table() if library else None
    known = known if known is not None else keyed.select("key").limit(0)
    counters |= incremental.run_stats(keyed, known, ["key"]).first().asDict()
    counters["run_id"] = None
    if settings.dry:
        return counters
    if settings.rejected:
        sinks.write(lines.reject_records(bad, F.col("path"), F.col("pos"), F.col("line")), settings.rejected, "text", settings.rows_per_part)
    if settings.output:
        fresh = incremental.unseen(keyed, known, ["key"], order)
        sinks.write(fresh.select("line") if settings.kind == "text" else fresh.select("key", "line"), settings.output, settings.kind, settings.rows_per_part, list(settings.inputs))
    if library:
        counters["run_id"] = library.add(keyed, order)[0]
    return counters


def main(arguments: list[str]) -> None:
    if len(arguments) != 1:
        raise SystemExit(__doc__)
    settings = config.load(arguments[0])
    spark = SparkSession.builder.getOrCreate()
    print(json.dumps(run(spark, settings)))


if __name__ == "__main__":
    main(sys.argv[1:])
