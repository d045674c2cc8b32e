"""Lines of documents: bounded, trimmed, accepted or rejected, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import strings as S

REJECT_BYTES = 8192


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, line): trimmed, non-empty lines; pos counts all lines from 0."""
    cut = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return cut.select(id_col, "pos", S.trim_line(F.col("line")).alias("line")).where("line != ''")


def split_by(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); null counts as rejected. Both read the same plan, so filters still reach the scan."""
    ok = F.coalesce(ok, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def reject_records(rejected: DataFrame, source: Column, position: Column, line: Column) -> DataFrame:
    """(record): source, position and escaped line, separated by tabs and cut to REJECT_BYTES with a mark."""
    escaped = F.replace(F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    whole = F.concat_ws("\t", source.cast("string"), position.cast("string"), escaped)
    mark = "...[cut]"
    cut = F.concat(S.cap_bytes(whole, REJECT_BYTES - len(mark)), F.lit(mark))
    return rejected.select(F.when(F.octet_length(whole) > REJECT_BYTES, cut).otherwise(whole).alias("record"))


def metrics(rows: DataFrame, ok: Column, line: str = "line") -> DataFrame:
    """One row of counters: read, accepted, rejected, distinct accepted lines, duplicates and bytes."""
    ok = F.coalesce(ok, F.lit(False))
    per_line = rows.groupBy(F.col(line), ok.alias("ok")).agg(F.count("*").alias("n"))  # partial sums before the only shuffle
    return per_line.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_read"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("n_accepted"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("n_rejected"), F.count_if("ok").alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n") - 1)), F.lit(0)).alias("n_duplicates"), F.coalesce(F.sum(F.octet_length(line) * F.col("n")), F.lit(0)).cast("long").alias("n_bytes"),
    )
