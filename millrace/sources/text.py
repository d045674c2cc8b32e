"""Text inputs: discovery, encodings, bounded lines, and foreign zstd files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.strings import MAX_LINE_BYTES, trim_line
from millrace.session import few, workers_import, written

TXT = "*.[tT][xX][tT]"
ZST = "*.[zZ][sS][tT]"
#: A zstd frame that asks for a larger window is refused.
WINDOW_BYTES = 128 << 20
MAGIC, SKIPPABLE = b"\x28\xb5\x2f\xfd", 0x184D2A50
_UNIT = {"d": 86400, "h": 3600, "m": 60, "s": 1}


def parse_age(text: str) -> timedelta:
    """7d, 12h, 90m, 1d6h; more than 0."""
    parts = re.findall(r"(\d+)([dhms])", text)
    if not parts or "".join(n + u for n, u in parts) != text or not (total := sum(int(n) * _UNIT[u] for n, u in parts)):
        raise ValueError(f"not an age: {text!r}")
    return timedelta(seconds=total)


def files(spark: SparkSession, paths: list[str], glob: str = TXT, since: datetime | None = None) -> DataFrame:
    """(path, length, modificationTime) of the inputs, listed recursively, without hidden files; none is an error.

    since is inclusive; the source's own limit is exclusive, so it is set a second back and checked again.
    """
    if any(p == "-" for p in paths):
        raise ValueError("standard input can't be read")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if since:
        reader = reader.option("modifiedAfter", (since - timedelta(seconds=1)).strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    found = reader.load(paths).select("path", "length", "modificationTime")
    if since:
        found = found.where(F.col("modificationTime") >= F.lit(since.astimezone(UTC).isoformat()).cast("timestamp"))
    if found.isEmpty():
        raise FileNotFoundError(f"no input in {paths}")
    return found


def read_lines(spark: SparkSession, paths: list[str], glob: str = TXT) -> DataFrame:
    """(path, line) of UTF-8 files, trimmed and non-empty; large files are split between tasks."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(paths)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), trim_line(F.col("value")).alias("line"))
    return rows.where("line != ''")


def _listed(spark: SparkSession, paths: list[str], glob: str) -> DataFrame:
    """(path, length) without any content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths).select("path", "length")


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _opened(path: str):
    """A handle that seeks, so that a part of a file is read without the rest."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(_uri(path))
    return system.open_input_file(at)


def seekable(spark: SparkSession, paths: list[str]) -> bool:
    """Whether workers can open these stores by themselves; others are only read whole, by Spark."""
    from pyarrow import fs

    try:
        for p in paths:
            system, at = _hadoop(spark, p)
            fs.FileSystem.from_uri(_uri(system.makeQualified(at).toString()))
    except (OSError, ValueError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return True


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _kind(head: Column) -> Column:
    return F.when(F.hex(head).startswith("FFFE"), "UTF-16LE").when(F.hex(head).startswith("FEFF"), "UTF-16BE").otherwise("UTF-8")


def _heads(spark: SparkSession, paths: list[str], glob: str) -> DataFrame:
    """(path, length, encoding) by byte order mark; two bytes of each file are read, where the store allows it."""
    if not seekable(spark, paths):
        raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths)
        return raw.select("path", "length", _kind(F.substring("content", 1, 2)).alias("encoding"))
    workers_import(spark)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                with _opened(path) as f:
                    out.append(f.read(2))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=["path", "length", "head"])

    return _listed(spark, paths, glob).mapInArrow(head, "path string, length long, head binary").select("path", "length", _kind(F.col("head")).alias("encoding"))


def sniffed(spark: SparkSession, paths: list[str], glob: str = TXT) -> DataFrame:
    """(path, encoding) by byte order mark; UTF-8 without one."""
    return _heads(spark, paths, glob).select("path", "encoding")


#: Bytes of a UTF-16 file that a task reads, an even number; tasks of one file's ranges at most; lines of a batch.
RANGE_BYTES, RANGE_TASKS, BATCH_LINES = 8 << 20, 10_000, 8192


def _wide_lines(f, start: int, end: int, little: bool) -> Iterator[pa.Array]:
    """The lines, without line feeds and empty ones, of an open UTF-16 file that begin at bytes start to end. A range that
    isn't the first begins to look one unit before, and what it holds before its first line feed belongs to the range
    that the line began in; so each line is given once, and of a range within a line nothing is held."""
    at = max(2, start - 2)  # behind the mark
    held: list[bytes] | None = None if start else []  # of the line that has begun
    rest = b""
    f.seek(at)
    while True:
        got = f.read(READ_BYTES)
        data = rest + got
        if not got:  # half a unit at the end stays, for the decoder to tell
            if held is not None and (line := b"".join([*held, data])):
                yield pa.array([line], pa.binary())
            return
        n = len(data) & ~1
        rest, units = data[n:], np.frombuffer(data, "<u2" if little else ">u2", n // 2)
        feeds = np.flatnonzero(units == 10)
        within = int(np.searchsorted(at + 2 * (feeds + 1), end))  # feeds behind which a line of this range begins
        done, feeds, at = within < len(feeds), feeds[: within + 1], at + n
        first = 0
        if held is None:
            if not within:
                if done or at >= end:
                    return
                continue
            held, first, feeds = [], int(feeds[0]) + 1, feeds[1:]
        if len(feeds):
            kept = units[first : feeds[-1]]
            size = 2 * (np.diff(feeds, prepend=first - 1) - 1)
            before = b"".join(held)
            size[0] += len(before)
            offsets = np.concatenate([[0], np.cumsum(size[size > 0])]).astype(np.int32)
            body = before + kept[kept != 10].tobytes()
            yield pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)])
            first, held = int(feeds[-1]) + 1, []
        if done:
            return
        held.append(data[2 * first : n])


def _read_wide(spark: SparkSession, wide: DataFrame, ranged: bool) -> DataFrame:
    """(path, line) of the UTF-16 files of a written table (path, length, encoding), a task taking ranges of files; without
    ranged a file is read whole, by Spark."""
    import io

    workers_import(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, kind, start, end = (b.column(k)[i].as_py() for k in range(4))
                with _opened(path) if ranged else io.BytesIO(b.column(4)[i].as_buffer()) as f:
                    for lines in _wide_lines(f, start, end, kind == "UTF-16LE"):
                        for k in range(0, len(lines), BATCH_LINES):
                            some = lines.slice(k, BATCH_LINES)
                            yield pa.RecordBatch.from_arrays([pa.repeat(path, len(some)), pa.repeat(kind, len(some)), some], names=["path", "encoding", "line"])

    if ranged:
        starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))
        ranges = wide.select("path", "encoding", F.explode(starts).alias("start")).select("*", (F.col("start") + RANGE_BYTES).alias("end"))
        todo = ranges.repartition(max(1, min(ranges.count(), RANGE_TASKS)))
    else:
        raw = spark.read.format("binaryFile").load([r.path for r in wide.select("path").toLocalIterator()])
        kind = _kind(F.substring("content", 1, 2))
        todo = raw.select("path", kind.alias("encoding"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), "content")
    found = todo.mapInArrow(run, "path string, encoding string, line binary")
    text = F.when(F.col("encoding") == "UTF-16LE", F.decode("line", "UTF-16LE")).otherwise(F.decode("line", "UTF-16BE"))
    return found.select("path", trim_line(text).alias("line")).where("line != ''")


def read_sniffed(spark: SparkSession, paths: list[str], glob: str = TXT) -> DataFrame:
    """(path, line) of files in UTF-8 or UTF-16 with a byte order mark. Ranges of a UTF-16 file are read by different
    tasks, in pieces (a file in a store that only Spark opens: whole, by one); UTF-8 files go through read_lines."""
    wide = written(_heads(spark, paths, glob).where("encoding != 'UTF-8'"), "wide")
    lines = read_lines(spark, paths, glob)
    if wide.isEmpty():
        return lines
    same = F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace("wide", "^file:/+", "/")
    narrow = lines.join(few(wide.select(F.col("path").alias("wide"))), same, "left_anti")
    return narrow.unionByName(_read_wide(spark, wide, seekable(spark, paths)))


def bounded(lines: DataFrame, limit: int = MAX_LINE_BYTES, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(lines within the limit, lines beyond it)."""
    ok = F.octet_length(line) <= limit
    return lines.where(ok), lines.where(~ok)


#: Bytes that are read, and decoded, at a time (an even number); in a walk fewer are read, since little input may decode to much.
READ_BYTES, WALK_BYTES = 1 << 20, 4096


class DamagedFrame(ValueError):
    """at: where the file stops being readable."""

    def __init__(self, what: str, at: int) -> None:
        super().__init__(f"{what} at byte {at}")
        self.at = at


def _walk(f, size: int) -> Iterator[tuple[int, int, int]]:
    """(offset, length, decoded length) of each frame of an open file, which is read once, WALK_BYTES at a time."""
    import zstandard

    at = 0
    while at < size:
        f.seek(at)
        head = f.read(8)
        if len(head) >= 4 and int.from_bytes(head[:4], "little") & 0xFFFFFFF0 == SKIPPABLE:
            if len(head) < 8:
                raise DamagedFrame("a skippable frame is cut off", at)
            at += 8 + int.from_bytes(head[4:], "little")
            continue
        if head[:4] != MAGIC:
            raise DamagedFrame("no zstd frame", at)
        f.seek(at)
        decoder, length, decoded = zstandard.ZstdDecompressor(max_window_size=WINDOW_BYTES).decompressobj(), 0, 0
        try:
            while not decoder.eof and (data := f.read(WALK_BYTES)):
                decoded += len(decoder.decompress(data))
                length += len(data) - len(decoder.unused_data)
        except zstandard.ZstdError as e:
            raise DamagedFrame(str(e), at) from e
        if not decoder.eof:
            raise DamagedFrame("a frame is cut off", at)
        yield at, length, decoded
        at += length


def frames(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, length, decoded length) of each zstd frame; skippable frames are passed over, other bytes are an error."""
    import io

    return list(_walk(io.BytesIO(data), len(data)))


_FRAMES = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("frame", "offset", "length", "size")), ("error", pa.string())])


def frame_index(spark: SparkSession, paths: list[str], glob: str = ZST) -> DataFrame:
    """(path, frame, offset, length, size, error) of every frame of zstd files. Where a file can't be read on, its last row
    has the error and no size; other files are not touched by it."""
    import io

    workers_import(spark)
    ranged = seekable(spark, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path in enumerate(b.column(0).to_pylist()):
                f = _opened(path) if ranged else io.BytesIO(b.column(1)[i].as_py())
                size = f.size() if ranged else len(f.getbuffer())
                held, k = [], 0
                try:
                    for k, (at, length, decoded) in enumerate(_walk(f, size), 1):
                        held.append((path, k - 1, at, length, decoded, None))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)][:5] + [pa.nulls(len(held), pa.string())], schema=_FRAMES)
                            held = []
                except DamagedFrame as e:
                    held.append((path, k, e.at, size - e.at, None, str(e)))
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _FRAMES.types, strict=True)], schema=_FRAMES)
                f.close()

    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths)
    return raw.select("path", *([] if ranged else ["content"])).mapInArrow(run, "path string, frame long, offset long, length long, size long, error string")


def saved_frame_index(spark: SparkSession, paths: list[str], folder: str, glob: str = ZST) -> DataFrame:
    """frame_index() kept as Parquet in folder; files without an entry, or changed since it was made, are looked at again."""
    now = files(spark, paths, glob).select("path", F.col("modificationTime").alias("changed"))
    system, at = _hadoop(spark, folder)
    if not system.exists(at):
        frame_index(spark, paths, glob).join(now, "path").write.parquet(folder)
        return spark.read.parquet(folder)
    old = spark.read.parquet(folder)
    stale = now.join(old.select("path", "changed").distinct(), ["path", "changed"], "left_anti")
    if not stale.isEmpty():
        again = [r.path for r in stale.select("path").toLocalIterator()]
        frame_index(spark, again, glob).join(now, "path").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(now, ["path", "changed"], "left_semi")


#: Bytes of decoded lines in a batch, about.
LINE_BYTES = 1 << 20
_PIECES = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("seq", pa.int64()), ("line", pa.binary()), ("edge", pa.int32())])


def _frame_lines(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
    """(line, edge) of one frame's decoded bytes: whole lines (edge 0), and what stands before its first line feed (1)
    and after its last (2); a frame without one is all 3."""
    held: list[bytes] = []
    first = True
    for data in chunks:
        *whole, rest = data.split(b"\n")
        for line in whole:
            yield b"".join([*held, line]), 1 if first else 0
            held, first = [], False
        held.append(rest)
    yield b"".join(held), 3 if first else 2


class _Slice:
    """So many bytes of an open file from where it stands."""

    def __init__(self, f, length: int) -> None:
        self.f, self.left = f, length

    def read(self, n: int) -> bytes:
        data = self.f.read(min(n, self.left))
        self.left -= len(data)
        return data


def zstd_lines(spark: SparkSession, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, frame, seq, line), (path, frame, error)): the lines of the frames of an index (path, frame, offset, length),
    a task taking some frames and no file being one task's. Pieces of lines that cross frames are put together, file by
    file, from what stands at the frames' edges alone. A frame that does not decode gives what it holds before the fault
    and a row among the errors; the others are not touched by it."""
    workers_import(spark)

    def decoded(path: str, offset: int, length: int) -> Iterator[bytes]:
        import zstandard

        with _opened(path) as f:
            f.seek(offset)
            reader = zstandard.ZstdDecompressor(max_window_size=WINDOW_BYTES).stream_reader(_Slice(f, length), read_size=READ_BYTES)
            while data := reader.read(READ_BYTES):
                yield data

    def pieces_of(path: str, offset: int, length: int) -> Iterator[tuple[bytes, int]]:
        import zstandard

        fault: list[str] = []

        def until_fault() -> Iterator[bytes]:
            try:
                yield from decoded(path, offset, length)
            except (zstandard.ZstdError, OSError) as e:
                fault.append(str(e))

        yield from _frame_lines(until_fault())
        for e in fault:
            yield e.encode(), -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, frame, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held, size = [], 0
                for seq, (line, edge) in enumerate(pieces_of(path, offset, length)):
                    held.append((path, frame, seq, line, edge))
                    size += len(line)
                    if size >= LINE_BYTES or len(held) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts, at = None, [], (0, 0)
        for b in batches:
            out = []
            for path, frame, seq, line, edge in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != of:
                    if of is not None:
                        out.append((of, *at, b"".join(parts), 0))
                    of, parts, at = path, [], (frame, seq)
                parts.append(line)
                if edge == 1:  # the line feed behind it ends the line
                    out.append((path, *at, b"".join(parts), 0))
                    parts = []
                elif edge == 2:
                    parts, at = [line], (frame, seq)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((of, *at, b"".join(parts), 0), _PIECES.types, strict=True)], schema=_PIECES)

    schema = "path string, frame long, seq long, line binary, edge int"
    todo = index.select("path", "frame", "offset", "length").repartition("path", "frame")
    pieces = written(todo.mapInArrow(run, schema), "frames")
    across = pieces.where("edge > 0").repartition("path").sortWithinPartitions("path", "frame", "seq").mapInArrow(joined, schema)
    text = F.decode("line", "UTF-8")
    whole = pieces.where("edge = 0").unionByName(across)
    lines = whole.select("path", "frame", "seq", trim_line(text).alias("line")).where("line != ''")
    return lines, pieces.where("edge = -1").select("path", "frame", text.alias("error"))


def read_zstd_lines(spark: SparkSession, paths: list[str], glob: str = ZST, index: DataFrame | None = None) -> DataFrame:
    """(path, line) of zstd text files of any number of frames; lines may cross frames. Frames are read in parallel; files
    in a store that only Spark opens are read whole, one task a file."""
    if seekable(spark, paths):
        return zstd_lines(spark, (index if index is not None else frame_index(spark, paths, glob)).where("error IS NULL"))[0].select("path", "line")
    import io

    workers_import(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                decoder = zstandard.ZstdDecompressor(max_window_size=WINDOW_BYTES)
                text = io.TextIOWrapper(decoder.stream_reader(io.BytesIO(content.as_py()), read_across_frames=True), encoding="utf-8", errors="replace", newline="\n")
                held: list[str] = []
                for line in text:
                    if line := line.rstrip("\r\n"):
                        held.append(line)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held, pa.string())], names=["path", "line"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(held, pa.string())], names=["path", "line"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths).select("path", "content")
    return raw.mapInArrow(run, "path string, line string")


def damaged(index: DataFrame) -> DataFrame:
    """(path, frame, offset, error): where the files of a frame index can't be read on."""
    return index.where("error IS NOT NULL").select("path", "frame", "offset", "error")
