"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, least first. Level k holds chunk k of every id that has one; a
bitmap of the level says which of its chunks continue in the next level, and a rank directory counts
the set bits before every block of 512. Token i is read level by level: its chunk, its bit, and if that
is set the rank of its place, which is its place one level up. So any token is found in as many steps
as its id has chunks, without decoding a block, and small ids take one byte and one bit.

A part (little-endian) has a 40-byte head (magic, levels, documents, tokens, shard), the doc_ids (int64), a
bitmap of null doc_ids, the documents' offsets (int64, one more than documents), then for each level its
length (int64), chunks (bytes), bitmap (bytes) and directory (int64), and last a crc32 of all before it. A
file (.dac) is a run of parts of about PART_TOKENS tokens (one document at least) and a trailer that says
where each begins, what documents and tokens it has, and how many parts there are. So writer and reader
hold a part, never a file, and a token is still found by reading its own few bytes of one part.

Null text is empty and has the end id alone; repeated rows are written each, in the order of their texts.
Null doc_ids come first. Extra columns are ignored; without documents there is no file. Documents are dealt
over files by ranges of (doc_id, text hash), in ascending order. A file is written whole under another name
before it gets its own, and one that has its name already stays, so a repeated task leaves the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.tokens import Encoder, encoder
from millrace.session import input_bytes, written

MAGIC = b"DACTOK02"
BLOCK = 512
#: Bytes of input that go to one file, about.
FILE_BYTES = 128 << 20
#: Tokens of a part, about.
PART_TOKENS = 1 << 20
#: Bytes of ids, and documents, of a batch that is read, about.
BATCH_BYTES, BATCH_DOCS = 1 << 20, 4096
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Level:
    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray) -> None:
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    @classmethod
    def of(cls, chunks: np.ndarray, more: np.ndarray) -> Level:
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (BLOCK // 8)))
        per_block = _ONES[bitmap].reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        return cls(chunks, bitmap, np.concatenate([[0], np.cumsum(per_block)])[:-1].astype(np.int64) if len(per_block) else np.zeros(0, np.int64))

    def rank(self, i: int) -> int:
        """Set bits before place i."""
        block = i // BLOCK
        if block >= len(self.ranks):
            return int(self.ranks[-1] + _ONES[self.bitmap[(len(self.ranks) - 1) * (BLOCK // 8) :]].sum()) if len(self.ranks) else 0
        own = self.bitmap[block * (BLOCK // 8) : i // 8]
        part = int(self.bitmap[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(self.ranks[block]) + int(_ONES[own].sum()) + part.bit_count()

    def more(self, i: int) -> bool:
        return bool(self.bitmap[i // 8] >> (i % 8) & 1)


class Codes:
    """Directly addressable codes of a run of ids."""

    def __init__(self, levels: list[Level], n: int) -> None:
        self.levels, self.n = levels, n

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, n, rest = [], len(ids), ids.astype(np.uint32)
        while True:
            more = rest > 0xFF
            levels.append(Level.of((rest & 0xFF).astype(np.uint8), more))
            if not more.any():
                return cls(levels, n)
            rest = rest[more] >> 8

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not level.more(i):
                break
            i, shift = level.rank(i), shift + 8
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1: one rank at the start of the range for each level."""
        out = np.zeros(stop - start, np.uint32)
        places = np.arange(stop - start)
        for k, level in enumerate(self.levels):
            if stop <= start:
                break
            out[places] |= level.chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            lo = start // 8
            bits = np.unpackbits(level.bitmap[lo : -(-stop // 8)], bitorder="little")[start - 8 * lo :][: stop - start].astype(bool)
            places, start = places[bits], level.rank(start)
            stop = start + len(places)
        return out


def pack(shard: int, doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray, nulls: np.ndarray | None = None) -> bytes:
    """A part."""
    codes = Codes.of(ids)
    nulls = np.zeros(len(doc_ids), bool) if nulls is None else nulls
    parts = [
        struct.pack("<8sQQQq", MAGIC, len(codes.levels), len(doc_ids), len(ids), shard),
        doc_ids.astype("<i8").tobytes(), np.packbits(nulls, bitorder="little").tobytes(), offsets.astype("<i8").tobytes(),
    ]
    for level in codes.levels:
        parts += [struct.pack("<q", len(level.chunks)), level.chunks.tobytes(), level.bitmap.tobytes(), level.ranks.astype("<i8").tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Part:
    """A part's content; reading a token or a document touches only its own bytes."""

    def __init__(self, content: bytes) -> None:
        magic, levels, self.n_docs, self.n_tokens, self.shard = struct.unpack_from("<8sQQQq", content)
        if magic != MAGIC or zlib.crc32(memoryview(content)[:-4]) != struct.unpack_from("<I", content, len(content) - 4)[0]:
            raise ValueError("not a whole part of a token file")
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids = take("<i8", self.n_docs)
        self.nulls = np.unpackbits(take("u1", -(-self.n_docs // 8)), count=self.n_docs, bitorder="little").astype(bool)
        self.offsets = take("<i8", self.n_docs + 1)
        made = []
        for _ in range(levels):
            n = int(take("<q", 1)[0])
            blocks = -(-n // BLOCK)
            made.append(Level(take("u1", n), take("u1", blocks * (BLOCK // 8)), take("<i8", blocks)))
        self.codes = Codes(made, self.n_tokens)

    def token(self, i: int) -> int:
        return self.codes[i]

    def document(self, k: int) -> np.ndarray:
        return self.codes.range(int(self.offsets[k]), int(self.offsets[k + 1]))


class TokenFile:
    """A file of parts, read through a handle that seeks: the trailer first, then the parts that are asked for."""

    def __init__(self, folder: str, name: str) -> None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        self.source = system.open_input_file(f"{path}/{name}")
        size = self.source.size()
        n, magic = struct.unpack("<Q8s", self._bytes(size - 16, 16))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a whole token file")
        own = np.frombuffer(self._bytes(size - 16 - 24 * n, 24 * n), "<i8").reshape(-1, 3)
        self.begin = np.append(own[:, 0], size - 16 - 24 * n)
        self.first_doc = np.concatenate([[0], np.cumsum(own[:, 1])])
        self.first_token = np.concatenate([[0], np.cumsum(own[:, 2])])
        self.shard = struct.unpack("<8sQQQq", self._bytes(0, 40))[4]
        self._held: tuple[int, Part] | None = None

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(n))

    @property
    def n_docs(self) -> int:
        return int(self.first_doc[-1])

    @property
    def n_tokens(self) -> int:
        return int(self.first_token[-1])

    def part(self, k: int) -> Part:
        if self._held is None or self._held[0] != k:
            self._held = k, Part(self._bytes(self.begin[k], self.begin[k + 1] - self.begin[k]))
        return self._held[1]

    def token(self, i: int) -> int:
        k = int(np.searchsorted(self.first_token, i, "right")) - 1
        return self.part(k).token(i - int(self.first_token[k]))

    def document(self, i: int) -> np.ndarray:
        k = int(np.searchsorted(self.first_doc, i, "right")) - 1
        return self.part(k).document(i - int(self.first_doc[k]))

    def close(self) -> None:
        self.source.close()


def save(folder: str, name: str, parts: Iterator[tuple[bytes, int, int]]) -> tuple[int, int]:
    """Writes (part, its documents, its tokens) to a file; (documents, tokens) of them all."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    draft, at, own = f"{path}/_{name}.{uuid.uuid4().hex}", 0, []
    with system.open_output_stream(draft) as out:
        for content, docs, tokens in parts:
            out.write(content)
            own.append((at, docs, tokens))
            at += len(content)
        out.write(np.array(own, "<i8").tobytes() + struct.pack("<Q8s", len(own), MAGIC))
    if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        system.move(draft, f"{path}/{name}")
    else:
        system.delete_file(draft)
    return sum(x[1] for x in own), sum(x[2] for x in own)


def _parts(shard: int, batches: Iterator[pa.RecordBatch], use: Encoder) -> Iterator[tuple[bytes, int, int]]:
    held: list[tuple[np.ndarray, ...]] = []
    tokens = 0

    def made() -> tuple[bytes, int, int]:
        doc, nulls, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        return pack(shard, doc, np.concatenate([[0], np.cumsum(size)]), flat, nulls), len(doc), len(flat)

    for b in batches:
        for at, offsets, data in W.blocks(b.column(1)):
            own = b.column(0).slice(at, len(offsets) - 1)
            flat, ends = use.block(data, offsets)
            held.append((own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False), np.diff(ends), flat))
            tokens += len(flat)
            if tokens >= PART_TOKENS:
                yield made()
                held.clear()
                tokens = 0
    if held:
        yield made()


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes folder/tokens-NNNNNNNN.dac; (shard, docs, tokens) of each file, read from the shared folder."""
    spark = docs.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)  # without documents it stays empty
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // FILE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (b for b in batches if b.num_rows)
        first = next(full, None)
        if first is not None:
            shard = first.column(2)[0].as_py()
            n = save(folder, f"tokens-{shard:08d}.dac", _parts(shard, chain([first], full), encoder(vocabulary, end)))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, *n)], names=["shard", "docs", "tokens"])

    return written(dealt.mapInArrow(write, "shard long, docs long, tokens long"), "manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files alone: ids are the document's, start the ids of all documents before it."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select(F.substring_index("path", "/", -1).alias("name"))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [TokenFile(folder, name) for name in b.column(0).to_pylist()]
            for f in found:
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([f.shard for f in found], pa.int64()), pa.array([f.n_tokens for f in found], pa.int64())], names=["shard", "tokens"])

    heads = names.mapInArrow(head, "shard long, tokens long").toArrow()  # 16 bytes a file
    shard, tokens = (heads.column(k).to_numpy() for k in range(2))
    order = np.argsort(shard)
    sent = spark.sparkContext.broadcast((shard[order], np.cumsum(tokens[order]) - tokens[order]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, base = sent.value
        for b in batches:
            for name in b.column(0).to_pylist():
                f = TokenFile(folder, name)
                before = int(base[np.searchsorted(shards, f.shard)])
                for k in range(len(f.begin) - 1):
                    yield from rows_of(f.part(k), before + int(f.first_token[k]))
                f.close()

    def rows_of(part: Part, before: int) -> Iterator[pa.RecordBatch]:
        first, out, size = 0, [], 0
        for k in range(part.n_docs):
            own = part.document(k).astype("<u4").tobytes()
            out.append(own)
            size += len(own)
            if size >= BATCH_BYTES or len(out) >= BATCH_DOCS or k + 1 == part.n_docs:
                span = slice(first, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.doc_ids[span], pa.int64(), mask=part.nulls[span]), pa.array(before + part.offsets[span]),
                        pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                first, out, size = k + 1, [], 0

    return names.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
