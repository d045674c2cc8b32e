"""Exact token counts at every prefix, by dynamic programming over a byte-level BPE vocabulary.

The pre-tokenizer cuts a text into pieces that are encoded on their own. Within a piece, the encoding of
every prefix ends in one token, and that token t is the only one that fits: the prefix without t must
end in a token p such that p followed by t is what encoding both their bytes gives. So going left to
right, last[i] is found among the tokens that end at i, and count[i] = count[i - len(t)] + 1. No
prefix is encoded again. Which pairs fit is found once from the merge ranks and kept.

A prefix of a text is cut like the text but at three places, which are put right: white space that
ends a prefix is one piece; the inside of a contraction is an apostrophe and letters; the inside of an
added token's string is ordinary text. A prefix that ends inside a character counts the tokens of its
bytes. Each distinct piece is worked out once per worker; its table is bounded. In a piece of more than LONG
bytes the tokens that end at each place come from one automaton over the vocabulary, so the time is linear
in the piece and in the tokens that occur in it.

Defined results: null text is empty and has 0 tokens; repeated rows each get a row; extra columns are
ignored; texts may have any length (time is linear in it).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, repeat
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CONTRACTIONS = ("'re", "'ve", "'ll", "'s", "'t", "'m", "'d")
#: Characters about which the two regular expression libraries may know different versions of Unicode.
BEYOND = regex.compile("[\U00010000-\U0010ffff]")
RUN = regex.compile(r"\s{2,}+")
#: Distinct pieces, bytes of their tables' entries, and pairs of tokens, that a worker keeps.
PIECES, ENTRIES, PAIRS = 1_000_000, 16_000_000, 2_000_000
#: Pieces of more bytes go through the automaton.
LONG = 512
#: Texts, and their bytes (one text at least), that are worked on together.
TEXTS, TEXT_BYTES = 256, 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.of_id = {i: t for t, i in self.ids.items()}
        self.library = Tokenizer.from_file(path)
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.fits: dict[int, bool] = {}
        self._automaton = None
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(1 << 12, np.int64)
        self.bytes = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 15, np.int32)
        self.used = 0

    def encode_bytes(self, data: bytes) -> list[bytes]:
        """Plain merging by rank, for pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fit(self, a: int, b: int) -> bool:
        got = self.fits.get(a << 20 | b)
        if got is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            x, y = self.of_id[a], self.of_id[b]
            got = self.fits[a << 20 | b] = self.encode_bytes(x + y) == [x, y]
        return got

    def piece(self, data: bytes, known: tuple[list[int], list[int]] | None = None, shared: int = 0) -> tuple[list[int], list[int]]:
        """(last, count): last token and number of tokens of every prefix of one piece; known holds them up to shared."""
        n = len(data)
        if n > LONG:
            return self._long_piece(data)
        last, count = known[0][: shared + 1] if known else [-1], known[1][: shared + 1] if known else [0]
        ids, fits, longest = self.ids, self.fits, self.longest
        for i in range(len(last), n + 1):
            t = ids.get(data[:i]) if i <= longest else None
            if t is not None:
                last.append(t)
                count.append(1)
                continue
            for j in range(max(1, i - longest), i):
                t = ids.get(data[j:i])
                if t is None:
                    continue
                ok = fits.get(last[j] << 20 | t)
                if ok is None:
                    ok = self._fit(last[j], t)
                if ok:
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last, count

    def _long_piece(self, data: bytes) -> tuple[list[int], list[int]]:
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for token, i in self.ids.items():
                self._automaton.add_word(token.decode("latin-1"), (i, len(token)))
            self._automaton.make_automaton()
        last, count, fits = [-1], [0], self.fits
        for end, (t, size) in self._automaton.iter(data.decode("latin-1")):
            if len(last) == end + 2:
                continue  # the token that ends here is found
            j = end + 1 - size
            ok = j == 0 or fits.get(last[j] << 20 | t)
            if ok is None:
                ok = self._fit(last[j], t)
            if ok:
                last.append(t)
                count.append(count[j] + 1)
        if len(last) != len(data) + 1:
            raise ValueError("the vocabulary lacks a byte")
        return last, count

    def counts_of(self, data: bytes) -> list[int]:
        return self.piece(data)[1][1:]

    def _learn(self, pieces: list[str]) -> None:
        tables = []
        # in order, each piece takes over what it shares with the one before
        pieces = sorted(pieces)
        before, known = b"", None
        for p in pieces:
            data = p.encode()
            shared = len(commonprefix((before, data))) if len(data) <= LONG else 0
            known, before = self.piece(data, known, shared), data
            if p in CONTRACTIONS:
                inner = self.counts_of(b"'")[0]
                tables.append([inner, *(inner + c for c in self.counts_of(data[1:-1])), known[1][-1]])
            else:
                tables.append(known[1][1:])
        n, sizes = len(self.index), np.fromiter(map(len, tables), np.int64, len(tables))
        self.index.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        if n + len(pieces) > len(self.start):
            grow = max(n + len(pieces), 2 * len(self.start)) - len(self.start)
            self.start, self.bytes = np.pad(self.start, (0, grow)), np.pad(self.bytes, (0, grow))
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.pad(self.pool, (0, max(self.used + total, 2 * len(self.pool)) - len(self.pool)))
        self.start[n : n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.bytes[n : n + len(pieces)] = sizes
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(tables), np.int32, total)
        self.used += total

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or not BEYOND.search(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def tables(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, offsets): counts[offsets[i] + k] is the number of tokens of the first k + 1 bytes of text i; without added tokens."""
        if len(self.index) > PIECES or self.used > ENTRIES:
            self._forget()
        split = [self._cut(t) for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        pieces = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(list(dict.fromkeys(pieces[i] for i in new)))
            at[new] = [self.index[pieces[i]] for i in new]
        sizes, begin = self.bytes[at], self.start[at]
        ends = np.cumsum(sizes)
        own = self.pool[begin + sizes - 1].astype(np.int64)  # of each whole piece
        first = np.concatenate([[0], np.cumsum(n)])
        before = np.cumsum(own) - own
        before -= np.repeat(np.append(before, 0)[first[:-1]], n)
        total = int(ends[-1]) if len(ends) else 0
        counts = self.pool[np.repeat(begin - (ends - sizes), sizes) + np.arange(total)] + np.repeat(before, sizes)
        offsets = np.concatenate([[0], ends])[first]
        for i, t in enumerate(texts):
            if "  " in t or any(c in t for c in "\n\t\r") or not t.isascii():
                self._white_space(t, counts[offsets[i] : offsets[i + 1]])
        return counts, offsets

    def _white_space(self, text: str, counts: np.ndarray) -> None:
        """A prefix that ends with a run of white space has it as one piece."""
        at = a = 0
        for m in RUN.finditer(text):
            if m.end() == len(text):
                break  # it is one piece already
            a, at = a + len(text[at : m.start()].encode()), m.start()
            b = len(m[0].encode())
            base = int(counts[a - 1]) if a else 0
            last = len(m[0][-1].encode())
            counts[a + b - last : a + b] = base + np.array(self.counts_of(m[0].encode())[-last:])

    def table(self, text: str) -> np.ndarray:
        """Tokens of every prefix of one text, added tokens as the library takes them by default."""
        if not self.cut_added or not any(a in text for a in self.added):
            return self.tables([text])[0]
        out, base = [], 0
        parts = self.cut_added.split(text)
        for i in range(0, len(parts), 2):
            if i:
                special = parts[i - 1]
                inside = [base_before + int(self.tables([parts[i - 2] + special[:k]])[0][-1]) for k in range(1, len(special))]
                base += 1
                out.append(np.array([*inside, base], np.int64))
            base_before = base
            if parts[i]:
                own = self.tables([parts[i]])[0] + base
                out.append(own)
                base = int(own[-1])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def all_tables(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = [bool(self.cut_added) and any(a in t for a in self.added) for t in texts]
        if not any(special):
            return self.tables(texts)
        each = [self.table(t) for t in texts]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def tokens_within(table: np.ndarray, stop: int) -> int:
    """Tokens of the first stop bytes."""
    return int(table[stop - 1]) if stop else 0


def longest_within(table: np.ndarray, budget: int) -> int:
    """The most bytes whose encoding has at most budget tokens."""
    fit = np.flatnonzero(table <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, vocabulary: str, budget: int, store: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fitting[, table]): fitting is the most bytes within the budget; table holds the
    count at every byte prefix as little-endian 32-bit integers, for later questions without the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = counter(vocabulary)
        for b in batches:
            for at, part, _ in W.blocks(b.column(1), TEXT_BYTES, TEXTS):
                rows = len(part) - 1
                texts = [t or "" for t in b.column(1).slice(at, rows).to_pylist()]
                table, offsets = use.all_tables(texts)
                size, total, fitting, kept = np.diff(offsets), [], [], []
                for i in range(len(texts)):
                    own = table[offsets[i] : offsets[i + 1]]
                    n = tokens_within(own, len(own))
                    total.append(n)
                    fitting.append(len(own) if n <= budget else longest_within(own, budget))
                    if store:
                        kept.append(own.astype("<u4").tobytes())
                out = [b.column(0).slice(at, rows), pa.array(size), pa.array(total, pa.int64()), pa.array(fitting, pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens", "fitting"]
                if store:
                    out, names = [*out, pa.array(kept, pa.binary())], [*names, "table"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, fitting long" + ", table binary" * store)


def store_tables(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, table) of every document, written to a folder and read from there."""
    made = prefix_counts(docs, vocabulary, 1 << 62, id_col=id_col, text_col=text_col).select("doc_id", "n_bytes", "table")
    made.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def counts_of_tables(stored: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fitting) as prefix_counts has them, from stored tables alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, fitting = [], []
            for t in b.column(2):
                own = np.frombuffer(t.as_buffer(), "<u4")
                n = tokens_within(own, len(own))
                total.append(n)
                fitting.append(len(own) if n <= budget else longest_within(own, budget))
            out = [b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(fitting, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_bytes", "n_tokens", "fitting"])

    return stored.select("doc_id", "n_bytes", "table").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, fitting long")
