"""Whole texts to token ids with the tokenizers library, each distinct chunk encoded once per worker.

Both supported pre-tokenizers start a new piece at a space before a non-space, whatever stands before
it, and at a line feed between two non-spaces, and normalise no character across these places. So the
ids of a text are the ids of its chunks, cut there, one after the other. Chunks are found and hashed (64
bits) as flat arrays; the library encodes each distinct chunk, many in one call, between separators
that are a piece of their own; the ids are kept in a table that is bounded and drops rare chunks when
it is full. Texts with an added token's string, and all texts if the tokenizer has another
pre-tokenizer, are encoded whole. Null is the empty text.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from millrace.llm import words as W

#: Distinct chunks that a worker keeps; beyond that it drops those that came once since the last time.
CACHE = 500_000
#: Slots of an empty table; a block with more new chunks than half of them makes it larger for as long as it holds them.
_SLOTS = 1 << 21
_ODD = re.compile(r"\s|\x01")
_STOPS = (",", ".")
#: Chunks that the library gets in one text.
JOINED = 256
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _cuts_at_spaces(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    norm = spec.get("normalizer") or {}
    steps = pre.get("pretokenizers", [pre])
    byte_level = len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space")
    dropped = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and r"[^\s" in (steps[0].get("pattern") or {}).get("Regex", "")
    known = {"NFC", "Replace", "Lowercase"}
    return (byte_level or dropped) and all(n.get("type") in known for n in norm.get("normalizers", [norm] if norm else []))


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a white space character, in any of its bytes."""
    out = _SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        b, c = data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
        a = data[lead]
        two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        three = lead[general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
        for k in range(2):
            out[two + k] = True
        for k in range(3):
            out[three + k] = True
    return out


class Encoder:
    def __init__(self, path: str, end: int | None = None) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.end = end
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.by_chunk = _cuts_at_spaces(spec)
        #: Ids of a line feed: one, or none where white space is dropped.
        self.feed = self.library.encode("\n", add_special_tokens=False).ids
        self.between = "\n" if self.feed else " \x01 "
        self.mark = (self.feed or self.library.encode("\x01", add_special_tokens=False).ids)[0]
        #: A letter and a stop after it are never of one piece.
        stops = {c: self.library.encode(c, add_special_tokens=False).ids for c in _STOPS}
        self.stops = {c: ids[0] for c, ids in stops.items() if len(ids) == 1}
        self._forget()

    def _forget(self) -> None:
        self.slot_key, self.slot_at = np.zeros(_SLOTS, U64), np.zeros(_SLOTS, np.int32)
        self.slots_used = 0
        self.n = 1  # entry 0 is the end
        self.key = np.zeros(1 << 12, U64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.hits = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.used = 0
        if self.end is not None:
            self.pool[0], self.sizes[0], self.used = self.end, 1, 1

    def _shrink(self) -> None:
        """Keeps the chunks that came more than once, if they are few enough."""
        at = np.flatnonzero((self.hits[: self.n] > 1) & (self.key[: self.n] != 0))
        keys, sizes, flat = self.key[at], self.sizes[at], self._gather(at)
        self._forget()
        if len(keys) <= CACHE // 2:
            self._keep(keys, flat, sizes)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        last = len(self.slot_key) - 1
        slot = (keys & U64(last)).astype(np.int64)
        while len(left):
            there = self.slot_key[slot]
            same = there == keys[left]
            out[left[same]] = self.slot_at[slot[same]]
            on = ~same & (there != 0)
            left, slot = left[on], (slot[on] + 1) & last
        return out

    def _keep(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Adds entries; a key of 0 is for this once."""
        n, to = self.n, self.n + len(keys)
        if to > len(self.sizes):
            grow = max(to, 2 * len(self.sizes)) - len(self.sizes)
            self.key, self.sizes, self.starts, self.hits = (np.pad(x, (0, grow)) for x in (self.key, self.sizes, self.starts, self.hits))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.pad(self.pool, (0, max(self.used + len(flat), 2 * len(self.pool)) - len(self.pool)))
        self.key[n:to] = keys
        self.sizes[n:to] = sizes
        self.starts[n:to] = self.used + np.cumsum(sizes) - sizes
        self.hits[n:to] = 0
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n = to
        at = np.arange(n, to)[keys != 0]
        self.slots_used += len(at)
        slots = len(self.slot_key)
        while 2 * self.slots_used > slots:
            slots *= 2
        if slots > len(self.slot_key):
            self.slot_key, self.slot_at = np.zeros(slots, U64), np.zeros(slots, np.int32)
            at = np.flatnonzero(self.key[:to])
        self._place(at)

    def _place(self, at: np.ndarray) -> None:
        """Finds a slot for each of these entries; fewer than half of the slots are taken, so one is free."""
        last = len(self.slot_key) - 1
        slot = (self.key[at] & U64(last)).astype(np.int64)
        while len(at):
            free = self.slot_key[slot] == 0
            _, first = np.unique(slot, return_index=True)
            wins = np.zeros(len(at), bool)
            wins[first] = True
            wins &= free
            self.slot_key[slot[wins]], self.slot_at[slot[wins]] = self.key[at[wins]], at[wins]
            at, slot = at[~wins], (slot[~wins] + ~free[~wins]) & last

    def _each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of strings without white space but for one leading space."""
        texts = [self.between.join(strings[i : i + JOINED]) for i in range(0, len(strings), JOINED)]
        flat = [np.array([*e.ids, self.mark], np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(marks, prepend=-1) - 1

    def _apart(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]
        return (np.concatenate(got) if got else np.zeros(0, np.uint32)), np.array([len(x) for x in got], np.int64)

    def _learn(self, chunks: list[str], keys: np.ndarray) -> None:
        """Entries for distinct chunks that stand in chunk form: a leading space or feed, or none at a text's start."""
        kind = np.zeros(len(chunks), np.int8)  # 0 alone, 1 after a space, 2 after a feed, 3 a word after a space with a stop
        odd = bool(_ODD.search("".join(c[1:] for c in chunks)))
        for i, c in enumerate(chunks):
            if len(c) < 2 or (odd and _ODD.search(c, 1)):
                continue
            if c[0] == "\n":
                kind[i] = 2
            elif c[0] == " ":
                kind[i] = 3 if c[-1] in self.stops and c[1:-1].isalpha() and (c.isascii() or max(c) < "ɐ") else 1
        alone, spaced, fed, ended = (np.flatnonzero(kind == k) for k in range(4))
        self._keep(keys[alone], *self._apart([chunks[i] for i in alone]))
        flat, sizes = self._each([chunks[i][1:] for i in fed])
        if self.feed and len(fed):
            flat, sizes = np.insert(flat, np.cumsum(sizes) - sizes, self.feed[0]), sizes + 1
        self._keep(keys[fed], flat, sizes)
        self._keep(keys[spaced], *self._each([chunks[i] for i in spaced]))
        if len(ended):
            heads = [chunks[i][:-1] for i in ended]
            raw = [h.encode() for h in heads]
            size = np.array([len(r) for r in raw])
            head_keys = W.run_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size)
            new, one = np.unique(head_keys, return_index=True)
            one = one[self._find(new) < 0]
            self._keep(head_keys[one], *self._each([heads[i] for i in one]))
            at = self._find(head_keys)
            stop = np.array([self.stops[chunks[i][-1]] for i in ended], np.uint32)
            self._keep(keys[ended], np.insert(self._gather(at), np.cumsum(self.sizes[at]), stop), self.sizes[at] + 1)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where chunks start, which texts are taken whole)."""
        n = len(data)
        start = np.zeros(n + 1, bool)
        start[offsets[:-1]] = True
        whole = np.full(len(offsets) - 1, not self.by_chunk)
        if self.by_chunk:
            raw = data.tobytes()
            if any(a in raw for a in self.added):
                whole |= [any(a in raw[x:y] for a in self.added) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            space = white_space(data)
            after, before = np.ones(n, bool), np.ones(n, bool)
            after[:-1], before[1:] = space[1:], space[:-1]
            after[offsets[1:][offsets[1:] > 0] - 1] = True
            before[offsets[:-1][offsets[:-1] < n]] = True
            cut = ~after & ((data == 32) | ((data == 10) & ~before))
            if whole.any():
                cut &= ~np.repeat(whole, np.diff(offsets))
            start[:n] |= cut
        return np.flatnonzero(start[:n]), whole

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts between these offsets of data, offsets of each text in them)."""
        if self.n > CACHE:
            self._shrink()
        start, whole = self._cuts(data, offsets)
        first = np.searchsorted(start, offsets)  # of each text's chunks
        if len(start):
            stop = np.append(start[1:], len(data))
            key = W.run_hashes(data, start)
            at = self._find(key)
            if whole.any():
                own = first[:-1][whole & (np.diff(offsets) > 0)]
                strings = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[own].tolist(), stop[own].tolist(), strict=True)]
                at[own] = np.arange(self.n, self.n + len(own))
                self._keep(np.zeros(len(own), U64), *self._apart(strings))
            new = np.flatnonzero(at < 0)
            if len(new):
                keys, one = np.unique(key[new], return_index=True)
                raw = data.tobytes()
                chunks = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[new[one]].tolist(), stop[new[one]].tolist(), strict=True)]
                self._learn(chunks, keys)
                at[new] = self._find(key[new])
            self.hits[: self.n] += np.bincount(at, minlength=self.n)
        else:
            at = np.zeros(0, np.int64)
        if self.end is not None:
            at = np.insert(at, first[1:], 0)
            first = first + np.arange(len(first))
        return self._gather(at), np.concatenate([[0], np.cumsum(self.sizes[at])])[first]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them); the end id, if any, follows each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        parts = [self.block(data, offsets) for _, offsets, data in W.blocks(column)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        size = np.concatenate([np.diff(o) for _, o in parts])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(size)])


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]
