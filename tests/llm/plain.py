"""Plain versions of operators, one text at a time, that the tests hold queries against."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from millrace.llm import lang_id, quality_knn
from millrace.llm import words as W

LETTERS = regex.compile(r"\p{L}+")


def remainder(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def library(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


class Languages:
    """rows: (text, lang)."""

    def __init__(self, rows):
        self.words, self.grams = {}, {}
        for text, lang in rows:
            for w in LETTERS.findall(text.lower()):
                self.words.setdefault(lang, Counter())[w] += 1
                padded = f" {w} "
                for k in range(1, lang_id.LONGEST + 1):
                    for i in range(len(padded) - k + 1):
                        if padded[i : i + k] != " ":
                            self.grams.setdefault((lang, k), Counter())[padded[i : i + k]] += 1
        self.languages = sorted(self.words)
        self.known = {w for c in self.words.values() for w in c}
        self.total = {key: c.total() for key, c in [*self.words.items(), *self.grams.items()]}

    def word(self, w):
        if w in self.known:
            return [math.log10(self.words[x][w] / self.total[x]) if w in self.words[x] else lang_id.PENALTY for x in self.languages]
        padded = f" {w} "
        for k in range(min(lang_id.LONGEST, len(padded)), 0, -1):
            cut = [padded[i : i + k] for i in range(len(padded) - k + 1)]
            cut = [g for g in cut if any(g in self.grams.get((x, k), ()) for x in self.languages)]
            if cut:
                return [sum(math.log10(self.grams[x, k][g] / self.total[x, k]) if g in self.grams.get((x, k), ()) else lang_id.PENALTY for g in cut) / len(cut) for x in self.languages]
        return [lang_id.PENALTY] * len(self.languages)

    def judge(self, text):
        found = LETTERS.findall((text or "").lower())
        if not found or not self.languages:
            return "und", 0.0
        mean = np.mean([self.word(w) for w in found], axis=0)
        share = 10 ** ((mean - mean.max()) * min(len(found), lang_id.SHARP))
        return self.languages[int(mean.argmax())], 1 / share.sum()


SHAPES = [(re.compile(r"[A-Z]+"), "A"), (re.compile(r"(?:[a-z]|[^\x00-\x7f])+"), "a"), (re.compile(r"[0-9]+"), "0")]


def term_counts(text):
    """Counts of the hashed terms of one text, term by term."""
    out = np.zeros(quality_knn.TERMS, np.int64)

    def add(word, salt):
        raw = word.encode()
        h = W.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.ones(256, bool), False).hash if raw else np.zeros(0, W.U64)
        out[int((W.mix(h ^ W.U64(salt)) % W.U64(quality_knn.TERMS))[0])] += 1

    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for w in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", low):
        add(w, 1)
    before = None
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        add(w, 2)
        if w == before:
            out[int((W.mix(np.array([7], W.U64) ^ W.U64(3)) % W.U64(quality_knn.TERMS))[0])] += 1
        before = w
        shape = "".join("A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or c > "\x7f" else "0" if "0" <= c <= "9" else c for c in w)
        add(re.sub(r"(.)\1+", r"\1", shape, flags=re.S), 4)
    return out


def neighbour_scores(model, texts, labelled):
    """Scores in the model's latent space, neighbour by neighbour. labelled: (text, label)."""

    def vector(text):
        x = np.log1p(term_counts(text)) * model.idf
        x = x / max(np.linalg.norm(x), 1e-9) @ model.basis
        return x / max(np.linalg.norm(x), 1e-9)

    known = [(vector(t), y) for t, y in labelled]
    prior = sum(y for _, y in known) / len(known)
    out = []
    for t in texts:
        v = vector(t)
        near = sorted(((float(v @ u), y) for u, y in known), key=lambda x: -x[0])[: quality_knn.NEIGHBOURS]
        w = [(max(c, 0) ** quality_knn.SHARP, y) for c, y in near]
        out.append((sum(a * y for a, y in w) + quality_knn.PRIOR * prior) / (sum(a for a, _ in w) + quality_knn.PRIOR))
    return out


def best_fit(lengths, capacity, bins):
    """A run goes to the open sequence with the least free space that holds it; the fullest closes when too many are open."""
    free, order, out, opened = {}, [], [], 0
    for n in lengths:
        fits = [s for s in order if free[s] >= n]
        least = min((free[s] for s in fits), default=None)
        if fits:
            at = [s for s in fits if free[s] == least][-1]
            order.remove(at)
        else:
            at, opened = opened, opened + 1
            free[at] = capacity
        out.append((at, capacity - free[at]))
        free[at] -= n
        if free[at]:
            if len(order) == bins:
                fullest = min(free[s] for s in order)
                if fullest >= free[at]:
                    continue
                order.remove([s for s in order if free[s] == fullest][-1])
            order.append(at)
    return out
