"""Plain versions of the corpus operators for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(texts: dict[int, str | None], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """id -> (set size, component)."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    pairs = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    comp = groups(pairs, ids)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def cut(texts: list[str | None], length: int) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, spans, rest) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(texts, items, width=10):
    """(words, hit words, items found as sorted strings) per text."""
    wins = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(str(item))
    out = []
    for t in texts:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                own = wins.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def statistics(text):
    """words, word_chars, symbols, dup lines, repeated words, base_failed."""
    text = text or ""
    w = words(text, lower=False)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


class KneserNey:
    """Interpolated modified Kneser-Ney over lists of words; the end of a text is a word."""

    def __init__(self, docs, order):
        self.order = order
        seqs = [["<s>"] * (order - 1) + list(d) + ["</s>"] for d in docs]
        grams = Counter(tuple(s[i : i + order]) for s in seqs for i in range(len(s) - order + 1))
        self.unigrams = Counter(w for d in docs for w in [*d, "</s>"])
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.ctx = {}, {}
        for k, c in self.counts.items():
            n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
            self.d[k] = self.discount(n)
            ctx = defaultdict(lambda: [0, 0, 0, 0])
            for g, v in c.items():
                x = ctx[g[:-1]]
                x[0] += v
                x[min(v, 3)] += 1
            self.ctx[k] = ctx

    @staticmethod
    def discount(n):
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
            if all(0 < v <= k for k, v in enumerate(d, 1)):
                return d
        return (0.5, 1.0, 1.5)

    def p(self, gram):
        out = 1 / (len(self.unigrams) + 1)
        for k in range(1, self.order + 1):
            g = tuple(gram[len(gram) - k :])
            total, *ns = self.ctx[k].get(g[:-1], (0, 0, 0, 0))
            if total:
                c = self.counts[k].get(g, 0)
                d = (0, *self.d[k])[min(c, 3)]
                out = (c - d) / total + sum(a * b for a, b in zip(self.d[k], ns)) / total * out
        return out

    def score(self, doc):
        s = ["<s>"] * (self.order - 1) + list(doc) + ["</s>"]
        return sum(math.log10(self.p(s[i : i + self.order])) for i in range(len(s) - self.order + 1))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
