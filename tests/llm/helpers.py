"""Plain versions of what the operators compute."""

from __future__ import annotations

import re

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def shingles(text: str | None, lower: bool = True) -> frozenset:
    raw = (text or "").encode()
    words = WORDS.findall(raw.translate(LOWER) if lower else raw)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def linked(texts: dict) -> dict:
    """Least linked id of every document, by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    union, ids = Union(texts), sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                union.join(i, j)
    return {i: union.root(i) for i in ids}


def without_repeats(texts: list[bytes], length: int) -> list[tuple[list[tuple[int, int]], bytes]]:
    """Maximal removed runs and kept bytes of every text, by all windows."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and gone[end]:
                end += 1
            if end > at:
                runs.append((at, end))
            at = max(end, at + 1)
        out.append((runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out
