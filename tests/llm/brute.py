"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, length=5):
    w = words(lower(text))
    return {tuple(w[i : i + length]) for i in range(max(len(w) - length + 1, 1))} if w else set()


def near_components(rows, percent=85):
    """``doc_id -> (n_shingles, component)`` of (doc_id, text) rows."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = sets[a] & sets[b]
            if a < b and both and 100 * len(both) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows, window=20):
    """``doc_id -> (n_words, n_removed, sha256)``."""
    first, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = set()
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if key in first:
                gone.update(range(at, at + window))
            first.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*counts, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def leaks(docs, items, threshold=0.8):
    def sets(text):
        w = words((text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    asked = {i: sets(t) for i, t in items}
    return {(d, i) for d, t in docs for i, q in asked.items() if q and len(q & sets(t)) >= threshold * len(q)}
