"""Brute-force versions in plain Python."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def index_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text, size=5):
    w = space_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, 1)))


def linked(a, b):
    i = len(a & b)
    return bool(i) and 100 * i >= 75 * (len(a) + len(b) - i)


def components(docs):
    """docs: {id: text} -> {id: smallest id reachable}; all pairs are compared."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    ids = sorted(docs)
    best = {i: i for i in ids}
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if linked(sets[a], sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                moved = True
    return best


def windows(text, size=13):
    w = index_words(text)
    return {tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()


def contamination(docs, items):
    """docs: {id: text}, items: [(item_id, text)] -> {id: (n_words, n_hit, n_items, sha, contaminated)}"""
    wanted = {}
    for i, t in items:
        for w in windows(t):
            wanted.setdefault(w, set()).add("" if i is None else str(i))
    lengths, out = {len(w) for w in wanted}, {}
    for i, t in docs.items():
        w, hit, ids = index_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                found = wanted.get(tuple(w[k:k + n]))
                if found:
                    ids |= found
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                  bool(hit) and 20 * len(hit) >= len(w))
    return out
