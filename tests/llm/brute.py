"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import xxhash


def words_of(text):
    return (text or "").encode().split()


def op5(rows, window=50):
    """rows: (doc_id, text)."""
    first = {}
    for doc_id, text in rows:
        w = words_of(text)
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < doc_id:
                    gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def op7(rows):
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)]


def multiset(rows):
    return Counter(map(tuple, rows))
