"""Plain-Python counterparts of the corpus operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_strings(rows, window=200):
    """[(doc_id, text)] → sorted [(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + window] for _, b in data for i in range(len(b) - window + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, words=4):
    ws = WORD.findall((text or "").translate(SMALL))
    if not ws:
        return frozenset()
    return frozenset({tuple(ws)} if len(ws) < words else {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)})


def components(rows, percent=85, words=4):
    """[(doc_id, text)] → sorted [(doc_id, n_shingles, component_id)] over all pairs."""
    sets = [(d, shingles(t, words)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets)
