"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def removed(rows, size=50):
    """doc_id: (bytes, removed, spans, hash of the rest), for repeated strings that also start in a smaller document."""
    last = 1 << 63
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            first[s] = min(first.get(s, last), last if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < (last if d is None else d):
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def shingle_set(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows):
    """doc_id: (set size, component) by all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeat_words(w):
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)})
