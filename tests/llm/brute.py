"""Plain Python versions of the corpus queries' results."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def decontamination(docs, benchmark, n=10):
    items = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            items.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    sizes = {len(k) for k in items}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (got := items.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def license_base(docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    out = []
    for doc_id, text in docs:
        w, at, labels = words(text), [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        out.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return out


def substring(docs, n=13):
    """docs in any order; a window counts if it also starts in a document with a smaller id."""
    first = {}
    cut = [(d, PLAIN.findall(t or "")) for d, t in docs]
    for d, w in cut:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text):
    import xxhash

    w = (text or "").translate(LOWER)
    w = PLAIN.findall(w)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def near(docs, limit=4):
    prints = [(d, fingerprint(t)) for d, t in docs]
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if (f ^ g).bit_count() <= limit:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(d, f"{f:016x}", find(d)) for d, f in prints]


def top_k(vectors, k=5, every=50):
    import math

    rows = []
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (q, own) in enumerate(rows):
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(own, v)), i) for j, (i, v) in enumerate(rows) if j != at and len(v) == len(own)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
