"""Plain Python restatements of the contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def substring(rows, window=13):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, kept)}"""
    words = [(LAST if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, ws in words:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), (key, ws) in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < key:
                gone.update(range(i, i + window))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def suffix(rows, width=100):
    """rows: (doc_id, text) -> [(doc_id, n_bytes, n_removed, n_spans, kept bytes)]"""
    data = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (d, _), (key, b) in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (key, i):
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def lower_az(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text, n=5):
    ws = WORD.findall(lower_az(text or ""))
    if not ws:
        return frozenset()
    return frozenset([tuple(ws)] if len(ws) < n else [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)])


def jaccard(rows, num=80, den=100):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id)}; ids are distinct and not null"""
    sets = {d: shingles(t) for d, t in rows}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        both = {}
        for x in s:
            for e in by[x]:
                if e > d:
                    both[e] = both.get(e, 0) + 1
        for e, n in both.items():
            if den * n >= num * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def sha256(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    t = text or ""
    ws = WORD.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    count = {}
    for i in range(len(ws) - 7):
        k = tuple(ws[i : i + 8])
        count[k] = count.get(k, 0) + 1
    words = set()
    for i in range(len(ws) - 7):
        if count[tuple(ws[i : i + 8])] > 1:
            words.update(range(i, i + 8))
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(words)
