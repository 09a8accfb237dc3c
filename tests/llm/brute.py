"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_ASCII)


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(docs):
    """``{id: (n_shingles, component)}``"""
    sets = {i: shingles(t) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    pairs = Counter((a, b) for ids in where.values() for a in ids for b in ids if a < b)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, b), n in pairs.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substrings(docs, k=13):
    """``{id: (n_words, n_removed, kept_sha256)}``"""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        w = words[i]
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p:p + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p:p + k])] < i:
                gone.update(range(p, p + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, k=13):
    """``{id: (n_words, n_hit, n_items, items_sha256, contaminated)}``"""
    windows = defaultdict(set)
    for item, text in items:
        w = TOKEN.findall(lower(text))
        n = min(k, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[p:p + n])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for i, t in docs:
        w, hit, found = TOKEN.findall(lower(t)), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p:p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[x]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                  len(hit) > 0 and 20 * len(hit) >= len(w))
    return out
