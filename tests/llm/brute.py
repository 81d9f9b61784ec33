"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORDS.findall((text or "").encode())


def shingles(text):
    w = [x.lower() for x in split(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(edges, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def near_duplicates(docs):
    """{id: (shingles, component)} of (id, text) with distinct ids; pairs are found through shared shingles."""
    sets = {i: shingles(t) for i, t in docs}
    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    both = {}
    for own in having.values():
        for a in own:
            for b in own:
                if a < b:
                    both[a, b] = both.get((a, b), 0) + 1
    edges = [p for p, n in both.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    of = components(edges, sets)
    return {i: (len(s), of[i]) for i, s in sets.items()}


def windows(docs, n=50):
    """{id: (words, removed, sha256)} of (id, text) with distinct ids."""
    split_ = {i: split(t) for i, t in docs}
    first = {}
    for i, w in split_.items():
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            first[x] = min(first.get(x, i), i)
    out = {}
    for i, w in split_.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept).hexdigest()
    return out
