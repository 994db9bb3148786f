"""Plain versions of the operators, for small inputs."""

import hashlib
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def kept_words(rows):
    """rows: (doc_id, text) in ascending doc_id -> doc_id: (n_words, n_removed, sha of kept)"""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        w = SPACE.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    index = {}
    for d in ids:
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    pairs = {(a, b) for same in index.values() for i, a in enumerate(same) for b in same[i + 1 :]}
    for a, b in pairs:
        c = len(sets[a] & sets[b])
        if c and 100 * c >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
